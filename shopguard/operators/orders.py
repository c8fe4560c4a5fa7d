"""Order reads and analyst questions: lookups, pages, revenue, joins, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopguard.operators.numbering import Ranges
from shopguard.operators.payload import classify_payload
from shopguard.operators.privacy import safe_customers

POISON_STATUS = "PENDING_RECONCILE"


def lookup(orders: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Point lookups for a table of keys; absent keys come back with found=false."""
    hit = orders.select(key, F.lit(True).alias("_hit"), "status", "amount_cents")
    return (keys.select(key).join(hit, key, "left")
            .select(key, F.coalesce("_hit", F.lit(False)).alias("found"), "status", "amount_cents"))


# Rows a page may skip that each task sorts out by itself.
MAX_OFFSET = 10_000


def _check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be within 1..200")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def deep_page(orders: DataFrame, limit: int = 25, offset: int = 0, status: str | None = None) -> DataFrame:
    """P8 at any offset: the counts of the key's ranges say which range holds the page, and only that is read."""
    _check_page(limit, offset)
    df = orders if status is None else orders.where(F.col("status") == status)
    return Ranges(df, [("created_at", False), ("id", False)]).page(offset, limit)


def page(orders: DataFrame, limit: int = 25, offset: int = 0, status: str | None = None) -> DataFrame:
    """Newest-first page (created_at desc, id desc); limit 1..200, offset 0..MAX_OFFSET.

    Every task and the driver keep offset + limit rows, so deeper pages go through ``deep_page``.
    """
    _check_page(limit, offset)
    if offset > MAX_OFFSET:
        raise ValueError(f"offset must be at most {MAX_OFFSET}; deep_page has no such bound")
    df = orders if status is None else orders.where(F.col("status") == status)
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def status_distribution(orders: DataFrame) -> DataFrame:
    """A3: rows per status, largest first."""
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def heartbeat(orders: DataFrame) -> DataFrame:
    """A3 heartbeat: PENDING_RECONCILE rows and an OK flag when there are none."""
    return orders.agg(F.count_if(F.col("status") == POISON_STATUS).alias("pending_reconcile")) \
        .withColumn("ok", F.col("pending_reconcile") == 0)


def revenue_by_tier(orders: DataFrame, customers: DataFrame, anchor: str | None = None) -> DataFrame:
    """Revenue per tier; with ``anchor``, only the calendar month before it.

    Orders are summed per customer before the join, so the join sees one row
    per customer instead of one per order.
    """
    if anchor is not None:
        month = F.date_trunc("month", F.lit(anchor).cast("timestamp_ntz")).cast("timestamp_ntz")
        orders = orders.where((F.col("created_at") >= F.add_months(month, -1).cast("timestamp_ntz"))
                              & (F.col("created_at") < month))
    per_customer = orders.groupBy(F.col("customer_id").alias("id")).agg(
        F.sum("amount_cents").alias("revenue_cents"), F.count(F.lit(1)).alias("orders"))
    return (per_customer.join(customers.select("id", "tier"), "id")
            .groupBy("tier").agg(F.sum("revenue_cents").alias("revenue_cents"),
                                 F.sum("orders").alias("orders"))
            .orderBy(F.desc("revenue_cents"), "tier"))


def top_customers(orders: DataFrame, customers_raw: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` customers by revenue (masked names/contacts), ties by id."""
    top = (orders.groupBy(F.col("customer_id").alias("id"))
           .agg(F.sum("amount_cents").alias("revenue_cents"), F.count(F.lit(1)).alias("orders"))
           .orderBy(F.desc("revenue_cents"), "id").limit(k))
    # ``top`` holds k rows, so broadcasting it is bounded.
    return (safe_customers(customers_raw).join(F.broadcast(top), "id")
            .select("id", "name", "email", "tier", "revenue_cents", "orders"))


def affected_customers(orders: DataFrame, customers_raw: DataFrame) -> DataFrame:
    """Customers with malformed orders (masked), with counts and amounts."""
    bad = (classify_payload(orders).where(F.col("error_type").isNotNull())
           .groupBy(F.col("customer_id").alias("id"))
           .agg(F.count(F.lit(1)).alias("bad_orders"), F.sum("amount_cents").alias("bad_amount_cents")))
    return (safe_customers(customers_raw).join(bad, "id")
            .select("id", "name", "email", "phone", "tier", "bad_orders", "bad_amount_cents"))


def orphan_rows(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """``(kind, id, missing)``: orders without a customer and payments (by their order) without an order."""
    o = orders.select("id", F.col("customer_id").alias("missing")).join(
        customers.select(F.col("id").alias("missing")), "missing", "left_anti")
    p = payments.select(F.col("order_id").alias("id"), F.col("order_id").alias("missing")).join(
        orders.select("id"), "id", "left_anti")
    return (o.select(F.lit("order").alias("kind"), "id", "missing")
            .unionByName(p.select(F.lit("payment").alias("kind"), "id", "missing")))


def orphans(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """How many orders have no customer and how many payments no order."""
    kind = F.col("kind")
    return orphan_rows(orders, customers, payments).agg(
        F.count_if(kind == "order").alias("orphan_orders"), F.count_if(kind == "payment").alias("orphan_payments"))


def delete_orders(orders: DataFrame, payments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove orders by id; their payments go too (ON DELETE CASCADE)."""
    ids = ids.select("id")
    kept = orders.join(ids, "id", "left_anti")
    kept_pay = payments.join(ids.withColumnRenamed("id", "order_id"), "order_id", "left_anti")
    return kept, kept_pay


def restrict_violations(customers_to_delete: DataFrame, orders: DataFrame) -> DataFrame:
    """J8 RESTRICT: customers that cannot be deleted because orders reference them."""
    return customers_to_delete.select("id").join(
        orders.select(F.col("customer_id").alias("id")), "id", "left_semi")
