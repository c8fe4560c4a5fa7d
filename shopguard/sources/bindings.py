"""Reference-shaped shop tables derived from the driver tables.

Each binding is a deterministic DataFrame over ``/root/testdata/<sf>`` that an
SQL oracle can restate (FIXTURES.md section 3). Payload text is built by plain
concatenation so both engines produce identical bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopguard.operators.numbering import global_row_number
from shopguard.sources.tables import load_table

# Fixed values of the bindings.
TIER_BY_SEGMENT = {"AUTOMOBILE": "platinum", "BUILDING": "gold", "FURNITURE": "silver"}
CUSTOMER_CREATED_AT = "1994-01-01 00:00:00"
PAID_STATUSES = ("DELIVERED", "SHIPPED", "REFUNDED")


def customers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``private.customer_pii`` rows: id, name, email, phone, created_at, tier."""
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    tier = F.lit("standard")
    for seg, t in reversed(TIER_BY_SEGMENT.items()):
        tier = F.when(F.col("c_mktsegment") == seg, F.lit(t)).otherwise(tier)
    return c.select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                 F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1-555-"), F.lpad((k % 100 + 100).cast("string"), 3, "0"), F.lit("-"),
                 F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
        F.lit(CUSTOMER_CREATED_AT).cast("timestamp_ntz").alias("created_at"),
        tier.alias("tier"),
    )


def _only(df: DataFrame, key: str, few: DataFrame | None) -> DataFrame:
    """The rows whose ``key`` is an ``id`` of ``few`` (a bounded set of orders, broadcast), or all."""
    if few is None:
        return df
    return df.join(F.broadcast(few.select(F.col("id").alias(key))), key, "left_semi")


def _order_lines(spark: SparkSession, sf_dir: str, few: DataFrame | None = None) -> DataFrame:
    """Per order: the JSON items array text, the line total, and the first line."""
    li = _only(load_table(spark, sf_dir, "lineitem"), "l_orderkey", few)
    sku = F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))
    qty = F.col("l_quantity").cast("int")
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    # Each line's JSON is built in the scan projection (compiled code); the
    # aggregate only collects, and the sort key struct makes the order total:
    # line number, part, supplier, then sku, qty and price.
    line = F.struct(F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"),
                    F.col("l_suppkey").alias("sk"), sku.alias("sku"), qty.alias("qty"),
                    price.alias("price"),
                    F.concat(F.lit('{"sku":"'), sku, F.lit('","qty":'), qty.cast("string"),
                             F.lit(',"unit_price_cents":'), price.cast("string"), F.lit("}")).alias("json"))
    # One order's lines are bounded (a handful); the sort is per group.
    per_order = (li.select(F.col("l_orderkey").alias("id"), line.alias("line"))
                 .groupBy("id")
                 .agg(F.sort_array(F.collect_list("line")).alias("lines"),
                      F.sum(F.col("line.qty") * F.col("line.price")).alias("lines_total")))
    return per_order.select(
        "id", "lines_total",
        F.concat(F.lit("["), F.array_join(F.col("lines.json"), ","), F.lit("]")).alias("items"),
        F.col("lines")[0]["sku"].alias("first_sku"),
        F.col("lines")[0]["qty"].alias("first_qty"))


def shop_orders(spark: SparkSession, sf_dir: str, few: DataFrame | None = None) -> DataFrame:
    """``public.orders`` rows with a well-formed JSON payload per order; ``few``
    (a bounded frame of ``id``) restricts both scans to those orders."""
    o = _only(load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                         "o_orderdate"), "o_orderkey", few)
    lines = _order_lines(spark, sf_dir, few)
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "F", "DELIVERED")
              .when(F.col("o_orderstatus") == "O", "SHIPPED")
              .when(k % 4 == 0, "CANCELLED").when(k % 4 == 1, "REFUNDED").otherwise("PENDING"))
    items = F.coalesce(F.col("items"), F.lit("[]"))
    amount = F.coalesce(F.col("lines_total"), F.lit(0).cast("long")) \
        + F.when(k % 50 == 0, 1).otherwise(0)
    payload = F.concat(F.lit('{"schema":2,"channel":"web","items":'), items,
                       F.lit(',"shipping":{"method":"standard"},"promo":null}'))
    # The per-order lines are hash-partitioned by order id by their aggregate;
    # a sort-merge join moves only ``orders``, spills instead of holding a hash
    # table in memory, and leaves the result spread over the shuffle partitions
    # (a broadcast would keep the scan's layout, and the lines side grows with
    # lineitem, so it has no size bound).
    return (o.join(lines.hint("merge"), o.o_orderkey == lines.id, "left")
            .select(k.alias("id"), F.col("o_custkey").alias("customer_id"),
                    F.coalesce(F.col("first_sku"), F.lit("P-0")).alias("sku"),
                    F.coalesce(F.col("first_qty"), F.lit(1)).alias("qty"),
                    amount.cast("long").alias("amount_cents"),
                    status.alias("status"),
                    F.col("o_orderdate").alias("created_at"),
                    payload.alias("payload")))


def paid_orders(orders: DataFrame) -> DataFrame:
    """The payments' orders and amounts, without the consecutive ids (for whoever only counts or joins them)."""
    return orders.where(F.col("status").isin(*PAID_STATUSES)).select(F.col("id").alias("order_id"), "amount_cents")


def payments_from_orders(orders: DataFrame) -> DataFrame:
    """``public.payments``: one row per paid order, ids consecutive in order-id order."""
    numbered = global_row_number(paid_orders(orders), [("order_id", True)], name="id")
    oid = F.col("order_id")
    return numbered.select(
        "id", "order_id",
        F.lpad((F.col("id") % 10000).cast("string"), 4, "0").alias("last4"),
        F.concat(F.lit("stripe_"), F.lpad(oid.cast("string"), 8, "0"),
                 F.lpad((oid % 900 + 100).cast("string"), 3, "0")).alias("processor_ref"),
        "amount_cents")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_from_orders(shop_orders(spark, sf_dir))
