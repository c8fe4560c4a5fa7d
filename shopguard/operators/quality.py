"""Data-quality checks as queries (Q1-Q11) and the readiness scorecard.

Row-level rules of one table are fused into a single aggregate (one scan);
each uniqueness rule is one grouped count whose partial aggregation runs
map-side. Results are long rows ``(tbl, check_name, violations, passed)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopguard.operators.common import one_row
from shopguard.operators.payload import KNOWN_STATUSES

# Fixed values of the shop schema.
TIERS = ("standard", "silver", "gold", "platinum")
PAID_STATUSES = ("DELIVERED", "SHIPPED", "REFUNDED")


def run_checks(df: DataFrame, table: str, row_rules: dict[str, Column],
               unique: dict[str, list[Column]] | None = None) -> DataFrame:
    """Evaluate ``row_rules`` (violation predicates) and uniqueness rules in one pass.

    One grouping-sets aggregate reads the input once: a set per uniqueness rule
    (its key columns) and the empty set, whose single group counts row-rule
    violations over all rows. Partial aggregation runs map-side, so many copies
    of one key are combined before the shuffle. A second aggregate over the
    (few) groups gives one count per rule: the row-rule totals, and the number
    of keys held by more than one row.
    """
    unique = unique or {}
    names = list(row_rules) + list(unique)
    aliases = {n: f"c{i}" for i, n in enumerate(names)}
    key_cols = {n: [f"_u{i}_{j}" for j in range(len(keys))] for i, (n, keys) in enumerate(unique.items())}
    flat = [c for cols in key_cols.values() for c in cols]
    rule_cols = {n: f"_r{i}" for i, n in enumerate(row_rules)}
    staged = df.select(*[k.alias(c) for n, keys in unique.items() for k, c in zip(keys, key_cols[n])],
                       *[F.coalesce(p, F.lit(False)).alias(rule_cols[n]) for n, p in row_rules.items()])
    zero = F.lit(0).cast("long")
    if not flat:
        wide = staged.agg(*[F.count_if(F.col(rule_cols[n])).alias(aliases[n]) for n in row_rules])
    else:
        def gid(members: list[str]) -> int:  # grouping_id: a bit per grouping column left out
            return sum(1 << (len(flat) - 1 - j) for j, c in enumerate(flat) if c not in members)

        groups = (staged.groupingSets([key_cols[n] for n in unique] + [[]], *flat)
                  .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_n"),
                       *[F.count_if(F.col(c)).alias(c) for c in rule_cols.values()]))
        everything = F.col("_gid") == gid([])
        wide = groups.agg(
            *[F.coalesce(F.max(F.when(everything, F.col(rule_cols[n]))), zero).alias(aliases[n])
              for n in row_rules],
            *[F.count_if((F.col("_gid") == gid(key_cols[n])) & (F.col("_n") > 1)).alias(aliases[n])
              for n in unique])
    stack = ", ".join(f"'{n}', {aliases[n]}" for n in names)
    return (wide.selectExpr(f"stack({len(names)}, {stack}) AS (check_name, violations)")
            .select(F.lit(table).alias("tbl"), "check_name", "violations",
                    (F.col("violations") == 0).alias("passed")))


def _any_null(df: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def order_checks(orders: DataFrame) -> DataFrame:
    """Q1 (pk), Q2 (not null), Q3 (qty, amount), Q7 (known status)."""
    return run_checks(orders, "orders", {
        "not_null": _any_null(orders, ["id", "customer_id", "sku", "qty", "amount_cents",
                                       "status", "created_at", "payload"]),
        "qty_positive": F.col("qty") <= 0,
        "amount_nonnegative": F.col("amount_cents") < 0,
        "known_status": ~F.col("status").isin(*KNOWN_STATUSES),
    }, {"pk_unique": [F.col("id")]})


def customer_checks(customers: DataFrame) -> DataFrame:
    """Q1, Q2, Q4 (tier), Q5 (case-insensitive email)."""
    return run_checks(customers, "customers", {
        "not_null": _any_null(customers, ["id", "name", "email", "phone", "created_at", "tier"]),
        "tier_allowed": ~F.col("tier").isin(*TIERS),
    }, {"pk_unique": [F.col("id")], "email_unique_ci": [F.lower("email")]})


def payment_checks(payments: DataFrame) -> DataFrame:
    """Q1, Q2, Q3, Q6 (processor_ref unique, last4 four digits)."""
    return run_checks(payments, "payments", {
        "not_null": _any_null(payments, ["id", "order_id", "last4", "processor_ref", "amount_cents"]),
        "amount_nonnegative": F.col("amount_cents") < 0,
        "last4_digits": ~F.col("last4").rlike("^[0-9]{4}$"),
    }, {"pk_unique": [F.col("id")], "processor_ref_unique": [F.col("processor_ref")]})


def backup_checks(backup: DataFrame) -> DataFrame:
    """Q1, Q2 of the backup table: its key and its required columns."""
    return run_checks(backup, "poison_backup", {
        "not_null": _any_null(backup, ["id", "status", "payload", "created_at", "backed_up_at"]),
    }, {"pk_unique": [F.col("id")]})


def payment_coverage(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Q10: a payment exists exactly for DELIVERED, SHIPPED and REFUNDED orders."""
    paid = orders.where(F.col("status").isin(*PAID_STATUSES)).select(F.col("id").alias("order_id"))
    pay = payments.select("order_id")
    missing = paid.join(pay, "order_id", "left_anti").agg(F.count(F.lit(1)).alias("c0"))
    extra = pay.join(paid, "order_id", "left_anti").agg(F.count(F.lit(1)).alias("c1"))
    return (one_row(missing, extra)
            .selectExpr("stack(2, 'paid_without_payment', c0, 'payment_without_paid_order', c1) "
                        "AS (check_name, violations)")
            .select(F.lit("payments").alias("tbl"), "check_name", "violations",
                    (F.col("violations") == 0).alias("passed")))


def window_checks(orders: DataFrame, customers: DataFrame, anchor: str, days: int = 180) -> DataFrame:
    """Q11: orders inside the ``days`` window ending at ``anchor``; customers older."""
    end = F.lit(anchor).cast("timestamp_ntz")
    start = end - F.make_dt_interval(days=F.lit(days))
    o = run_checks(orders, "orders", {
        "created_in_window": (F.col("created_at") < start) | (F.col("created_at") > end)})
    c = run_checks(customers, "customers", {"created_before_window": F.col("created_at") >= start})
    return o.unionByName(c)


def scorecard(*check_frames: DataFrame) -> DataFrame:
    """All check rows stacked."""
    return reduce(DataFrame.unionByName, check_frames)


def scorecard_summary(card: DataFrame) -> DataFrame:
    """A13 totals: passed, failed, and ready when nothing failed."""
    return card.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")) \
        .withColumn("ready", F.col("failed") == 0)


def role_boundary(roles: DataFrame, names: list[str],
                  attrs=("rolsuper", "rolcreatedb", "rolcreaterole", "rolbypassrls")) -> DataFrame:
    """``bool_and`` of "no administrative attribute" over the named roles."""
    ok = reduce(lambda a, b: a & b, [~F.col(a) for a in attrs])
    return roles.where(F.col("rolname").isin(*names)).agg(F.bool_and(ok).alias("non_administrative"))


def role_boundary_by(roles: DataFrame, by: list[str],
                     attrs=("rolsuper", "rolcreatedb", "rolcreaterole", "rolbypassrls")) -> DataFrame:
    """A12 per group of roles: how many roles, how many hold an administrative
    attribute, and the ``bool_and`` check itself (one partial aggregate)."""
    ok = reduce(lambda a, b: a & b, [~F.col(a) for a in attrs])
    return roles.groupBy(*by).agg(F.count(F.lit(1)).alias("roles"),
                                  F.count_if(~ok).alias("administrative_roles"),
                                  F.bool_and(ok).alias("non_administrative"))


def null_rates(df: DataFrame, table: str) -> DataFrame:
    """Q9: per column null rate; a column that is entirely null hints at a wrong schema."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return (wide.selectExpr("_rows", f"stack({len(cols)}, {stack}) AS (column_name, nulls)")
            .select(F.lit(table).alias("tbl"), "column_name", F.col("_rows").alias("rows"), "nulls",
                    F.when(F.col("_rows") > 0, F.round(F.col("nulls") / F.col("_rows"), 6))
                    .alias("null_rate"),
                    ((F.col("nulls") == F.col("_rows")) & (F.col("_rows") > 0)).alias("all_null")))
