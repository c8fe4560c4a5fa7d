"""The readiness scorecard: one row per check over the governance and quality queries, with a detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shopguard.operators import policy as pol
from shopguard.plans.catalog import REGISTRY, register

# check -> (query whose rows it looks at, condition of a bad row, rows there must be or None)
CHECKS = {
    "order data": ("q_order_checks", "violations > 0", None),
    "customer data": ("q_customer_checks", "violations > 0", None),
    "payment data": ("q_payment_checks", "violations > 0", None),
    "redaction by name": ("p4_redact_by_name", "email <> '[REDACTED]'", None),
    "no alias past the redaction": ("p4_redact_by_name", "mobile <> '[REDACTED]'", None),
    "row cap": ("p3_row_cap", "email IS NULL", 100),
    "free text without contacts": ("p5_leak_scan", "leak_rows > 0", None),
    "database grants": ("x4_grant_drift", "true", None),
    "exposed tools": ("x5_tool_drift", "true", None),
    "role boundary": ("a12_role_boundary", "NOT non_administrative", None),
    "policy inventory": ("c_policy_hits", "matched = 0", len(pol.POLICIES)),
    "access only where allowed": ("c10_effective_access", "effective AND decision <> 'allow'", None),
    "repaired batch backed up": ("j12_backup_coverage", "NOT fully_covered", None),
    "audit columns filled": ("q9_audit_null_rates", "all_null", None),
}


def _oracle() -> str:
    parts = []
    for check, (query, bad, rows) in CHECKS.items():
        enough = "" if rows is None else f" AND n = {rows}"
        parts.append(f"""SELECT '{check}' AS check_name, bad AS violations, bad = 0{enough} AS passed,
       bad || ' of ' || n || ' rows of {query}' AS detail
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {bad}) AS bad FROM ({REGISTRY[query].oracle}))""")
    return "\nUNION ALL ".join(parts)


@register("a13_readiness", ("A13", "P3", "P4", "P5", "X4", "X5", "A12", "C10", "J12", "Q9"), oracle=_oracle())
def a13_readiness(spark, sf):
    """Each check's bad rows are counted in its own query; nothing but counts is combined."""
    rows = []
    for check, (query, bad, must) in CHECKS.items():
        counts = REGISTRY[query].build(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(bad)).alias("bad"))
        passed = F.col("bad") == 0
        if must is not None:
            passed = passed & (F.col("n") == must)
        rows.append(counts.select(
            F.lit(check).alias("check_name"), F.col("bad").alias("violations"), passed.alias("passed"),
            F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(f" rows of {query}"))
            .alias("detail")))
    return reduce(lambda a, b: a.unionByName(b), rows)
