"""Registered queries: privacy, order analytics, joins and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopguard.operators import lifecycle as lc
from shopguard.operators import orders as od
from shopguard.operators import privacy as pv
from shopguard.operators import quality as qa
from shopguard.plans.catalog import register
from shopguard.plans.shop import _poisoned, _poisoned_and_backup
from shopguard.plans.sql import VIEWS
from shopguard.session import written_table
from shopguard.sources import bindings as b
from shopguard.sources.tables import load_table

MONTH_ANCHOR = "1998-09-15 00:00:00"
WINDOW_ANCHOR = "1998-08-02 00:00:00"

VIEWS["safe_customers"] = """
SELECT id, name, '[REDACTED]' AS email, '[REDACTED]' AS phone, created_at, tier FROM customers_raw"""


def _cnt(sql_from_where: str) -> str:
    return f"(SELECT count(*) FROM {sql_from_where})"


@register("p1_safe_customers", "P1", oracle="SELECT * FROM safe_customers")
def p1_safe_customers(spark, sf):
    return pv.safe_customers(b.customers_raw(spark, sf))


@register("p2_derived_expression", "P2", oracle="""
SELECT id, email AS contact, phone AS mobile, email || ':' || phone AS combined FROM safe_customers""")
def p2_derived_expression(spark, sf):
    safe = pv.safe_customers(b.customers_raw(spark, sf))
    return safe.select("id", F.col("email").alias("contact"), F.col("phone").alias("mobile"),
                       F.concat_ws(":", "email", "phone").alias("combined"))


@register("p3_row_cap", "P3", oracle="SELECT id, email FROM safe_customers ORDER BY id LIMIT 100")
def p3_row_cap(spark, sf):
    safe = pv.safe_customers(b.customers_raw(spark, sf)).select("id", "email")
    return pv.cap_rows(safe, 101)


@register("p4_redact_by_name", "P4", oracle="""
SELECT id, '[REDACTED]' AS email, phone AS mobile FROM customers_raw""")
def p4_redact_by_name(spark, sf):
    raw = b.customers_raw(spark, sf).select("id", "email", F.col("phone").alias("mobile"))
    return pv.redact(raw, ["email", "phone"])


@register("p5_leak_scan", "P5", oracle="""
SELECT 'documents' AS source, count(*) AS rows, 'text' AS "column",
       count(*) FILTER (WHERE contains(text, '@') OR contains(text, '+1-555-')) AS leak_rows
FROM documents
UNION ALL
SELECT 'p4_output', count(*), 'email', count(*) FILTER (WHERE contains(email, '@') OR contains(email, '+1-555-'))
FROM (SELECT '[REDACTED]' AS email, phone AS mobile FROM customers_raw)
UNION ALL
SELECT 'p4_output', count(*), 'mobile', count(*) FILTER (WHERE contains(mobile, '@') OR contains(mobile, '+1-555-'))
FROM (SELECT '[REDACTED]' AS email, phone AS mobile FROM customers_raw)""")
def p5_leak_scan(spark, sf):
    docs = pv.find_leaks(load_table(spark, sf, "documents"), ["text"], "documents")
    p4 = pv.redact(b.customers_raw(spark, sf).select("email", F.col("phone").alias("mobile")),
                   ["email", "phone"])
    return docs.unionByName(pv.find_leaks(p4, ["email", "mobile"], "p4_output"))


@register("p7_lookup", "P7", oracle="""
SELECT k.id, o.id IS NOT NULL AS found, o.status, o.amount_cents
FROM (SELECT event_id * 7 AS id FROM events) k LEFT JOIN poisoned o ON k.id = o.id""")
def p7_lookup(spark, sf):
    keys = load_table(spark, sf, "events").select((F.col("event_id") * 7).alias("id"))
    return od.lookup(_poisoned(spark, sf), keys)


@register("p8_page_status", "P8", oracle="""
SELECT id, status, created_at FROM poisoned WHERE status = 'SHIPPED'
ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50""")
def p8_page_status(spark, sf):
    return od.page(_poisoned(spark, sf), 25, 50, "SHIPPED").select("id", "status", "created_at")


@register("p8_deep_page", "P8", oracle="""
SELECT id, status, created_at FROM poisoned ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 1200""")
def p8_deep_page(spark, sf):
    return od.deep_page(_poisoned(spark, sf), 25, 1200).select("id", "status", "created_at")


@register("p8_first_page", "P8", oracle="""
SELECT id, status, created_at FROM poisoned ORDER BY created_at DESC, id DESC LIMIT 25""")
def p8_first_page(spark, sf):
    return od.page(_poisoned(spark, sf)).select("id", "status", "created_at")


@register("a3_status_distribution", "A3", oracle="""
SELECT status, count(*) AS n FROM poisoned GROUP BY status""")
def a3_status_distribution(spark, sf):
    return od.status_distribution(_poisoned(spark, sf))


@register("a3_heartbeat", ("A3", "R5"), oracle="""
SELECT count(*) FILTER (WHERE status = 'PENDING_RECONCILE') AS pending_reconcile,
       count(*) FILTER (WHERE status = 'PENDING_RECONCILE') = 0 AS ok FROM poisoned""")
def a3_heartbeat(spark, sf):
    return od.heartbeat(_poisoned(spark, sf))


@register("a6_revenue_by_tier_month", ("A6", "J6"), bench=True, oracle=f"""
SELECT c.tier, CAST(sum(o.amount_cents) AS BIGINT) AS revenue_cents, count(*) AS orders
FROM shop_orders o JOIN customers_raw c ON o.customer_id = c.id
WHERE o.created_at >= date_trunc('month', TIMESTAMP '{MONTH_ANCHOR}') - INTERVAL 1 MONTH
  AND o.created_at < date_trunc('month', TIMESTAMP '{MONTH_ANCHOR}')
GROUP BY c.tier""")
def a6_revenue_by_tier_month(spark, sf):
    return od.revenue_by_tier(b.shop_orders(spark, sf), b.customers_raw(spark, sf), MONTH_ANCHOR)


@register("j6_revenue_by_tier", "J6", oracle="""
SELECT c.tier, CAST(sum(o.amount_cents) AS BIGINT) AS revenue_cents, count(*) AS orders
FROM shop_orders o JOIN customers_raw c ON o.customer_id = c.id GROUP BY c.tier""")
def j6_revenue_by_tier(spark, sf):
    return od.revenue_by_tier(b.shop_orders(spark, sf), b.customers_raw(spark, sf))


@register("a7_top_customers", "A7", oracle="""
SELECT c.id, c.name, c.email, c.tier, t.revenue_cents, t.orders
FROM (SELECT customer_id AS id, CAST(sum(amount_cents) AS BIGINT) AS revenue_cents, count(*) AS orders
      FROM shop_orders GROUP BY 1 ORDER BY revenue_cents DESC, id LIMIT 10) t
JOIN safe_customers c ON c.id = t.id""")
def a7_top_customers(spark, sf):
    return od.top_customers(b.shop_orders(spark, sf), b.customers_raw(spark, sf))


@register("j5_affected_customers", "J5", oracle="""
SELECT c.id, c.name, c.email, c.phone, c.tier, count(*) AS bad_orders,
       CAST(sum(o.amount_cents) AS BIGINT) AS bad_amount_cents
FROM classified o JOIN safe_customers c ON c.id = o.customer_id
WHERE o.code IS NOT NULL GROUP BY ALL""")
def j5_affected_customers(spark, sf):
    return od.affected_customers(_poisoned(spark, sf), b.customers_raw(spark, sf))


@register("j7_orphans", "J7", oracle="""
SELECT (SELECT count(*) FROM poisoned o WHERE NOT EXISTS (SELECT 1 FROM customers_raw c WHERE c.id = o.customer_id))
           AS orphan_orders,
       (SELECT count(*) FROM payments p WHERE NOT EXISTS (SELECT 1 FROM poisoned o WHERE o.id = p.order_id))
           AS orphan_payments""")
def j7_orphans(spark, sf):
    orders = written_table(b.shop_orders(spark, sf), "orders")
    poisoned = lc.inject_fault(orders, lc.choose_victims(orders))
    return od.orphans(poisoned, b.customers_raw(spark, sf), b.paid_orders(orders))


@register("j7_orphan_rows", "J7", oracle="""
WITH kept AS (SELECT * FROM poisoned WHERE status <> 'REFUNDED'), left_over AS (SELECT * FROM customers_raw WHERE tier <> 'platinum')
SELECT 'order' AS kind, id, customer_id AS missing FROM kept WHERE customer_id NOT IN (SELECT id FROM left_over)
UNION ALL SELECT 'payment', order_id, order_id FROM payments WHERE order_id NOT IN (SELECT id FROM kept)""")
def j7_orphan_rows(spark, sf):
    """What dangles once platinum customers and refunded orders are gone."""
    orders = written_table(b.shop_orders(spark, sf), "orders")
    kept = lc.inject_fault(orders, lc.choose_victims(orders)).where(F.col("status") != "REFUNDED")
    return od.orphan_rows(kept, b.customers_raw(spark, sf).where(F.col("tier") != "platinum"), b.paid_orders(orders))


@register("j8_surviving_rows", "J8", oracle="""
SELECT 'order' AS kind, id FROM shop_orders WHERE status <> 'REFUNDED'
UNION ALL SELECT 'payment', order_id FROM payments WHERE order_id NOT IN (SELECT id FROM shop_orders WHERE status = 'REFUNDED')
UNION ALL SELECT 'refused_customer', id FROM customers_raw c
  WHERE tier = 'platinum' AND EXISTS (SELECT 1 FROM shop_orders o WHERE o.customer_id = c.id)""")
def j8_surviving_rows(spark, sf):
    """What a cascading delete of refunded orders leaves, and the customers whose delete is refused."""
    orders = written_table(b.shop_orders(spark, sf), "orders")
    kept, paid = od.delete_orders(orders, b.paid_orders(orders), orders.where(F.col("status") == "REFUNDED"))
    refused = od.restrict_violations(b.customers_raw(spark, sf).where(F.col("tier") == "platinum"), orders)
    return (kept.select(F.lit("order").alias("kind"), "id")
            .unionByName(paid.select(F.lit("payment").alias("kind"), F.col("order_id").alias("id")))
            .unionByName(refused.select(F.lit("refused_customer").alias("kind"), "id")))


@register("j8_cascade_delete", "J8", oracle="""
WITH gone AS (SELECT id FROM shop_orders WHERE status = 'REFUNDED')
SELECT (SELECT count(*) FROM shop_orders WHERE id NOT IN (SELECT id FROM gone)) AS orders_after,
       (SELECT count(*) FROM payments WHERE order_id NOT IN (SELECT id FROM gone)) AS payments_after,
       (SELECT count(*) FROM customers_raw c WHERE c.tier = 'platinum'
          AND EXISTS (SELECT 1 FROM shop_orders o WHERE o.customer_id = c.id)) AS restricted_customers""")
def j8_cascade_delete(spark, sf):
    from shopguard.operators.common import one_row

    orders = written_table(b.shop_orders(spark, sf), "orders")
    pays = b.paid_orders(orders)
    kept, kept_pay = od.delete_orders(orders, pays, orders.where(F.col("status") == "REFUNDED"))
    blocked = od.restrict_violations(
        b.customers_raw(spark, sf).where(F.col("tier") == "platinum"), orders)
    return one_row(kept.agg(F.count(F.lit(1)).alias("orders_after")),
                   kept_pay.agg(F.count(F.lit(1)).alias("payments_after")),
                   blocked.agg(F.count(F.lit(1)).alias("restricted_customers")))


def _check_rows(tbl: str, src: str, rules: dict[str, str], unique: dict[str, str]) -> str:
    parts = [f"SELECT '{tbl}' AS tbl, '{n}' AS check_name, count(*) FILTER (WHERE coalesce({p}, false)) AS violations FROM {src}"
             for n, p in rules.items()]
    parts += [f"SELECT '{tbl}', '{n}', (SELECT count(*) FROM (SELECT {k} FROM {src} GROUP BY {k} HAVING count(*) > 1))"
              for n, k in unique.items()]
    return "\nUNION ALL ".join(parts)


_ORDER_CHECKS = _check_rows("orders", "poisoned", {
    "not_null": "id IS NULL OR customer_id IS NULL OR sku IS NULL OR qty IS NULL OR amount_cents IS NULL "
                "OR status IS NULL OR created_at IS NULL OR payload IS NULL",
    "qty_positive": "qty <= 0", "amount_nonnegative": "amount_cents < 0",
    "known_status": "status NOT IN ('PENDING', 'SHIPPED', 'DELIVERED', 'CANCELLED', 'REFUNDED')",
}, {"pk_unique": "id"})
_CUSTOMER_CHECKS = _check_rows("customers", "customers_raw", {
    "not_null": "id IS NULL OR name IS NULL OR email IS NULL OR phone IS NULL OR created_at IS NULL OR tier IS NULL",
    "tier_allowed": "tier NOT IN ('standard', 'silver', 'gold', 'platinum')",
}, {"pk_unique": "id", "email_unique_ci": "lower(email)"})
_PAYMENT_CHECKS = _check_rows("payments", "payments", {
    "not_null": "id IS NULL OR order_id IS NULL OR last4 IS NULL OR processor_ref IS NULL OR amount_cents IS NULL",
    "amount_nonnegative": "amount_cents < 0",
    "last4_digits": "NOT regexp_full_match(last4, '[0-9]{4}')",
}, {"pk_unique": "id", "processor_ref_unique": "processor_ref"})
_COVERAGE = """
SELECT 'payments' AS tbl, 'paid_without_payment' AS check_name,
       (SELECT count(*) FROM poisoned o WHERE status IN ('DELIVERED', 'SHIPPED', 'REFUNDED')
          AND NOT EXISTS (SELECT 1 FROM payments p WHERE p.order_id = o.id)) AS violations
UNION ALL SELECT 'payments', 'payment_without_paid_order',
       (SELECT count(*) FROM payments p WHERE NOT EXISTS (SELECT 1 FROM poisoned o
          WHERE o.id = p.order_id AND o.status IN ('DELIVERED', 'SHIPPED', 'REFUNDED')))"""
_WINDOW = _check_rows("orders", "poisoned", {
    "created_in_window": f"created_at < TIMESTAMP '{WINDOW_ANCHOR}' - INTERVAL 180 DAY "
                         f"OR created_at > TIMESTAMP '{WINDOW_ANCHOR}'"}, {}) + "\nUNION ALL " + \
    _check_rows("customers", "customers_raw", {
        "created_before_window": f"created_at >= TIMESTAMP '{WINDOW_ANCHOR}' - INTERVAL 180 DAY"}, {})


def _with_passed(sql: str) -> str:
    return f"SELECT tbl, check_name, violations, violations = 0 AS passed FROM ({sql})"


@register("q_order_checks", ("Q1", "Q2", "Q3", "Q7"), oracle=_with_passed(_ORDER_CHECKS))
def q_order_checks(spark, sf):
    return qa.order_checks(_poisoned(spark, sf))


@register("q_customer_checks", ("Q1", "Q2", "Q4", "Q5"), oracle=_with_passed(_CUSTOMER_CHECKS))
def q_customer_checks(spark, sf):
    return qa.customer_checks(b.customers_raw(spark, sf))


@register("q_payment_checks", ("Q1", "Q2", "Q3", "Q6"), oracle=_with_passed(_PAYMENT_CHECKS))
def q_payment_checks(spark, sf):
    return qa.payment_checks(b.payments(spark, sf))


@register("q10_payment_coverage", "Q10", oracle=_with_passed(_COVERAGE))
def q10_payment_coverage(spark, sf):
    orders = written_table(b.shop_orders(spark, sf), "orders")
    return qa.payment_coverage(lc.inject_fault(orders, lc.choose_victims(orders)), b.paid_orders(orders))


VIEWS["damaged_backup"] = """
SELECT CASE WHEN id % 11 = 0 THEN NULL ELSE id END AS id, status, CASE WHEN id % 7 = 0 THEN NULL ELSE payload END AS payload,
       created_at, backed_up_at FROM poison_backup
UNION ALL SELECT * FROM poison_backup WHERE id % 5 = 0"""
_BACKUP_RULES = {"not_null": "id IS NULL OR status IS NULL OR payload IS NULL OR created_at IS NULL OR backed_up_at IS NULL"}


@register("q_backup_checks", ("Q1", "Q2"), oracle=_with_passed(
    _check_rows("poison_backup", "damaged_backup", _BACKUP_RULES, {"pk_unique": "id"})))
def q_backup_checks(spark, sf):
    """The backup's key and required columns, on a backup with rows that break them."""
    backup = _poisoned_and_backup(spark, sf)[1]
    blank = lambda c, n: F.when(F.col("id") % n != 0, F.col(c)).alias(c)
    damaged = backup.select(blank("id", 11), "status", blank("payload", 7), "created_at", "backed_up_at")
    return qa.backup_checks(damaged.unionByName(backup.where(F.col("id") % 5 == 0)))


@register("q11_window_checks", "Q11", oracle=_with_passed(_WINDOW))
def q11_window_checks(spark, sf):
    return qa.window_checks(_poisoned(spark, sf), b.customers_raw(spark, sf), WINDOW_ANCHOR)


_CARD = "\nUNION ALL ".join([_ORDER_CHECKS, _CUSTOMER_CHECKS, _PAYMENT_CHECKS, _COVERAGE])


def _card(spark, sf):
    # Five checks read the order binding (a join of orders with aggregated
    # lines) and four read the numbered payments; each is written once as
    # Parquet, from which every check reads only its columns.
    orders = written_table(b.shop_orders(spark, sf), "orders")
    poisoned = lc.inject_fault(orders, lc.choose_victims(orders))
    customers = b.customers_raw(spark, sf)
    pays = written_table(b.payments_from_orders(orders), "payments")
    return qa.scorecard(qa.order_checks(poisoned), qa.customer_checks(customers),
                        qa.payment_checks(pays), qa.payment_coverage(poisoned, pays))


@register("a13_scorecard", "A13", bench=True, oracle=_with_passed(_CARD))
def a13_scorecard(spark, sf):
    return _card(spark, sf)


@register("a13_scorecard_summary", "A13", oracle=f"""
SELECT count(*) FILTER (WHERE violations = 0) AS passed, count(*) FILTER (WHERE violations <> 0) AS failed,
       count(*) FILTER (WHERE violations <> 0) = 0 AS ready FROM ({_CARD})""")
def a13_scorecard_summary(spark, sf):
    return qa.scorecard_summary(_card(spark, sf))


@register("a13_scorecard_after_repair", ("A13", "D3"), oracle=_with_passed(
    _ORDER_CHECKS.replace("poisoned", "remediated")))
def a13_scorecard_after_repair(spark, sf):
    poisoned, backup = _poisoned_and_backup(spark, sf)
    return qa.order_checks(lc.remediate(poisoned, backup))
