"""Registered queries: order payload contract, fault injection and repair cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopguard.operators import lifecycle as lc
from shopguard.operators import payload as pl
from shopguard.plans.catalog import register
from shopguard.plans.sql import VIEWS, pg_typeof
from shopguard.session import written_table
from shopguard.sources import bindings as b

_NUM = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN')"


def payload_error_sql(p: str) -> str:
    """DuckDB restatement of T1; yields 'Type:key' or NULL when the payload is ok."""
    it = f"json_type({p}, '$.items')"
    elem = ("CASE WHEN json_type(x) <> 'OBJECT' THEN 'TypeError:qty' "
            "WHEN json_type(x, '$.qty') IS NULL THEN 'KeyError:qty' "
            "WHEN json_type(x, '$.unit_price_cents') IS NULL THEN 'KeyError:unit_price_cents' "
            f"WHEN json_type(x, '$.qty') NOT IN {_NUM} THEN 'TypeError:qty' "
            f"WHEN json_type(x, '$.unit_price_cents') NOT IN {_NUM} THEN 'TypeError:unit_price_cents' "
            "WHEN json_type(x, '$.sku') IS NULL THEN 'KeyError:sku' END")
    falsy = (f"({p} IS NULL OR json_type({p}) = 'NULL' "
             f"OR (json_type({p}) = 'OBJECT' AND len(json_keys({p})) = 0) "
             f"OR (json_type({p}) = 'ARRAY' AND json_array_length({p}) = 0) "
             f"OR (json_type({p}) = 'VARCHAR' AND json_extract_string({p}, '$') = '') "
             f"OR (json_type({p}) IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') "
             f"AND CAST(json_extract_string({p}, '$') AS DOUBLE) = 0) "
             f"OR (json_type({p}) = 'BOOLEAN' AND json_extract_string({p}, '$') = 'false'))")
    first_bad = (f"list_filter(list_transform(CAST(json_extract({p}, '$.items[*]') AS JSON[]), "
                 f"lambda x: {elem}), lambda e: e IS NOT NULL)[1]")
    return (f"(CASE WHEN {p} IS NOT NULL AND NOT json_valid({p}) THEN 'ValueError:payload' "
            f"WHEN {falsy} THEN 'KeyError:items' "
            f"WHEN json_type({p}) <> 'OBJECT' THEN 'TypeError:payload' "
            f"WHEN {it} IS NULL THEN 'KeyError:items' "
            f"WHEN {it} = 'VARCHAR' THEN CASE WHEN json_extract_string({p}, '$.items') = '' THEN NULL "
            f"ELSE 'TypeError:qty' END "
            f"WHEN {it} = 'OBJECT' THEN CASE WHEN len(json_keys({p}, '$.items')) = 0 THEN NULL "
            f"ELSE 'TypeError:qty' END "
            f"WHEN {it} <> 'ARRAY' THEN 'TypeError:items' "
            f"ELSE {first_bad} END)")


VIEWS["classified"] = f"""
SELECT *, split_part(code, ':', 1) AS error_type, split_part(code, ':', 2) AS error_key
FROM (SELECT *, {payload_error_sql('payload')} AS code, {pg_typeof('payload')} AS items_type
      FROM poisoned)"""
VIEWS["victims2"] = """
SELECT id, row_number() OVER (ORDER BY id DESC) AS rn
FROM (SELECT id FROM poisoned WHERE status IN ('PENDING', 'SHIPPED', 'DELIVERED')
      ORDER BY id DESC LIMIT 400)"""
_TAKE = ("b.id IS NOT NULL AND o.status = 'PENDING_RECONCILE' "
         "AND json_extract_string(o.payload, '$.reconcile_batch') = 'RECONCILE-BATCH-2026-08-28'")
VIEWS["remediated"] = f"""
SELECT o.id, o.customer_id, o.sku, o.qty, o.amount_cents,
       CASE WHEN {_TAKE} THEN b.status ELSE o.status END AS status,
       CASE WHEN {_TAKE} THEN b.created_at ELSE o.created_at END AS created_at,
       CASE WHEN {_TAKE} THEN b.payload ELSE o.payload END AS payload
FROM poisoned o LEFT JOIN poison_backup b ON o.id = b.id"""


def _victims(spark, sf):
    """W1's victims, written once: their choice reads two columns of ``orders``."""
    return written_table(lc.choose_victims(b.shop_orders(spark, sf)), "victims")


def _poisoned(spark, sf, victims=None):
    orders = b.shop_orders(spark, sf)
    return lc.inject_fault(orders, lc.choose_victims(orders) if victims is None else victims)


def _poisoned_and_backup(spark, sf):
    """Poisoned orders and the written backup table of the victims' rows.

    The backup is built from the victims' orders and lines alone, so the orders
    are read once more only to be rewritten, never copied whole.
    """
    victims = _victims(spark, sf)
    backup = lc.backup_rows(b.shop_orders(spark, sf, victims), victims)
    return _poisoned(spark, sf, victims), written_table(backup, "poison-backup")


@register("s1_customers_typed_scan", "S1", oracle="SELECT * FROM customers_raw")
def s1_customers(spark, sf):
    return b.customers_raw(spark, sf)


@register("a1_order_health", "A1", bench=True, oracle=f"""
SELECT status, count(*) AS row_count, min(created_at) AS oldest, max(created_at) AS newest,
       count(*) FILTER (WHERE {pg_typeof('payload')} <> 'array') AS malformed_payloads
FROM poisoned GROUP BY status""")
def a1_order_health(spark, sf):
    return pl.order_health(_poisoned(spark, sf))


@register("a1_order_health_clean", "A1", oracle=f"""
SELECT status, count(*) AS row_count, min(created_at) AS oldest, max(created_at) AS newest,
       count(*) FILTER (WHERE {pg_typeof('payload')} <> 'array') AS malformed_payloads
FROM shop_orders GROUP BY status""")
def a1_order_health_clean(spark, sf):
    return pl.order_health(b.shop_orders(spark, sf))


@register("w1_victims", "W1", oracle="SELECT id, rn FROM victims")
def w1_victims(spark, sf):
    return lc.choose_victims(b.shop_orders(spark, sf)).withColumn("rn", F.col("rn").cast("long"))


@register("d1_inject_fault", ("D1", "P6"), bench=True, oracle="""
SELECT id, customer_id, sku, qty, amount_cents, status, created_at, payload,
       json_extract_string(payload, '$.reconcile_batch') AS reconcile_batch
FROM poisoned""")
def d1_inject_fault(spark, sf):
    return _poisoned(spark, sf).withColumn("reconcile_batch",
                                           F.get_json_object("payload", "$.reconcile_batch"))


@register("a2_injection_summary", "A2", oracle=f"""
SELECT 'poisoned' AS what, count(*) AS rows,
       count(*) FILTER (WHERE {pg_typeof('payload')} = 'string') AS shape_a_string_items,
       count(*) FILTER (WHERE {pg_typeof('payload')} = 'array') AS shape_b_missing_price,
       min(id) AS min_order_id, max(id) AS max_order_id
FROM poisoned WHERE status = 'PENDING_RECONCILE'""")
def a2_injection_summary(spark, sf):
    return pl.injection_summary(_poisoned(spark, sf))


@register("p6_batch_rows", "P6", oracle="""
SELECT id, status, created_at FROM poisoned
WHERE status = 'PENDING_RECONCILE'
  AND json_extract_string(payload, '$.reconcile_batch') = 'RECONCILE-BATCH-2026-08-28'""")
def p6_batch_rows(spark, sf):
    return _poisoned(spark, sf).where(lc.batch_predicate()).select("id", "status", "created_at")


@register("t1_classify_payload", "T1", bench=True, oracle="""
SELECT id, NULLIF(error_type, '') AS error_type, NULLIF(error_key, '') AS error_key, items_type,
       CASE WHEN code IS NULL THEN 'ok' WHEN items_type = 'string' THEN 'A'
            WHEN items_type = 'array' AND error_key = 'unit_price_cents' THEN 'B' ELSE 'other' END AS shape
FROM classified""")
def t1_classify_payload(spark, sf):
    return pl.classify_payload(_poisoned(spark, sf)) \
        .select("id", "error_type", "error_key", "items_type", "shape")


_GOOD_ITEMS = "CAST(json_extract(payload, '$.items[*]') AS JSON[])"


@register("t2_enrich_orders", ("T2", "Q8"), bench=True, oracle=f"""
SELECT id, customer_id, status, amount_cents,
       CAST(coalesce(list_sum(list_transform({_GOOD_ITEMS},
            lambda x: CAST(json_extract(x, '$.qty') AS DOUBLE)
                 * CAST(json_extract(x, '$.unit_price_cents') AS DOUBLE))), 0) AS DOUBLE)
           AS computed_total_cents,
       CAST(coalesce(list_sum(list_transform({_GOOD_ITEMS},
            lambda x: CAST(json_extract(x, '$.qty') AS DOUBLE)
                 * CAST(json_extract(x, '$.unit_price_cents') AS DOUBLE))), 0) AS DOUBLE) = amount_cents
           AS totals_match,
       json_extract_string(payload, '$.channel') AS channel,
       CAST(json_extract(payload, '$.shipping') AS VARCHAR) AS shipping,
       json_extract_string(payload, '$.shipping.method') AS shipping_method,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN strftime(created_at, '%f') = '000000' THEN '' ELSE '.' || strftime(created_at, '%f') END
           AS created_at_text,
       CAST(coalesce(len({_GOOD_ITEMS}), 0) AS INTEGER) AS n_lines
FROM classified WHERE code IS NULL""")
def t2_enrich_orders(spark, sf):
    good, _ = pl.enrich_orders(_poisoned(spark, sf))
    return good.select("id", "customer_id", "status", "amount_cents", "computed_total_cents",
                       "totals_match", "channel", "shipping", "shipping_method", "created_at_text",
                       F.size("lines").alias("n_lines"))


@register("t2_quarantine", "T2", oracle="""
SELECT id, status, error_type, error_key FROM classified WHERE code IS NOT NULL""")
def t2_quarantine(spark, sf):
    _, bad = pl.enrich_orders(_poisoned(spark, sf))
    return bad.select("id", "status", "error_type", "error_key")


@register("t3_explode_lines", "T3", oracle=f"""
SELECT id, CAST(i - 1 AS INTEGER) AS line_no,
       json_extract_string(xs[i], '$.sku') AS sku,
       CAST(json_extract(xs[i], '$.qty') AS DOUBLE) AS qty,
       CAST(json_extract(xs[i], '$.unit_price_cents') AS DOUBLE) AS unit_price_cents,
       CAST(json_extract(xs[i], '$.qty') AS DOUBLE)
           * CAST(json_extract(xs[i], '$.unit_price_cents') AS DOUBLE) AS line_total_cents
FROM (SELECT id, xs, unnest(range(1, len(xs) + 1)) AS i
      FROM (SELECT id, {_GOOD_ITEMS} AS xs FROM classified WHERE code IS NULL))""")
def t3_explode_lines(spark, sf):
    good, _ = pl.enrich_orders(_poisoned(spark, sf))
    return pl.explode_lines(good)


@register("a11_error_taxonomy", "A11", oracle="""
SELECT error_type, error_key, count(*) AS errors,
       first(id ORDER BY created_at DESC, id DESC) AS newest_id,
       max(created_at) AS newest_at, '/orders' AS path
FROM classified WHERE code IS NOT NULL GROUP BY error_type, error_key""")
def a11_error_taxonomy(spark, sf):
    return pl.error_taxonomy(_poisoned(spark, sf))


@register("w7_recent_errors", "W7", oracle="""
SELECT error_type, rank, id, error_key, created_at FROM (
  SELECT error_type, row_number() OVER (PARTITION BY error_type ORDER BY created_at DESC, id DESC) AS rank,
         id, error_key, created_at
  FROM classified WHERE code IS NOT NULL) WHERE rank <= 10""")
def w7_recent_errors(spark, sf):
    return pl.recent_errors(_poisoned(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@register("w10_page_blast_radius", "W10", oracle="""
WITH numbered AS (
  SELECT code IS NOT NULL AS bad, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n
  FROM classified),
pages AS (SELECT CAST(floor((n - 1) / 25) AS BIGINT) AS page, bool_or(bad) AS fails
          FROM numbered GROUP BY 1)
SELECT count(*) AS pages, count(*) FILTER (WHERE fails) AS failing_pages,
       min(page) FILTER (WHERE fails) AS first_failing_page FROM pages""")
def w10_page_blast_radius(spark, sf):
    return pl.page_blast_radius(_poisoned(spark, sf))


@register("w9_payments", ("W9", "G3"), oracle="SELECT * FROM payments")
def w9_payments(spark, sf):
    return b.payments(spark, sf)


@register("j3_backup_rows", ("J3", "D2"), oracle="SELECT * FROM poison_backup")
def j3_backup_rows(spark, sf):
    return _poisoned_and_backup(spark, sf)[1]


@register("j4_insert_absent", "J4", oracle=f"""
WITH new AS (
  SELECT id, status, payload, created_at, TIMESTAMP '2026-08-28 09:00:00' AS backed_up_at
  FROM poisoned WHERE id IN (SELECT id FROM victims UNION ALL SELECT id FROM victims2))
SELECT * FROM poison_backup
UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM poison_backup)""")
def j4_insert_absent(spark, sf):
    poisoned, backup = _poisoned_and_backup(spark, sf)
    # Re-running the injection on the poisoned table must not clobber the backup.
    rerun = lc.choose_victims(poisoned).select("id").unionByName(backup.select("id"))
    return lc.insert_absent(backup, lc.backup_rows(poisoned, rerun))


@register("j1_remediate", ("J1", "D3"), bench=True, oracle="SELECT * FROM remediated")
def j1_remediate(spark, sf):
    poisoned, backup = _poisoned_and_backup(spark, sf)
    return lc.remediate(poisoned, backup)


@register("j2_undo_all", "J2", oracle="""
SELECT o.id, o.customer_id, o.sku, o.qty, o.amount_cents,
       coalesce(b.status, o.status) AS status, coalesce(b.created_at, o.created_at) AS created_at,
       coalesce(b.payload, o.payload) AS payload
FROM poisoned o LEFT JOIN poison_backup b ON o.id = b.id""")
def j2_undo_all(spark, sf):
    poisoned, backup = _poisoned_and_backup(spark, sf)
    return lc.remediate(poisoned, backup, batch_id=None)


@register("j12_backup_coverage", "J12", oracle="""
SELECT count(*) AS bad_rows, count(b.id) AS with_backup, count(*) = count(b.id) AS fully_covered
FROM poisoned o LEFT JOIN poison_backup b ON o.id = b.id
WHERE o.status = 'PENDING_RECONCILE'
  AND json_extract_string(o.payload, '$.reconcile_batch') = 'RECONCILE-BATCH-2026-08-28'""")
def j12_backup_coverage(spark, sf):
    poisoned, backup = _poisoned_and_backup(spark, sf)
    return lc.backup_coverage(poisoned, backup)


@register("d3_repair_report", "D3", oracle="""
SELECT count(*) FILTER (WHERE status = 'PENDING_RECONCILE') AS remaining, count(*) AS rows,
       count(*) FILTER (WHERE status = 'PENDING_RECONCILE') = 0 AS ok
FROM remediated""")
def d3_repair_report(spark, sf):
    poisoned, backup = _poisoned_and_backup(spark, sf)
    return lc.repair_report(poisoned, backup)


@register("x2_restore_equality", "X2", oracle="""
SELECT (SELECT count(*) FROM (SELECT * FROM shop_orders EXCEPT ALL SELECT * FROM remediated)) AS missing,
       (SELECT count(*) FROM (SELECT * FROM remediated EXCEPT ALL SELECT * FROM shop_orders)) AS extra,
       (SELECT count(*) FROM (SELECT * FROM shop_orders EXCEPT ALL SELECT * FROM remediated)) = 0
       AND (SELECT count(*) FROM (SELECT * FROM remediated EXCEPT ALL SELECT * FROM shop_orders)) = 0
           AS equal""")
def x2_restore_equality(spark, sf):
    poisoned, backup = _poisoned_and_backup(spark, sf)
    return lc.multiset_diff(lc.remediate(poisoned, backup), b.shop_orders(spark, sf))


@register("x2_poisoned_vs_snapshot", "X2", oracle="""
SELECT (SELECT count(*) FROM (SELECT * FROM shop_orders EXCEPT ALL SELECT * FROM poisoned)) AS missing,
       (SELECT count(*) FROM (SELECT * FROM poisoned EXCEPT ALL SELECT * FROM shop_orders)) AS extra,
       false AS equal""")
def x2_poisoned_vs_snapshot(spark, sf):
    return lc.multiset_diff(_poisoned(spark, sf), b.shop_orders(spark, sf))


@register("a4_restore_summary", ("A4", "X3"), oracle="""
SELECT (SELECT count(*) FROM customers_raw) AS customers, (SELECT count(*) FROM remediated) AS orders,
       (SELECT count(*) FROM payments) AS payments,
       (SELECT count(*) FROM remediated WHERE status = 'PENDING_RECONCILE') AS poisoned_rows_remaining""")
def a4_restore_summary(spark, sf):
    poisoned, backup = _poisoned_and_backup(spark, sf)
    return lc.restore_summary(b.customers_raw(spark, sf), lc.remediate(poisoned, backup),
                              b.paid_orders(b.shop_orders(spark, sf)))
