"""Oracle SQL: the table bindings restated as DuckDB common table expressions.

``with_views(body)`` prefixes a query with every binding it names (and their
dependencies), so each oracle query is a single self-contained statement over
the driver's raw views.
"""

from __future__ import annotations

import re

from shopguard import ANCHOR


def pg_typeof(expr: str, path: str = "$.items") -> str:
    """DuckDB form of ``jsonb_typeof(expr -> key)`` (NULL when the key is missing)."""
    t = f"json_type({expr}, '{path}')"
    return (f"(CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 'ARRAY' THEN 'array' "
            f"WHEN {t} = 'OBJECT' THEN 'object' WHEN {t} = 'VARCHAR' THEN 'string' "
            f"WHEN {t} = 'NULL' THEN 'null' WHEN {t} = 'BOOLEAN' THEN 'boolean' ELSE 'number' END)")


_QTY = "CAST(l_quantity AS INTEGER)"
_PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT)"
# A total order of an order's lines (the same as Spark's struct sort): line
# number, part, supplier, then sku, quantity and price break remaining ties.
_LINE_ORDER = f"ORDER BY l_linenumber, l_partkey, l_suppkey, 'P-' || l_partkey, {_QTY}, {_PRICE}"

VIEWS: dict[str, str] = {}
VIEWS["customers_raw"] = """
SELECT c_custkey AS id, c_name AS name,
       lower(replace(c_name, '#', '.')) || '@example.com' AS email,
       '+1-555-' || lpad(CAST(c_custkey % 100 + 100 AS VARCHAR), 3, '0') || '-'
                 || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
       TIMESTAMP '1994-01-01 00:00:00' AS created_at,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'platinum' WHEN 'BUILDING' THEN 'gold'
            WHEN 'FURNITURE' THEN 'silver' ELSE 'standard' END AS tier
FROM customer"""
VIEWS["order_lines"] = f"""
SELECT l_orderkey AS id,
       '[' || string_agg('{{"sku":"P-' || l_partkey || '","qty":' || {_QTY}
                         || ',"unit_price_cents":' || {_PRICE} || '}}', ',' {_LINE_ORDER}) || ']' AS items,
       CAST(sum({_QTY} * {_PRICE}) AS BIGINT) AS lines_total,
       first('P-' || l_partkey {_LINE_ORDER}) AS first_sku,
       first({_QTY} {_LINE_ORDER}) AS first_qty
FROM lineitem GROUP BY l_orderkey"""
VIEWS["shop_orders"] = """
SELECT o.o_orderkey AS id, o.o_custkey AS customer_id, coalesce(l.first_sku, 'P-0') AS sku,
       coalesce(l.first_qty, 1) AS qty,
       CAST(coalesce(l.lines_total, 0) + CASE WHEN o.o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS BIGINT)
           AS amount_cents,
       CASE WHEN o.o_orderstatus = 'F' THEN 'DELIVERED' WHEN o.o_orderstatus = 'O' THEN 'SHIPPED'
            WHEN o.o_orderkey % 4 = 0 THEN 'CANCELLED' WHEN o.o_orderkey % 4 = 1 THEN 'REFUNDED'
            ELSE 'PENDING' END AS status,
       o.o_orderdate AS created_at,
       '{"schema":2,"channel":"web","items":' || coalesce(l.items, '[]')
           || ',"shipping":{"method":"standard"},"promo":null}' AS payload
FROM orders o LEFT JOIN order_lines l ON o.o_orderkey = l.id"""
VIEWS["payments"] = """
SELECT row_number() OVER (ORDER BY id) AS id, id AS order_id,
       lpad(CAST(row_number() OVER (ORDER BY id) % 10000 AS VARCHAR), 4, '0') AS last4,
       'stripe_' || lpad(CAST(id AS VARCHAR), 8, '0') || lpad(CAST(id % 900 + 100 AS VARCHAR), 3, '0')
           AS processor_ref,
       amount_cents
FROM shop_orders WHERE status IN ('DELIVERED', 'SHIPPED', 'REFUNDED')"""
VIEWS["victims"] = """
SELECT id, row_number() OVER (ORDER BY id DESC) AS rn
FROM (SELECT id FROM shop_orders WHERE status IN ('PENDING', 'SHIPPED', 'DELIVERED')
      ORDER BY id DESC LIMIT 400)"""
VIEWS["poisoned"] = f"""
SELECT o.id, o.customer_id, o.sku, o.qty, o.amount_cents,
       CASE WHEN v.rn IS NULL THEN o.status ELSE 'PENDING_RECONCILE' END AS status,
       CASE WHEN v.rn IS NULL THEN o.created_at
            ELSE TIMESTAMP '{ANCHOR}' - to_seconds(v.rn * 3) END AS created_at,
       CASE WHEN v.rn IS NULL THEN o.payload ELSE
         '{{"schema":2,"channel":"partner-api","items":'
         || CASE WHEN v.rn <= 300 THEN '"RECONCILE-BATCH-2026-08-28-A"'
                 ELSE '[' || CAST(json_object('sku', o.sku, 'qty', o.qty) AS VARCHAR) || ']' END
         || ',"shipping":' || coalesce(CAST(json_extract(o.payload, '$.shipping') AS VARCHAR), 'null')
         || ',"reconcile_batch":"RECONCILE-BATCH-2026-08-28","reconcile_source":"payments-migration-v2"}}'
       END AS payload
FROM shop_orders o LEFT JOIN victims v ON o.id = v.id"""
VIEWS["poison_backup"] = f"""
SELECT o.id, o.status, o.payload, o.created_at, TIMESTAMP '{ANCHOR}' AS backed_up_at
FROM shop_orders o JOIN victims v ON o.id = v.id"""


def _deps(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs it references, dependencies first."""
    order: list[str] = []

    def visit(name: str, seen: tuple = ()):
        if name in order or name in seen:
            return
        for d in _deps(VIEWS[name]):
            if d != name:
                visit(d, seen + (name,))
        order.append(name)

    for n in _deps(body):
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
