"""Registered queries: the shop generator sized by the driver tables.

The generator draws from MD5 digits, which both engines compute alike, so the
oracles restate every draw.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shopguard import ANCHOR
from shopguard.operators import generate as gen
from shopguard.plans.catalog import register
from shopguard.plans.sql import VIEWS
from shopguard.sources.tables import load_table

SEED = 1337


def _h(salt: str, key: str) -> str:
    return f"('0x' || substr(md5({key} || ':{SEED}:{salt}'), 1, 15))::BIGINT"


def _int(salt: str, lo: int, hi: int | str, key: str = "id") -> str:
    return f"({_h(salt, key)} % (({hi}) - {lo} + 1) + {lo})"


def _pick(salt: str, values, key: str = "id") -> str:
    lits = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{lits}])[{_h(salt, key)} % {len(values)} + 1]"


def _weighted(salt: str, pairs) -> str:
    out, upto = [], 0
    for value, w in pairs:
        upto += w
        out.append(f"WHEN {_int(salt, 1, sum(x for _, x in pairs))} <= {upto} THEN "
                   + (f"'{value}'" if isinstance(value, str) else str(value)))
    return "CASE " + " ".join(out) + " END"


def _unit(salt: str) -> str:
    return f"(({_h(salt, 'id')} % {1 << 40}) / {float(1 << 40)!r})"


def _ago(days: str, secs: str) -> str:
    return f"TIMESTAMP '{ANCHOR}' - to_days(CAST({days} AS INTEGER)) - to_seconds({secs})"


def _line(tag: str, qty: str) -> str:
    part = lambda k: _pick(tag + "line", [p[k] for p in gen.PRODUCT_LINES])
    price = f"({part(1)} + {_h(tag + 'price', 'id')} % ({part(2)} - {part(1)} + 1))"
    return (f"{{'sku': {part(0)} || '-' || {_int(tag + 'sku', 1000, 9999)}, 'qty': CAST({qty} AS BIGINT), "
            f"'unit_price_cents': CAST({price} AS BIGINT)}}")


VIEWS["generated_orders"] = f"""
SELECT id, customer_id, items[1].sku AS sku, CAST(items[1].qty AS INTEGER) AS qty,
       CAST(list_sum(list_transform(items, lambda x: x.qty * x.unit_price_cents)) AS BIGINT) AS amount_cents,
       status, created_at,
       '{{"schema":2,"channel":"' || channel || '","items":[' || array_to_string(list_transform(items, lambda x:
           '{{"sku":"' || x.sku || '","qty":' || x.qty || ',"unit_price_cents":' || x.unit_price_cents || '}}'), ',')
       || '],"shipping":{{"method":"' || method || '","country":"' || country || '"}},"promo":null}}' AS payload
FROM (SELECT id, CASE WHEN {_unit('hot')} < {gen.HOT_SHARE} THEN {_int('hotc', 1, 'greatest(1, c // 10)')}
                      ELSE {_int('cust', 1, 'c')} END AS customer_id,
             CASE WHEN {_unit('multi')} < {gen.MULTI_LINE_SHARE}
                  THEN [{_line('a', _weighted('qty', gen.QTY_WEIGHTS))}, {_line('b', _pick('qty2', (1, 1, 2)))}]
                  ELSE [{_line('a', _weighted('qty', gen.QTY_WEIGHTS))}] END AS items,
             {_weighted('status', gen.STATUS_WEIGHTS)} AS status,
             {_ago(_int('odays', 0, gen.WINDOW_DAYS - 1), _int('osecs', 0, 86399))} AS created_at,
             {_weighted('channel', gen.CHANNEL_WEIGHTS)} AS channel, {_pick('ship', gen.SHIP_METHODS)} AS method,
             {_pick('country', gen.COUNTRIES)} AS country
      FROM (SELECT o_orderkey + 1 AS id, (SELECT count(*) FROM customer) AS c FROM orders))"""


def _customer_ids(spark, sf):
    return load_table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id"))


def _orders(spark, sf):
    n_customers = load_table(spark, sf, "customer").count()
    ids = load_table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("id"))
    return gen.generate_orders(ids, n_customers, SEED)


@register("g1_generate_customers", "G1", oracle=f"""
SELECT id, {_pick('first', gen.FIRST_NAMES)} || ' ' || {_pick('last', gen.LAST_NAMES)} AS name,
       lower({_pick('first', gen.FIRST_NAMES)}) || '.' || lower({_pick('last', gen.LAST_NAMES)}) || id || '@'
           || {_pick('domain', gen.EMAIL_DOMAINS)} AS email,
       '+1-555-' || {_int('ph1', 100, 199)} || '-' || lpad(CAST({_int('ph2', 0, 9999)} AS VARCHAR), 4, '0') AS phone,
       {_ago(_int('days', gen.WINDOW_DAYS, 2 * gen.WINDOW_DAYS), _int('secs', 0, 86399))} AS created_at,
       {_weighted('tier', gen.TIER_WEIGHTS)} AS tier
FROM (SELECT c_custkey + 1 AS id FROM customer)""")
def g1_generate_customers(spark, sf):
    return gen.generate_customers(_customer_ids(spark, sf), SEED)


@register("g2_generate_orders", "G2", oracle="SELECT * FROM generated_orders")
def g2_generate_orders(spark, sf):
    return _orders(spark, sf)


@register("g3_generate_payments", ("G3", "W9"), oracle=f"""
SELECT row_number() OVER (ORDER BY id) AS id, id AS order_id,
       lpad(CAST({_int('last4', 0, 9999)} AS VARCHAR), 4, '0') AS last4,
       {_pick('proc', gen.PROCESSORS)} || '_' || lpad(CAST(id AS VARCHAR), 8, '0') || {_int('ref', 100, 999)} AS processor_ref,
       amount_cents
FROM generated_orders WHERE status IN ('DELIVERED', 'SHIPPED', 'REFUNDED')""")
def g3_generate_payments(spark, sf):
    return gen.generate_payments(_orders(spark, sf), SEED)
