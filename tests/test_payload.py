"""The payload contract check against a brute-force Python model."""

import json

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopguard.operators.payload import classify_payload, enrich_orders
from shopguard.plans.shop import payload_error_sql


def _num(x):
    return isinstance(x, (int, float))  # bool is an int in Python


def model_error(text):
    """What the order service raises while enriching ``text`` (None = ok)."""
    if text is None:
        payload = None
    else:
        try:
            payload = json.loads(text)
        except ValueError:
            return ("ValueError", "payload")
    payload = payload or {}
    if not isinstance(payload, dict):
        return ("TypeError", "payload")
    if "items" not in payload:
        return ("KeyError", "items")
    items = payload["items"]
    if not isinstance(items, (list, str, dict)):
        return ("TypeError", "items")
    for item in items:
        if not isinstance(item, dict):
            return ("TypeError", "qty")
        if "qty" not in item:
            return ("KeyError", "qty")
        if "unit_price_cents" not in item:
            return ("KeyError", "unit_price_cents")
        qty, unit = item["qty"], item["unit_price_cents"]
        if not (_num(qty) and _num(unit)):
            return ("TypeError", "qty" if not _num(qty) else "unit_price_cents")
        if "sku" not in item:
            return ("KeyError", "sku")
    return None


# The literal rows of the T1 rule table.
RULE_ROWS = [
    None, "{}", "[]", '""', "0", "false", "null", '{"a": 1}', "[1]", '"x"', "5", "true",
    '{"items": null}', '{"items": 3}', '{"items": true}', '{"items": ""}', '{"items": []}',
    '{"items": {}}', '{"items": "RECONCILE"}', '{"items": {"a": 1}}', '{"items": [1]}',
    '{"items": [{"sku": "a", "unit_price_cents": 1}]}', '{"items": [{"sku": "a", "qty": 1}]}',
    '{"items": [{"sku": "a", "qty": null, "unit_price_cents": 1}]}',
    '{"items": [{"sku": "a", "qty": "2", "unit_price_cents": 1}]}',
    '{"items": [{"sku": "a", "qty": 2, "unit_price_cents": [1]}]}',
    '{"items": [{"qty": 2, "unit_price_cents": 1}]}',
    '{"items": [{"sku": "a", "qty": 2, "unit_price_cents": 1}, "x"]}',
    '{"items": [{"sku": "a", "qty": 2.5, "unit_price_cents": true}]}', "not json", "0.0", "{",
]


def _spark_errors(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, payload string")
    rows = classify_payload(df).select("id", "error_type", "error_key").collect()
    return {r["id"]: (None if r["error_type"] is None else (r["error_type"], r["error_key"])) for r in rows}


def _sql_errors(texts):
    con = duckdb.connect()
    out = {}
    for i, t in enumerate(texts):
        code = con.execute(f"SELECT {payload_error_sql('p')} FROM (SELECT CAST(? AS VARCHAR) AS p)", [t]).fetchone()[0]
        out[i] = None if code is None else tuple(code.split(":"))
    return out


def test_rule_table_rows(spark):
    got = _spark_errors(spark, RULE_ROWS)
    for i, t in enumerate(RULE_ROWS):
        assert got[i] == model_error(t), t


def test_oracle_sql_agrees_on_rule_rows():
    valid = [t for t in RULE_ROWS if t is not None]
    got = _sql_errors(valid)
    for i, t in enumerate(valid):
        assert got[i] == model_error(t), t


keys = st.sampled_from(["items", "qty", "unit_price_cents", "sku", "x"])
scalars = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.floats(-2, 2, allow_nan=False),
                    st.sampled_from(["", "a", "P-1"]))
json_values = st.recursive(scalars, lambda inner: st.one_of(
    st.lists(inner, max_size=3), st.dictionaries(keys, inner, max_size=4)), max_leaves=12)
item = st.fixed_dictionaries({}, optional={"sku": scalars, "qty": scalars, "unit_price_cents": scalars})
payloads = st.one_of(json_values, st.fixed_dictionaries({"items": st.one_of(st.lists(item, max_size=3), json_values)}))


@settings(max_examples=3, deadline=None)
@given(st.lists(payloads.map(json.dumps), min_size=50, max_size=120))
def test_generated_payloads_match_model(spark, texts):
    got = _spark_errors(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == model_error(t), t


def test_enrichment_totals(spark):
    texts = ['{"items": [{"sku": "a", "qty": 2, "unit_price_cents": 150}, {"sku": "b", "qty": 1, "unit_price_cents": 5}],'
             ' "channel": "web", "shipping": {"method": "express"}}', '{"items": ""}', '{"items": "x"}']
    df = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(zip(texts, [305, 1, 0]))],
                               "id long, payload string, amount_cents long")
    good, bad = enrich_orders(df)
    g = {r["id"]: r for r in good.collect()}
    assert g[0]["computed_total_cents"] == 305 and g[0]["totals_match"] and g[0]["shipping_method"] == "express"
    assert g[1]["computed_total_cents"] == 0 and not g[1]["totals_match"] and g[1]["lines"] == []
    assert [r["id"] for r in bad.collect()] == [2]
    assert [r.line_total_cents for r in g[0]["lines"]] == [300, 5]


def test_classification_is_computed_once(spark):
    """A filter on the result must not copy the classification into the scan side."""
    df = spark.createDataFrame([(1, '{"items": "x"}')], "id long, payload string")
    plan = classify_payload(df).where(F.col("error_type").isNotNull())._jdf.queryExecution() \
        .optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("schema_of_variant" in line for line in filters)
