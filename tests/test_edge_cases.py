"""Rows that once vanished or changed without a word: each case stays in the result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopguard.operators import audit as au
from shopguard.operators import metrics as mt
from shopguard.operators import payload as pl
from shopguard.operators import policy as pol
from shopguard.session import checkpoint_dir, scratch_path
from shopguard.sources import metrics as ms
from shopguard.sources import text as tx

T0 = dt.datetime(2024, 1, 1)


def _values(spark, rows):
    return spark.createDataFrame([(r, T0 + dt.timedelta(seconds=s), v) for r, s, v in rows],
                                 "rule string, eval_ts timestamp_ntz, value double")


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_evaluations_off_the_grid_count(spark, block):
    df = _values(spark, [("r", 0, 0.01), ("r", 61, 0.9), ("r", 121, 0.9), ("r", 181, 0.9), ("r", 420, 0.9),
                         (None, 0, 0.9), (None, 59, 0.9), (None, 130, 0.9)])
    out = mt.alert_states(df, 0.05, 60, 60, block=block).orderBy("eval_ts").collect()
    states = [(int((r.eval_ts - T0).total_seconds()), r.state) for r in out if r.rule == "r"]
    # Three evaluations without data stand between 181 s and 420 s.
    assert states == [(0, "inactive"), (61, "pending"), (121, "firing"), (181, "firing"), (241, "inactive"),
                      (301, "inactive"), (361, "inactive"), (420, "pending")]
    assert [r.state for r in out if r.rule is None] == ["pending", "pending", "firing"]


def test_series_with_a_null_label(spark):
    rows = [("m", i, T0 + dt.timedelta(seconds=60 * n), float(n)) for i in (None, "i") for n in range(5)]
    df = spark.createDataFrame(rows, "metric string, instance string, ts timestamp_ntz, value double")
    rates = mt.counter_rate(df, 120, 60).where("rate IS NOT NULL")
    assert {r["instance"]: r["n"] for r in rates.groupBy("instance").agg(F.count(F.lit(1)).alias("n")).collect()} \
        == {None: 4, "i": 4}


def test_lines_without_a_file(spark):
    df = spark.createDataFrame([(f, n, t) for f in (None, "f") for n, t in enumerate(["aq-1 x", " a", "aq-2 y"])],
                               "file string, line_no long, line string")
    assert tx.segment_records(df, block=2).groupBy("file").count().orderBy("file").collect()[0]["count"] == 2


def test_a_record_without_an_end_leaves_in_parts(spark):
    df = spark.range(30_001).select(F.lit("f").alias("file"), F.col("id").alias("line_no"),
                                    F.when(F.col("id") == 1, "aq-1 x").otherwise(F.concat(F.lit(" "), "id")).alias("line"))
    parts = tx.segment_records(df, block=500, part_lines=1000).collect()
    assert sorted(r.part for r in parts) == list(range(30)) and {r.record_id for r in parts} == {"aq-1"}
    assert max(r.text.count("\n") for r in parts) == 999
    whole = tx.whole_records(tx.segment_records(df, block=500, part_lines=1000)).first()
    assert whole.text == "\n".join(["aq-1 x", *(f" {i}" for i in range(2, 30_001))])


def test_load_counters_come_out_of_the_loading_pass(spark):
    path = scratch_path(spark, "audit-lines")
    spark.createDataFrame([('{"id":"q-1"}',), ('{"id":',), ('{"other":1}',)], "value string").write.text(path)
    records, seen = tx.load_counted_audit(spark, path)
    assert seen == {"lines": 3, "malformed": 1} and [r.id for r in records.collect()] == ["q-1"]
    docs = spark.createDataFrame([(1, '[{"id":1},{"id":2}]'), (2, "{broken"), (3, '{"id":3}'), (4, None)], "k long, doc string")
    flat, seen = tx.flatten_counted_audit(docs)
    assert seen == {"documents": 4, "unparsable": 1} and sorted(r.k for r in flat.collect()) == [1, 1, 3]


def test_csv_keeps_blanks(spark):
    df = spark.createDataFrame([(1, "  lead"), (2, "trail  "), (3, 'q"uo,te'), (4, "")], "id long, t string")
    path = scratch_path(spark, "blanks")
    tx.write_csv(df, path)
    back = tx.load_csv(spark, path, df.schema)
    assert {r.id: r.t or "" for r in back.collect()} == {1: "  lead", 2: "trail  ", 3: 'q"uo,te', 4: ""}
    assert tx.csv_row_count(back).first()["rows"] == 4
    tx.write_csv_with_header(df, path)
    assert "1,  lead" in [r.value for r in spark.read.text(path).collect()]


def test_unparsable_documents_have_no_records(spark):
    df = spark.createDataFrame([(1, '[{"id":1},{"id":2}]'), (2, "{broken"), (3, '{"id":3}'), (4, None)], "k long, doc string")
    assert sorted(r.k for r in tx.flatten_audit(df).collect()) == [1, 1, 3]
    assert tx.unparsable(df).first()[:] == (4, 1)


def test_fractional_quantities(spark):
    item = '{"sku":"a","qty":%s,"unit_price_cents":%s}'
    df = spark.createDataFrame([(1, 15, '{"items":[' + item % ("1.5", "10") + "]}"), (2, 30, '{"items":[' + item % ("3", "10") + "]}"),
                                (3, 10, '{"items":[' + item % ("true", "10") + "]}")],
                               "id long, amount_cents long, payload string") \
        .withColumn("status", F.lit("SHIPPED")).withColumn("created_at", F.lit(T0))
    good, _ = pl.enrich_orders(df)
    got = {r.id: (r.computed_total_cents, r.totals_match) for r in good.collect()}
    assert got == {1: (15.0, True), 2: (30.0, True), 3: (10.0, True)}


def test_carriage_return_hides_no_statement(spark):
    df = spark.createDataFrame([("SELECT 1;\rDROP TABLE x",), ("SELECT 1;\u0085DROP TABLE x",), ("SELECT 1; \t",),
                                ("SELECT 1;\nSELECT 2;",)], "query_body string")
    out = au.classify_statements(df, "x").collect()
    assert [r.multi_statement for r in out] == [True, True, False, False]


def test_identical_statements_stay_apart(spark):
    ts = T0 + dt.timedelta(minutes=5)
    st = spark.createDataFrame([("a", "r", ts, {"k": "v"})] * 2 + [("b", "r", ts, {})],
                               "principal_id string, resource_id string, ts timestamp_ntz, tags map<string,string>")
    grants = spark.createDataFrame([("a", "r", T0), ("a", "r", T0 + dt.timedelta(minutes=2)), ("b", "r", ts + dt.timedelta(1))],
                                   "principal_id string, resource_id string, granted_at timestamp_ntz")
    out = sorted((r.principal_id, r.covered, r.grant_at) for r in pol.covered_by_grant(st, grants).collect())
    assert out == [("a", True, T0), ("a", True, T0), ("b", False, None)]


def test_tag_rules_of_every_size(spark):
    rules = spark.createDataFrame([(0, "one", None, {"env": "prod"}), (1, "two", None, {"env": "prod", "kind": "db"}),
                                   (2, "all", None, {}), (3, "id", ["r3"], None)],
                                  "rule_id int, role string, ids array<string>, tags map<string,string>")
    res = spark.createDataFrame([("r1", {"env": "prod", "kind": "db"}), ("r2", {"env": "prod"}), ("r3", {})],
                                "resource_id string, resource_tags map<string,string>")
    members = spark.createDataFrame([(r, r) for r in ("one", "two", "all", "id")], "principal_id string, role string")
    got = {(r.principal_id, r.resource_id) for r in pol.entitlements(members, rules, res).collect()}
    assert got == {("one", "r1"), ("one", "r2"), ("two", "r1"), ("all", "r1"), ("all", "r2"), ("all", "r3"), ("id", "r3")}


def test_exposition_labels_tell_series_apart(spark):
    lines = ["# HELP h x", "# TYPE h counter", 'h{code="200",path="/a b"} 5', 'h{code="500"} 2', "up 1", "", "h_bad NaNx"]
    df = spark.createDataFrame([("s", "i", T0, n, x) for n, x in enumerate(lines)],
                               "scrape_id string, instance string, ts timestamp_ntz, line_no int, line string")
    got = {(r.metric, tuple(sorted(r.labels.items()))): (r.type, r.value) for r in ms.parse_exposition(df).collect()}
    assert got[("h", (("code", "200"), ("path", "/a b")))] == ("counter", 5.0)
    assert got[("h", (("code", "500"),))] == ("counter", 2.0) and got[("up", ())] == ("untyped", 1.0)


def test_scratch_folder_needs_a_local_master():
    class Conf:
        def get(self, *_):
            return None

    class Remote:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        checkpoint_dir(Remote())


def test_json_exports_hold_all_customers(spark):
    from conftest import SMALL
    from shopguard.plans import catalog

    n = spark.read.parquet(f"{SMALL}/customer.parquet").count()
    pages = catalog.queries()["s7_json_array_pages"](spark, SMALL)
    sizes = [r.n for r in pages.select(F.expr("json_array_length(json)").alias("n")).collect()]
    assert sum(sizes) == n > 100 and max(sizes) <= 100
    assert catalog.queries()["s7_ndjson_roundtrip"](spark, SMALL).count() == n
