"""R1-R7 equal their batch forms; G1-G3 keep the seed's distributions."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from shopguard.operators import generate as gen
from shopguard.operators import metrics as mt
from shopguard.session import scratch_path
from shopguard.streaming import monitors as mon

T0 = dt.datetime(2024, 1, 1)


def _stream_of(spark, df, name):
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return mon.read_stream(spark, path, spark.read.parquet(path).schema)


def _evaluations(vals, rule="r"):
    return [(rule, T0 + dt.timedelta(seconds=s), v) for s, v in vals]


EVALS = "rule string, eval_ts timestamp_ntz, value double"


def _alert_rows(df):
    return sorted((r.rule, r.eval_ts, r.value, r.breach, r.state) for r in df.collect())


def test_alert_stream_equals_batch_with_gaps(spark):
    vals = [(0, 0.01), (60, 0.2), (120, 0.3), (240, 0.4), (300, 0.5), (360, 0.01), (420, 0.9)]
    df = spark.createDataFrame(_evaluations(vals), EVALS)
    batch = {(r.eval_ts, r.state) for r in mt.alert_states(df, 0.05, 60, 60).collect()}
    out = mon.run_available_now(mon.alert_state_stream(_stream_of(spark, df, "alert-in"), 0.05, 60, 60, "0 seconds"), "t-r3")
    stream = {(r.eval_ts, r.state) for r in spark.read.parquet(out).collect()}
    assert stream == {x for x in batch if x[0] < T0 + dt.timedelta(seconds=420)} or stream == batch
    assert (T0 + dt.timedelta(seconds=180), "inactive") in stream  # the gap is a no-data evaluation


@pytest.mark.parametrize("seed", [1, 2])
def test_alert_stream_equals_batch_for_any_split(spark, seed):
    """Evaluations of two rules arrive shuffled (late by less than the watermark) over several files."""
    rng = random.Random(seed)
    rows = []
    for rule in ("a", "b"):
        t = 0
        for _ in range(40):
            t += rng.choice([60, 60, 60, 61, 180, 300])
            rows.append((rule, T0 + dt.timedelta(seconds=t), rng.choice([None, 0.01, 0.2, 0.2, 0.2])))
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.uniform(0, 290)))
    end = max(r[1] for r in rows) + dt.timedelta(hours=2)
    parts = [late[i:i + 20] for i in range(0, len(late), 20)] + [[("a", end, 0.0), ("b", end, 0.0)]]
    stream = mon.alert_state_stream(_batches(spark, parts, EVALS, "shuffled"), 0.05, 120, 60, delay="300 seconds")
    got = spark.read.parquet(mon.run_available_now(stream, "t-shuffled"))
    want = mt.alert_states(spark.createDataFrame([r for p in parts for r in p], EVALS), 0.05, 120, 60)
    cut = F.col("eval_ts") <= F.lit(max(r[1] for r in rows))
    norm = lambda d: [(a, b, None if c is None or c != c else c, e, f) for a, b, c, e, f in _alert_rows(d)]
    assert norm(got.where(cut)) == norm(want.where(cut).select("rule", "eval_ts", "value", "breach", "state"))
    assert {r.state for r in got.collect()} == {"inactive", "pending", "firing"}


def test_late_breaches_fire_as_in_batch(spark):
    parts = [_evaluations([(0, 0.9), (180, 0.9)]), _evaluations([(60, 0.9), (120, 0.9), (240, 0.9)]), _evaluations([(3000, 0.0)])]
    stream = mon.alert_state_stream(_batches(spark, parts, EVALS, "late-breaches"), 0.05, 60, 60)
    got = {r.eval_ts: r.state for r in spark.read.parquet(mon.run_available_now(stream, "t-late-breaches")).collect()}
    assert [got[T0 + dt.timedelta(seconds=s)] for s in (0, 60, 120, 180, 240, 300)] == [
        "pending", "firing", "firing", "firing", "firing", "inactive"]


def test_equal_samples_count_in_the_stream(spark):
    schema = "metric string, instance string, ts timestamp_ntz, value double"
    rows = [("m", "i", T0 + dt.timedelta(seconds=s), float(v)) for s, v in [(0, 10), (60, 20), (60, 20), (120, 25)]]
    df = spark.createDataFrame([*rows, ("m", "i", T0 + dt.timedelta(hours=3), 30.0)], schema)
    got = spark.read.parquet(mon.run_available_now(mon.counter_deltas(_stream_of(spark, df, "equal-samples")), "t-equal"))
    assert sorted((r.value, r.delta) for r in got.collect() if r.delta is not None) == [(20, 0), (20, 10), (25, 5)]


def test_two_sinks_of_one_stream_survive_a_replay(spark):
    from shopguard.plans.streams import _orders_stream
    from shopguard.plans.shop import _poisoned

    base = scratch_path(spark, "t-quarantine")
    tables = mon.run_quarantine(_orders_stream(spark, SMALL), base)
    before = [sorted(map(tuple, t.collect())) for t in tables]
    assert len(before[0]) == sum(r[2] for r in before[1]) > 0
    mon.quarantine_sink(base)(_poisoned(spark, SMALL), 0)          # the first batch once more
    assert [sorted(map(tuple, t.collect())) for t in mon.quarantine_tables(spark, base)] == before


def test_incident_runs_close_once(spark):
    schema = "account string, incident string, ts timestamp_ntz, d boolean, g boolean"
    at = lambda i, s, d=False, g=False: ("x", i, T0 + dt.timedelta(seconds=s), d, g)
    parts = [[at("1", 100, d=True), at("2", 50), at("3", 0, d=True)], [at("1", 90), at("1", 300, g=True), at("3", 5000, g=True)],
             [at("1", 400, d=True, g=True), at("2", 8000, d=True, g=True)], [at("9", 20000)], [at("9", 20001)]]
    stream = mon.incident_watch(_batches(spark, parts, schema, "runs"), ["d", "g"], timeout_s=3600, delay="7500 seconds")
    got = sorted((r.incident, r.opened_at, r.closed_at, r.complete) for r in
                 spark.read.parquet(mon.run_available_now(stream, "t-runs")).collect())
    s = lambda x: T0 + dt.timedelta(seconds=x)
    assert got == [("1", s(90), s(300), True), ("2", s(50), s(3650), False), ("3", s(0), s(3600), False)]


def test_update_mode_over_an_empty_input(spark):
    path = scratch_path(spark, "empty-input")
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(path))
    stream = mon.read_stream(spark, path, spark.createDataFrame([], "k string, ts timestamp_ntz").schema)
    counts = mon.with_event_time(stream).groupBy("k").count()
    assert spark.read.parquet(mon.run_available_now(counts, "t-empty", mode="update", keys=["k"])).count() == 0


def test_counter_delta_stream_equals_lag(spark):
    pts = [(0, 10), (60, 20), (120, 5), (180, 7)]
    df = spark.createDataFrame([("m", "i", T0 + dt.timedelta(seconds=s), float(v)) for s, v in pts],
                               "metric string, instance string, ts timestamp_ntz, value double")
    out = mon.run_available_now(mon.counter_deltas(_stream_of(spark, df, "samples-in"), delay="0 seconds"), "t-r2")
    got = [r.delta for r in spark.read.parquet(out).orderBy("ts").collect()]
    assert got == [None, 10.0, 5.0, 2.0]


def _batches(spark, rows, schema, name):
    """A stream that gets each list of rows as a micro-batch of its own."""
    path = scratch_path(spark, name)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)                # the file source orders files by their time
    return mon.read_stream(spark, path, spark.read.parquet(path).schema, max_files=1)


def test_counter_deltas_wait_for_late_samples(spark):
    schema = "metric string, instance string, ts timestamp_ntz, value double"
    at = lambda s, v, i="i": ("m", i, T0 + dt.timedelta(seconds=s), float(v))
    stream = _batches(spark, [[at(0, 10), at(120, 30)], [at(60, 15), at(180, 5)], [at(2000, 9)], [at(2100, 7, "j")],
                              [at(100, 99), at(4000, 1, "j")], [at(4100, 1, "j")]],
                      schema, "late-samples")
    out = spark.read.parquet(mon.run_available_now(mon.counter_deltas(stream, delay="5 minutes"), "t-late")).collect()
    got = sorted((r.ts, r.value, r.delta) for r in out if r.instance == "i")
    # The sample at 100 s comes behind the watermark; the one at 60 s came late but in time.
    assert [(v, d) for _, v, d in got] == [(10, None), (15, 5), (30, 15), (5, 5), (9, 4)]


def test_silent_rule_stays_inactive(spark):
    schema = "rule string, eval_ts timestamp_ntz, value double"
    at = lambda r, s, v: (r, T0 + dt.timedelta(seconds=s), v)
    stream = _batches(spark, [[at("a", 0, 0.9), at("a", 61, 0.9), at("b", 60, 0.0)], [at("b", 1200, 0.0)], [at("b", 2400, 0.0)]],
                      schema, "silent-rule")
    out = spark.read.parquet(mon.run_available_now(mon.alert_state_stream(stream, 0.05, 60, 60, delay="0 seconds"), "t-silent"))
    states = [(r.eval_ts, r.state) for r in out.where("rule = 'a'").orderBy("eval_ts").collect()]
    assert [s for _, s in states[:2]] == ["pending", "firing"]
    assert len(states) > 20 and {s for _, s in states[2:]} == {"inactive"}
    assert len({t for t, _ in states}) == len(states)


def test_updates_keep_the_latest_row_of_every_key(spark):
    schema = "k string, ts timestamp_ntz, v long"
    stream = _batches(spark, [[("a", T0, 1)], [("b", T0, 5), ("a", T0, 2)], [("c", T0, 1)]], schema, "updates")
    counts = mon.with_event_time(stream).groupBy("k").agg(F.sum("v").alias("v"))
    out = spark.read.parquet(mon.run_available_now(counts, "t-updates", mode="update", keys=["k"]))
    assert {r.k: r.v for r in out.collect()} == {"a": 3, "b": 5, "c": 1}


def test_request_counter_stream_only_emits_closed_windows(spark):
    from shopguard.sources import metrics as ms

    out = mon.run_available_now(mon.live_request_counters(ms.request_log_from(mon.stream_table(spark, SMALL, "events"))),
                                "t-r1")
    got = spark.read.parquet(out)
    last = spark.read.parquet(f"{SMALL}/events.parquet").agg(F.max("ts")).collect()[0][0]
    assert got.count() > 0
    assert got.agg(F.max("bucket_start")).collect()[0][0] + dt.timedelta(seconds=15) <= last - dt.timedelta(minutes=10)


@pytest.fixture(scope="module")
def generated(spark):
    ids = spark.range(1, 20001)
    customers = gen.generate_customers(ids.where("id <= 2000"))
    orders = gen.generate_orders(ids, 2000)
    return customers, orders


def _shares(df, col):
    n = df.count()
    return {r[col]: r["count"] / n for r in df.groupBy(col).count().collect()}


def test_generated_distributions(generated):
    customers, orders = generated
    tiers = _shares(customers, "tier")
    assert abs(tiers["standard"] - 0.62) < 0.04 and abs(tiers["platinum"] - 0.04) < 0.02
    status = _shares(orders, "status")
    assert abs(status["DELIVERED"] - 0.55) < 0.02 and abs(status["REFUNDED"] - 0.05) < 0.01
    qty = _shares(orders, "qty")
    assert abs(qty[1] - 0.62) < 0.02 and abs(qty[5] - 0.03) < 0.01
    hot = orders.where(F.col("customer_id") <= 200).count() / orders.count()
    assert 0.35 < hot < 0.45  # 35 % forced plus the uniform tail's 10 %
    multi = orders.where(F.size(F.from_json("payload", "struct<items:array<string>>")["items"]) == 2).count()
    assert abs(multi / orders.count() - 0.08) < 0.01
    assert customers.select(F.lower("email")).distinct().count() == customers.count()


def test_generated_amount_is_sum_of_lines(generated):
    _, orders = generated
    from shopguard.operators.payload import enrich_orders

    good, bad = enrich_orders(orders)
    assert bad.count() == 0 and good.where(~F.col("totals_match")).count() == 0


def test_generation_is_partitioning_independent(spark):
    a = gen.generate_orders(spark.range(1, 3001).repartition(1), 300)
    b = gen.generate_orders(spark.range(1, 3001).repartition(7), 300)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_generated_payments(spark, generated):
    _, orders = generated
    pays = gen.generate_payments(orders)
    paid = orders.where(F.col("status").isin("DELIVERED", "SHIPPED", "REFUNDED"))
    assert pays.count() == paid.count()
    ids = [r.id for r in pays.orderBy("order_id").select("id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    assert pays.where(~F.col("last4").rlike("^[0-9]{4}$")).count() == 0


def test_rule_state_first_match_and_absent(spark):
    from shopguard.operators.records import rule_state

    docs = spark.createDataFrame([
        (1, '{"data":{"groups":[{"rules":[{"name":"a","state":"firing"},{"name":"a","state":"inactive"}]},'
            '{"rules":[{"name":"b","state":null}]}]}}'),
        (2, '{"data":{"groups":[{"name":"g","rules":null},{"rules":[{"name":"a","state":"pending"}]}]}}'),
        (3, '{"data":{}}'),
        (4, "not json"),
    ], "doc_id long, doc string")
    got = {(r.doc_id, r.name): (r.state, r.exists) for r in rule_state(docs, ["a", "b"]).collect()}
    assert got == {(1, "a"): ("firing", True), (1, "b"): ("", True),
                   (2, "a"): ("pending", True), (2, "b"): ("", False),
                   (3, "a"): ("", False), (3, "b"): ("", False),
                   (4, "a"): ("", False), (4, "b"): ("", False)}
