"""A5, W2-W6, T9 on literal series."""

import datetime as dt

import pytest

from shopguard.operators import metrics as mt

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _samples(spark, points, metric="m", instance="i"):
    return spark.createDataFrame([(metric, instance, T0 + dt.timedelta(seconds=s), float(v)) for s, v in points],
                                 "metric string, instance string, ts timestamp_ntz, value double")


def test_rate_handles_resets(spark):
    # 60 s scrapes; the counter restarts between 120 s and 180 s.
    s = _samples(spark, [(0, 10), (60, 20), (120, 50), (180, 5), (240, 15)])
    rates = {r.eval_ts: r for r in mt.counter_rate(s, window_s=120, step_s=60).collect()}
    at = lambda sec: rates[T0 + dt.timedelta(seconds=sec)]
    assert at(60).increase == 10 and at(60).rate == pytest.approx(10 / 120)
    assert at(180).increase == 5 and at(180).samples == 2  # window (60, 180]: 50 -> 5 is a reset
    assert at(240).increase == 10  # (120, 240]: only 5 -> 15 is inside
    assert at(0).rate is None  # one sample only


def test_extrapolated_rate_matches_promql_rule(spark):
    # Samples at 10 s steps inside a 60 s window ending at 60: 10..60 values 1..6.
    s = _samples(spark, [(10 * k, k) for k in range(1, 7)])
    r = {x.eval_ts: x for x in mt.counter_rate(s, window_s=60, step_s=60, extrapolate=True).collect()}
    row = r[T0 + dt.timedelta(seconds=60)]
    # sampled 50 s, avg gap 10 s; start gap 10 s (< 11 s) -> extend fully, but the
    # zero point (first value 1 at slope 5/50) is 10 s back: same; end gap 0.
    assert row.rate == pytest.approx(5 * (60 / 50) / 60)


def test_alert_state_machine(spark):
    vals = [(0, 0.01), (60, 0.2), (120, 0.3), (180, 0.2), (240, 0.01), (300, 0.5)]
    df = spark.createDataFrame([("r", T0 + dt.timedelta(seconds=s), v) for s, v in vals] +
                               [("r", T0 + dt.timedelta(seconds=420), 0.6)],
                               "rule string, eval_ts timestamp_ntz, value double")
    states = {r.eval_ts: r.state for r in mt.alert_states(df, 0.05, 60, 60).collect()}
    seq = [states[T0 + dt.timedelta(seconds=s)] for s in range(0, 480, 60)]
    # 360 has no data: counts as OK and resets the pending clock.
    assert seq == ["inactive", "pending", "firing", "firing", "inactive", "pending", "inactive", "pending"]
    eps = mt.alert_episodes(mt.alert_states(df, 0.05, 60, 60), 60).orderBy("started_at").collect()
    assert [(e.evaluations, e.firing_at is not None) for e in eps] == [(3, True), (1, False), (1, False)]


def test_error_state_and_interval_bound(spark):
    df = spark.createDataFrame([("r", T0, 0.9, None), ("r", T0 + dt.timedelta(seconds=60), None, "boom")],
                               "rule string, eval_ts timestamp_ntz, value double, error string")
    assert [r.state for r in mt.alert_states(df).orderBy("eval_ts").collect()] == ["pending", "error"]
    with pytest.raises(ValueError):
        mt.alert_states(df, interval_s=5)


def test_reduce_last_drops_nan(spark):
    df = spark.createDataFrame([("m", T0, 1.0), ("m", T0 + dt.timedelta(seconds=60), float("nan"))],
                               "metric string, eval_ts timestamp_ntz, value double")
    got = {r.eval_ts: r.value for r in mt.reduce_last(df, 600, 60).collect()}
    assert got[T0 + dt.timedelta(seconds=60)] == 1.0


def test_request_counters_and_classes(spark):
    log = spark.createDataFrame([(T0, "a", 200), (T0, "a", 302), (T0, "a", 404), (T0, "a", 503)],
                                "ts timestamp_ntz, instance string, status_code int")
    (row,) = mt.request_counters(log, "15 seconds").collect()
    assert (row.total, row.ok_2xx, row.client_4xx, row.server_5xx, row.ratio) == (4, 2, 1, 1, 0.25)


def test_keep_list_is_anchored(spark):
    df = spark.createDataFrame([("up",), ("upx",), ("orders_total",), ("http_5xx_ratio_x",)], "metric string")
    assert [r.metric for r in mt.keep_series(df).collect()] == ["up", "orders_total"]


def test_previous_sample_across_blocks(spark):
    from pyspark.sql import functions as F

    pts = [(0, 1), (50, 2), (400, 3), (401, 4), (1300, 5)]
    s = _samples(spark, pts).withColumn("ts_s", F.unix_seconds(F.col("ts").cast("timestamp")))
    got = {r.value: (r.prev_v, r.prev_s) for r in mt.with_previous(s, ["metric", "instance"], block_s=100).collect()}
    assert got == {1.0: (None, None), 2.0: (1.0, 1704067200), 3.0: (2.0, 1704067250),
                   4.0: (3.0, 1704067600), 5.0: (4.0, 1704067601)}


def test_ratio_formats_like_python(spark):
    """The 5xx ratio is printed as f"{rate:.4f}": ties go by the exact binary value."""
    from pyspark.sql import functions as F

    from shopguard.operators.metrics import fixed, fixed_text

    pairs = [(139, 800), (1, 32), (215, 800), (500, 3200), (84, 1920), (348, 384), (1, 3), (0, 7), (7, 7)]
    df = spark.createDataFrame(pairs, "e long, t long")
    x = F.col("e") / F.col("t")
    rows = df.select("e", "t", fixed_text(x, 4).alias("s"), fixed(x, 4).alias("d")).collect()
    for r in rows:
        assert r.s == f"{r.e / r.t:.4f}", r
        assert r.d == float(f"{r.e / r.t:.4f}"), r
