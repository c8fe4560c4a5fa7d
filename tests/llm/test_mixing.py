"""Mixing: Poisson inversion, target shares, edge rows."""

import math

from shopguard.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy int, mix_key string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 9, "k", 1) for d, t, s in rows], SCHEMA)


def test_thresholds_invert_the_distribution(spark):
    df = spark.createDataFrame([(0.01,), (1.0,), (7.5,), (16.0,)], "m double")
    for m, t in df.select("m", mixing.poisson_thresholds(df["m"])).collect():
        p = c = math.exp(-m)
        for k in range(mixing.STEPS):
            assert abs(t[k] - c * mixing.UNIT) <= 16
            p *= m / (k + 1)
            c += p
        # Spread draws evenly: mean and variance are those of the distribution.
        us = [(i + 0.5) / 4000 * mixing.UNIT for i in range(4000)]
        xs = [sum(x <= u for x in t) for u in us]
        mean = sum(xs) / len(xs)
        var = sum((x - mean) ** 2 for x in xs) / len(xs)
        assert abs(mean - m) < 0.01 * m + 0.01 and abs(var - m) < 0.03 * m + 0.01


def test_target_shares(spark):
    rows = [(i, "t", "big" if i % 10 else "small") for i in range(20000)]
    out = mixing.mix(frame(spark, rows), {"small": 3.0}, total=20000, seed=7)
    by = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(by["small"] - 15000) < 5 * math.sqrt(15000) and abs(by["big"] - 5000) < 5 * math.sqrt(5000)


def test_high_rates_are_sums_of_pieces(spark):
    rows = [(i, "t", "a" if i < 100 else "b") for i in range(10000)]
    out = mixing.mix(frame(spark, rows), {"b": 0.0}, total=10000)
    n = out.count()
    assert out.where("source = 'b'").count() == 0 and abs(n - 10000) < 500
    assert out.select("doc_id", "copy").distinct().count() == n


def test_order_is_global_and_repeatable(spark):
    df = frame(spark, [(i, "t", f"s{i % 5}") for i in range(3000)])
    a = [(r.mix_key, r.doc_id, r.copy) for r in mixing.mix(df).collect()]
    b = [(r.mix_key, r.doc_id, r.copy) for r in mixing.mix(df.repartition(7)).collect()]
    assert a == b == sorted(a)
    ids = [x[1] for x in a]
    assert abs(sum(ids[:len(ids) // 2]) / (len(ids) // 2) - 1500) < 120       # no trace of the input order


def test_edge_rows(spark):
    df = frame(spark, [(1, None, None), (2, "", None), (3, "x" * 200000, "s"), (3, "x" * 200000, "s"),
                       (None, "y", "s"), (None, "z", "null"), (7, "w", "=s")])
    out = mixing.mix(df, total=70)
    assert out.columns == ["doc_id", "text", "source", "n", "copy", "mix_key"]
    assert {r.source for r in out.collect()} == {None, "s", "null", "=s"}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, {}, default_weight=0.0).count() == 0
