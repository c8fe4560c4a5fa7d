"""Hard-negative mining against brute force."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shopguard.llm import negatives
from shopguard.llm.negatives import Cluster, _directions, _angles

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, cell int, block int"


def brute(rows, every=100, n_pos=5, n_neg=10):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
              if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in usable:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, y)), (v, y))
    out = []
    for a, (av, ay) in anchors.items():
        scored = sorted((-sum(x * z for x, z in zip(av, v)), i, y) for i, v, y in usable if i != a)
        for p_neg, pid, _ in [s for s in scored if s[2] == ay][:n_pos]:
            p = -p_neg
            fit = [(i, -s) for s, i, y in scored if y != ay and 30 * p <= 100 * -s <= 90 * p][:n_neg]
            out += [(a, pid, k + 1, i, p, s) for k, (i, s) in enumerate(fit)]
    return sorted(out)


def result(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
                  for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 1, 1, 1) for i, v, y in rows], SCHEMA)


def test_random_vectors_over_many_cells_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PROBE", 60)
    monkeypatch.setattr(negatives, "TOGETHER", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 10))
    data = []
    for i in range(900):
        v = centres[rng.integers(6)] * rng.choice([0.1, 1, 2]) + rng.normal(size=10) * 0.4
        data.append((i, v.astype(np.float32).tolist(), int(rng.integers(4))))
    want = brute(data, every=9)
    assert len({r[0] for r in want}) > 80
    assert result(negatives.mine(frame(spark, data), every=9, block=50, cluster=7)) == want


def test_table_of_the_fixture(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in
            spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert result(negatives.mine(frame(spark, rows))) == brute(rows)


def test_ties_repeats_and_unusable_rows(spark):
    same = [0.5, 0.25, -1.0]
    near = [0.4, 0.2, -0.6]
    data = [(i, same, i % 2) for i in range(0, 60)] + [(i, near, i % 3) for i in range(60, 120)]
    data += [(200, same, 1), (200, near, 1), (200, same, 1), (300, None, 1), (400, same, None), (None, same, 1),
             (500, [None, 1.0, 0.0], 1), (600, [float("nan"), 0.0, 0.0], 0), (700, [float("inf"), 0.0, 0.0], 0),
             (800, [0.0, 0.0, 0.0], 1), (900, [], 0), (1000, [-0.5, -0.25, 1.0], 2), (1100, [0.5], 1), (61, near, 0)]
    assert result(negatives.mine(frame(spark, data), block=16, cluster=2)) == brute(data)


def test_a_third_of_the_rows_is_one_vector(spark, monkeypatch):
    monkeypatch.setattr(negatives, "PROBE", 40)
    rng = np.random.default_rng(8)
    hot = rng.normal(size=6).astype(np.float32).tolist()
    data = [(i, hot if i % 3 == 0 else rng.normal(size=6).astype(np.float32).tolist(), i % 5) for i in range(600)]
    assert result(negatives.mine(frame(spark, data), every=30, block=32, cluster=4)) == brute(data, every=30)


def test_empty_tables(spark):
    assert result(negatives.mine(frame(spark, []))) == []
    assert result(negatives.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]))) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=1, max_size=8),
       st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=1, max_size=20))
def test_bound_holds_for_every_member(anchors, candidates):
    class Row:
        n, dim = len(anchors), 3
        ids = labels = np.zeros(len(anchors), "<i8").tobytes()
        data = np.array(anchors, "<i8").tobytes()

    cluster = Cluster(Row)
    units, norms = _directions(np.array(candidates))
    bound = cluster.bounds(norms, _angles(units, cluster.centre))
    for b, v in zip(bound.tolist(), candidates):
        assert (cluster.reach(b) >= np.array(anchors) @ np.array(v)).all()
