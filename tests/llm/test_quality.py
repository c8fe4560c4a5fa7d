"""Quality classifier: held-out accuracy, shrinkage against plain numpy, edge rows."""

import numpy as np

from shopguard.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n long, s double, host string, logit double"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality.score(docs, train).join(held, "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in out]) > 0.97
    good = [r.kept for r in out if r.quality == 1]
    assert np.mean(good) > 0.99


def test_site_posteriors_match_numpy(spark):
    """The grouped aggregation of the hierarchy, with each document left out of its own site."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    meta = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    rows = quality.score(docs, labels).collect()
    p = {r.doc_id: r.p_text for r in rows}
    hosts, paths = {}, {}
    for d, (h, l) in meta.items():
        hosts.setdefault(h, []).append(p[d])
        paths.setdefault((h, l), []).append(p[d])
    prior = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups, about):
        n = np.array([len(g) for g in groups])
        m = np.array([np.mean(g) for g in groups])
        v = about * (1 - about)
        between = max((np.sum(n * (m - about) ** 2) - np.sum(v)) / n.sum(), 1e-9)
        return min(max(np.sum(n * v) / n.sum() / between - 1, 1), 1e6)

    hk = strength(list(hosts.values()), np.full(len(hosts), prior))
    shrunk = np.array([(sum(hosts[h]) + hk * prior) / (len(hosts[h]) + hk) for h, _ in paths])
    pk = strength(list(paths.values()), shrunk)
    for r in rows:
        h, l = meta[r.doc_id]
        host = (sum(hosts[h]) - p[r.doc_id] + hk * prior) / (len(hosts[h]) - 1 + hk)
        path = (sum(paths[h, l]) - p[r.doc_id] + pk * host) / (len(paths[h, l]) - 1 + pk)
        assert abs(r.p_host - host) < 1e-5 and abs(r.p_path - path) < 1e-5


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = spark.createDataFrame([("big", "a", 0.9)] * 500 + [("bad", "a", 0.1)] * 500 + [("tiny", "a", 0.1)],
                                 "host string, path string, p_text double")
    sites, k = quality.site_posteriors(rows)
    got = {r.host: (r.host_s + k["host_k"] * k["prior"]) / (r.host_n + k["host_k"]) for r in sites.collect()}
    assert got["big"] > 0.85 and got["bad"] < 0.15 and abs(got["tiny"] - k["prior"]) < abs(0.1 - k["prior"])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, l, s, 1, 1.0, "h", 0.5) for d, t, l, s in rows], SCHEMA)


def test_edge_rows(spark):
    good = " ".join(f"word{i} next" for i in range(60))
    bad = "### ### " * 40
    rows = [(i, good + str(i), "en", "a") for i in range(40)] + [(100 + i, bad, "en", "a") for i in range(40)] + \
        [(200, None, None, None), (201, "", "en", None), (202, good * 400, "en", "a"), (None, good, "en", "b"),
         (None, bad, "en", "b"), (203, bad, "de", "a"), (203, bad, "de", "a")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
                                   + [(5, None, None), (None, 1, 0), (6, 7, 0), (7, 1, 0)], LABELS)
    df = frame(spark, rows)
    out = quality.score(df, labels).collect()
    assert len(out) == len(rows)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert {d for d, _ in ids} >= {*range(40), 202, None} and not {d for d, _ in ids} & {*range(100, 140), 203}
    assert (None, good) in ids and (None, bad) not in ids
    assert quality.score(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == len(rows)      # nothing known: nothing rejected
    assert quality.keep_good(df, labels.where("quality = 1")).count() == len(rows)
