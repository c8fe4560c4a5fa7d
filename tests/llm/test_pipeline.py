"""The pipeline against a plain Python version of its stages, on the smallest tables."""

import hashlib

import corpus_pipeline
from test_simhash import brute as simhash_brute

from shopguard.llm import mixing, quality
from shopguard.llm.common import read_table
from shopguard.llm.queries import MIX_SEED, MIX_WEIGHTS

SF = "/root/testdata/sf0.001"


def poisson(rate, u):
    """Inversion of a Poisson distribution at ``u`` in [0, 2^52)."""
    import math

    p = c = math.exp(-rate)
    k = 0
    while math.floor(c * mixing.UNIT) <= u and k < mixing.STEPS:
        k += 1
        p *= rate / k
        c += p
    return k


def test_run_matches_a_plain_version(spark):
    docs = read_table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, read_table(spark, SF, "labels")).where("kept").collect()}
    by_text = {}
    for d in sorted(good):
        by_text[rows[d].text.encode().lower()] = d            # the largest id stays
    kept = sorted(by_text.values())
    kept = [d for d, _, c in simhash_brute([(d, rows[d].text) for d in kept]) if d == c]
    sizes = {}
    for d in kept:
        sizes[rows[d].source] = sizes.get(rows[d].source, 0) + 1
    weights = {s: MIX_WEIGHTS.get(s, 1.0) for s in sizes}
    want = []
    for d in kept:
        s = rows[d].source
        rate = len(kept) / sum(weights.values()) * weights[s] / sizes[s]
        assert rate <= mixing.PIECE
        u = int(hashlib.md5(f"{MIX_SEED}:{d}:1".encode()).hexdigest()[:13], 16)
        want += [(d, hashlib.sha256(rows[d].text.encode()).hexdigest())] * poisson(rate, u)
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in out) == sorted(want)
    assert all(len(r.token_ids) == r.n_tokens for r in out)


def test_stages_keep_the_columns(spark):
    docs = read_table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_entry_serves_the_pipeline():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
