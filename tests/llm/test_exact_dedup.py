"""Exact dedup against a dictionary of normalised texts."""

import hashlib
import string

from pyspark.sql import functions as F

from small_documents import documents  # noqa: F401

from shopguard.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        first = True
        for d in ids:
            kept = d == keep and first
            first = first and not kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


EDGE = [(1, None), (2, ""), (3, "A"), (4, "a"), (5, "Ä"), (6, "ä"), (7, "x" * 300000), (8, "X" * 300000),
        (9, "tie"), (9, "tie"), (9, "tie"), (None, "tie"), (None, "none"), (None, "none"), (9, "other")]


def frame(spark, rows):
    """Extra columns carry the names the operator itself uses."""
    return spark.createDataFrame([(d, t, "n", "d", 5) for d, t in rows],
                                 "doc_id long, text string, norm string, digest string, salt int")


def test_matches_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents]
    assert result(exact_dedup.assign_groups(spark.createDataFrame(documents))) == brute(rows)


def test_edge_rows(spark):
    df = frame(spark, EDGE)
    assert result(exact_dedup.assign_groups(df)) == brute(EDGE)
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.deduplicate(df).collect()), key=repr)
    want = sorted({(None, "none"), (9, "tie"), (9, "other"), (2, ""), (4, "a"), (5, "Ä"), (6, "ä"),
                   (8, "X" * 300000)}, key=repr)
    assert kept == want and exact_dedup.deduplicate(df).columns == df.columns
    assert exact_dedup.assign_groups(df.limit(0)).count() == 0
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_a_weak_digest_never_merges_different_texts(spark, documents):
    """Full content is compared at every stage: a one-byte digest changes nothing."""
    rows = [(r.doc_id, r.text) for r in documents] + EDGE
    weak = exact_dedup.assign_groups(frame(spark, rows), salts=3,
                                     digest=lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1)))
    assert result(weak) == brute(rows)


def test_hot_group_over_many_partitions(spark):
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(6000)]
    df = frame(spark, rows).repartition(16)
    assert result(exact_dedup.assign_groups(df)) == brute(rows)


def test_a_row_without_an_equal_is_not_marked(spark, documents, monkeypatch):
    """Every row with an equal is marked, and a map of few bits, marked by chance, changes no result."""
    rows = [(r.doc_id, r.text) for r in documents] + EDGE
    df = frame(spark, rows)
    sizes = {}
    for _, t in rows:
        n = (t or "").translate(LOWER)
        sizes[n] = sizes.get(n, 0) + 1
    marked = {(r.text or "").translate(LOWER): r["__marked"] for r in exact_dedup._marked(df, F.col("text")).collect()}
    assert marked == {n: size > 1 or n in ("Ä", "ä") for n, size in sizes.items()}
    want = sorted(map(repr, exact_dedup.deduplicate(df).collect()))
    monkeypatch.setattr(exact_dedup, "MARK_BITS", 7)
    assert result(exact_dedup.assign_groups(df)) == brute(rows)
    assert sorted(map(repr, exact_dedup.deduplicate(df).collect())) == want
