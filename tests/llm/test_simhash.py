"""SimHash near-dedup against brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from small_documents import documents  # noqa: F401

from shopguard.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node int"


def brute(texts, shingle=3, max_bits=3):
    """{id: (hex fingerprint, component)} of (id, text) pairs, by comparing every pair."""
    fps = []
    for _, text in texts:
        words = bytes((text or "").encode()).lower().split()
        grams = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
        fps.append(sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hashes) * 2 > len(hashes)))
    codes = np.array(fps, dtype=np.uint64)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= max_bits):
            parent[find(int(j))] = find(i)
    low = {}
    for i, (d, _) in enumerate(texts):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(texts)]


def rows(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


@pytest.mark.parametrize("limit", [4096, 64])
def test_matches_brute_force(spark, documents, limit):
    docs = spark.createDataFrame(documents)
    got = rows(simhash.assign_components(docs, bucket_limit=limit))
    assert got == sorted(brute([(r.doc_id, r.text) for r in documents]))


def test_dense_group_beyond_the_bucket_limit(spark):
    """Many near-identical codes: buckets are dealt again and again, components stay exact."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 63))
    codes = {base}
    while len(codes) < 600:
        code = base
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            code ^= 1 << int(b)
        codes.add(code)
    codes = np.array(sorted(codes), dtype=np.uint64)
    df = spark.createDataFrame([(int(c), i) for i, c in enumerate(codes.view(np.int64))], "fp long, node long")
    from shopguard.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(df, bucket_limit=150)).collect()}
    want = np.arange(len(codes))
    for _ in range(50):
        for i in range(len(codes)):
            near = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 3)
            want[near] = want[near].min()
    assert [got.get(i, i) for i in range(len(codes))] == want.tolist()


def test_local_links_skip_nothing():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 12, 300).astype(np.uint64)
    codes = np.unique(codes)
    rep = simhash.local_links(codes, np.zeros(len(codes), np.uint64), 1)
    # One component exactly where a chain of one-bit steps joins two codes.
    want = np.arange(len(codes))
    for _ in range(40):
        for i in range(len(codes)):
            near = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 1)
            want[near] = want[near].min()
    for i in range(len(codes)):
        for j in range(len(codes)):
            assert (rep[i] == rep[j]) == (want[i] == want[j])


def test_edge_rows(spark):
    long_text = "word " * 60000
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, long_text), (6, long_text),
            (None, "one two"), (None, "nobody else has this text at all"), (9, "É é a"), (10, "é é a")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], SCHEMA)
    got = {}
    for r in simhash.assign_components(df).collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert len(got[6]) == 2 and got[6][0] == got[6][1]
    assert got[1] == got[2] == got[3] == [("0" * 16, 1)]
    assert got[4] == got[5] and got[4][0][1] == 4
    assert sorted(x[1] is None for x in got[None]) == [False, True]
    assert got[9][0][0] != got[10][0][0]            # only A-Z is lower-cased
    kept = sorted((r.doc_id or 0) for r in simhash.keep_representatives(df).collect())
    assert kept == [0, 1, 4, 6, 9, 10] and simhash.keep_representatives(df).columns == df.columns
    assert simhash.assign_components(df.limit(0)).count() == 0


def near(text, n):
    """Texts whose fingerprints differ from that of ``text`` by 1 to 3 bits each, and their codes."""
    base = simhash.fingerprint(text.encode())
    out, words = [], text.split()
    for i in range(len(words)):
        t = " ".join([*words[:i], f"w{i}x", *words[i + 1:]])
        if 1 <= (simhash.fingerprint(t.encode()) ^ base).bit_count() <= 3:
            out.append(t)
    assert len(out) >= n
    return out


def test_repeated_ids_with_other_texts_lose_no_row(spark):
    data = [(1, "x y z one"), (5, "x y z one"), (5, "nothing like the other text"), (5, "nothing like the other text")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], SCHEMA)
    got = sorted((r.doc_id, r.component_id) for r in simhash.assign_components(df).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (5, 5)]
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_representatives(df).collect())
    assert kept == [(1, "x y z one"), (5, "nothing like the other text")]


def test_rows_without_an_id_bridge_others(spark):
    text = " ".join(f"word{i}" for i in range(400))
    base = simhash.fingerprint(text.encode())
    ends = near(text, 2)
    codes = [simhash.fingerprint(t.encode()) for t in ends]
    a, b = next((i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() > 3)
    df = spark.createDataFrame([(7, ends[a], "x", 1), (None, text, "x", 1), (3, ends[b], "x", 1)], SCHEMA)
    got = {r.fingerprint: r.component_id for r in simhash.assign_components(df).collect()}
    assert got == {f"{codes[a]:016x}": 3, f"{base:016x}": 3, f"{codes[b]:016x}": 3}
    assert [r.doc_id for r in simhash.keep_representatives(df).collect()] == [3]
