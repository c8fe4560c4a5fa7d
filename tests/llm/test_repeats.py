"""Repeat removal against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
import pytest

from small_documents import documents  # noqa: F401

from shopguard.llm import repeats

SCHEMA = "doc_id long, text string, g long, start int, m int"


def brute(texts, length):
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1, 1, 1) for d, t in rows], SCHEMA).repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
                  repeats.digest(repeats.remove_repeats(df, **kw)).collect()), key=repr)
    want = brute([(t or "").encode() for _, t in rows], kw.get("length", repeats.LENGTH))
    assert got == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=repr)


def prose(rng, n):
    return "".join(rng.choice("abcdefghé ") for _ in range(n))


def test_documents(spark, documents):
    check(spark, [(r.doc_id, r.text) for r in documents])


def test_covered_against_brute_force():
    rng = random.Random(1)
    for trial in range(120):
        length = rng.choice([8, 12, 20])
        base = bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(60))
        parts = []
        for _ in range(rng.randint(1, 7)):
            a, b = sorted((rng.randint(0, 60), rng.randint(0, 60)))
            parts.append(bytes(rng.choice(b"\0bc") for _ in range(rng.randint(0, 30))) + base[a:b]
                         + bytes(rng.choice(b"\0bc") for _ in range(rng.randint(1, 30))))
        got = [np.zeros(len(p), bool) for p in parts]
        for k, a, b in repeats.covered(parts, length):
            got[k][a:b] = True
        assert [int(g.sum()) for g in got] == [w[1] for w in brute(parts, length)]


def test_maximal_repeats_have_all_occurrences():
    parts = [b"xxABCDEFGHIJyy", b"zzABCDEFGHIJww", b"qqABCDEFGHkkkk", b"AB"]
    x = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    owner = np.repeat(np.arange(4), [len(p) for p in parts])
    room = ends[owner] - np.arange(len(x))
    order, ranks = repeats.suffix_array(x, room)
    lcp = repeats.common_prefixes(order, ranks, room)
    before = np.concatenate([[-3], x[:-1].astype(np.int64)])
    found = {(x[order[a]:order[a] + n].tobytes(), b - a + 1) for n, a, b in
             repeats.maximal_repeats(order, lcp, before, 6)}
    assert found == {(b"ABCDEFGHIJ", 2), (b"ABCDEFGH", 3)}


@pytest.mark.parametrize("limit", [128, 2])
def test_edges_of_a_passage_in_many_documents(spark, limit):
    """A group far over the limit is dealt again until it fits; nothing is lost."""
    rng = random.Random(6)
    passage = prose(rng, 90)
    rows = [(i, prose(rng, rng.randint(0, 60)) + passage[rng.choice([0, 0, 5]):] + prose(rng, rng.randint(0, 60)))
            for i in range(160)]
    check(spark, rows, length=40, gram=8, group_limit=limit)


def test_edge_rows(spark):
    rng = random.Random(7)
    text = prose(rng, 900)
    rows = [(1, None), (2, ""), (3, "a" * 3000), (4, "ab" * 700 + "c"), (5, text), (5, text), (5, text[:500]),
            (None, text[100:600]), (None, "unique " + prose(rng, 500)), (9, "short"), (9, "short"),
            (10, prose(rng, 60000)), (11, text[:399]), (12, prose(rng, 20) + text[200:599] + prose(rng, 450))]
    check(spark, rows)
    df = spark.createDataFrame([], SCHEMA)
    assert repeats.digest(repeats.remove_repeats(df)).count() == 0


def test_pieces_of_a_long_text(monkeypatch):
    """Cutting a long text into pieces changes no window's gram."""
    rng = random.Random(8)
    raw = prose(rng, 5000).encode()
    whole = {s + i: (g, o - i) for s, n, o, g, _ in repeats.segments(raw, 100, 16) for i in range(n)}
    monkeypatch.setattr(repeats, "PIECE", 333)
    cut = {s + i: (g, o - i) for s, n, o, g, _ in repeats.segments(raw, 100, 16) for i in range(n)}
    assert whole == cut and len(cut) == len(raw) - 99


def test_rows_without_an_id_whose_texts_share_a_32_bit_hash(spark):
    rng = random.Random(9)
    passage, seen = prose(rng, 440), {}
    for i in range(400_000):
        text = f"{i:x} {passage}"
        other = seen.setdefault(xxhash.xxh32_intdigest(text.encode(), 1), text)
        if other != text:
            break
    assert other != text
    check(spark, [(None, text), (None, other + prose(rng, 60)), (None, other), (1, "z" * 390), (None, prose(rng, 900))])


def test_a_third_of_the_rows_repeats_one_id_and_text(spark):
    rng = random.Random(10)
    hot, shared = prose(rng, 700), prose(rng, 100)
    rows = [(1, hot)] * 60 + [(None, hot)] * 30 + [(i, prose(rng, 150) + shared + hot[i:i + 60] + prose(rng, 80)) for i in range(2, 120)]
    check(spark, rows, length=40, gram=8, group_limit=16)
