"""Benchmark decontamination against every window compared with every place."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from small_documents import documents  # noqa: F401

from shopguard.llm import decontaminate
from shopguard.llm.decontaminate import ItemAutomaton, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id long, n_words int, __n int, spans string"
ITEMS = "item_id long, text string, doc_id long, window int"


def brute_one(words, items, window=10):
    """(hit positions, item ids) of one document."""
    hit, named = set(), set()
    for name, item in items:
        m = min(window, len(item))
        for i in range(len(item) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j:j + m] == item[i:i + m]:
                    hit.update(range(j, j + m))
                    if name is not None:
                        named.add(str(name))
    return hit, named


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    coded = [(n, split(t)) for n, t in items]
    out = []
    for d, t in docs:
        words = split(t)
        hit, named = brute_one(words, coded, window)
        out.append((d, len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(),
                    bool(hit)))
    return sorted(out, key=repr)


def result(spark, docs, items, window=10):
    found = decontaminate.find_contamination(spark.createDataFrame([(d, t, 1, 1, 1, "x") for d, t in docs], DOCS),
                                             spark.createDataFrame([(i, t, 1, 1) for i, t in items], ITEMS), window)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                   for r in decontaminate.digest(found).collect()), key=repr)


small = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(small, max_size=5), small, st.integers(1, 5))
def test_automaton_finds_every_window(items, words, window):
    named = [(str(i), w) for i, w in enumerate(items)]
    runs, found, longest = ItemAutomaton(named, window).stream(words)
    hit, names = brute_one(words, named, window)
    assert {p for a, b in runs for p in range(a, b)} == hit and found == names
    ends = {j + min(window, len(item)) for item in items for j in range(len(words)) for i in range(len(item))
            if i + min(window, len(item)) <= len(item)
            and words[j:j + min(window, len(item))] == item[i:i + min(window, len(item))]}
    best = max((n for item in items for n in range(1, len(item) + 1) for i in range(len(item) - n + 1)
                for j in range(len(words) - n + 1) if j + n in ends and words[j:j + n] == item[i:i + n]), default=0)
    assert longest == best


def test_words_are_those_of_the_pattern():
    text = "Äb-C9_ΣKK x\x00y \U0001f600z.É"
    assert [w.decode() for w in words_of(text.encode())] == split(text)


def test_documents_of_the_fixture(spark, documents):  # noqa: F811
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in documents][:120]
    rows = brute(docs, items)
    assert any(r[-1] for r in rows) and not all(r[-1] for r in rows)
    assert result(spark, docs, items) == rows


LONG = " ".join(random.Random(3).choices([f"w{i}" for i in range(40)], k=60_000))
EDGE_DOCS = [(1, None), (2, ""), (3, "...!"), (4, "One two THREE four five six seven eight nine ten eleven"),
             (5, "x one two three x"), (5, "x one two three x"), (None, "one two three"), (6, "solo"), (7, LONG),
             (8, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten")]
EDGE_ITEMS = [(1, None), (2, ""), (3, "one, two; three"), (3, "one, two; three"), (4, "Solo!"),
              (5, "zero one two three four five six seven eight nine ten"), (None, "two three x"),
              (6, " ".join(LONG.split()[40_000:40_030])), (10, " ".join(LONG.split()[5:30]))]


def test_edge_rows(spark):
    assert result(spark, EDGE_DOCS, EDGE_ITEMS) == brute(EDGE_DOCS, EDGE_ITEMS)


def test_many_automata_and_pieces_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    monkeypatch.setattr(decontaminate, "PASS_SHARDS", 2)
    docs = EDGE_DOCS[:6] + EDGE_DOCS[9:] + [(7, " ".join(LONG.split()[40_000:40_050]))]
    assert result(spark, docs, EDGE_ITEMS) == brute(docs, EDGE_ITEMS)


def test_empty_tables(spark):
    assert result(spark, [], EDGE_ITEMS) == []
    assert result(spark, EDGE_DOCS[:6], []) == brute(EDGE_DOCS[:6], [])


def test_removal_by_length_and_coverage(spark):
    item = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12"
    docs = [(1, f"Before. {item.upper()}! After it all stays as it was, more words than the item has in it"),
            (2, "short one b1 b2 b3 and then many other words that are not hit"), (3, "B1, b2 b3."), (4, None)]
    frame = spark.createDataFrame([(d, t, 7, 8, 9, "kept") for d, t in docs], DOCS)
    items = spark.createDataFrame([(1, item, 0, 0), (2, "b1 b2 b3", 0, 0)], ITEMS)
    got = {r.doc_id: r for r in decontaminate.remove_contamination(frame, items, max_words=9, max_coverage=0.6).collect()}
    assert {d: r.text for d, r in got.items()} == {
        1: "Before. ! After it all stays as it was, more words than the item has in it", 2: docs[1][1], 3: ".", 4: None}
    assert got[1].spans == "kept" and got[1].__fields__ == frame.columns
    spans = {r.doc_id: (r.spans, r.longest) for r in decontaminate.find_contamination(frame, items).collect()}
    assert [(s.a, s.b) for s in spans[1][0]] == [(1, 13)] and spans[1][1] == 12
