"""Cross-tokenizer alignment against a byte-by-byte version."""

import base64
import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from small_documents import documents  # noqa: F401

from shopguard.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, chunk int, row int, n_a string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    labels = {int(i): base64.b64decode(x) for x, i in map(bytes.split, lines)}
    return a, labels, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(text, libraries):
    a, labels, b = libraries
    if not text:
        return [], []
    left = [(i, labels[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows, libraries):
    seen = []
    for d, t in rows:
        a, b = map(spans, tokens(t, libraries))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for c in cuts:
            groups.append(([i for i, s, e in a if start < e <= c], [i for i, s, e in b if start < e <= c]))
            start = c
        owner_a = {k: i for i, s, e in a for k in range(s, e)}
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        assert len(owner_a) == (a[-1][2] if a else 0)
        seen.append((d, a, b, groups, links))
    count = Counter(x for *_, links in seen for x in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, a, b, groups, links in seen:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)
    got = alignment.digest(alignment.align(df, *PATHS)).collect()
    return sorted((tuple(r) for r in got), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.lists(st.integers(1, 5), min_size=1, max_size=60))
def test_cuts_are_the_common_ends(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    got = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a)]))
    assert got.tolist() == [x in set(b.tolist()) for x in a.tolist()]
    half = len(a) // 2                               # ranges are searched on their own
    part = alignment.shared_cuts(a, b, np.array([0, half + 1]), np.array([half, len(a)]))
    assert part.tolist() == [i != half and x for i, x in enumerate(got.tolist())]


def test_documents_of_the_fixture(spark, documents, libraries):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in documents][:80]
    assert result(spark, rows) == brute(rows, libraries)


EDGE = [(1, None), (2, ""), (3, " "), (4, "  two  blanks "), (5, "a▁b"), (6, "<|endoftext|> <s>x</s> <unk> <0x41>"),
        (7, "é́ 你好\U0001f600\U0001f469‍\U0001f4bb"), (8, "line\nline\r\n\tend\n"), (9, "tie"), (9, "tie"),
        (None, "tie"), (10, "\x00\x1c\x85　x"), (11, "a" * 3000), (12, "▁"), (13, "1234567890 12 1 %%%%"),
        (14, "ﬁÅ ­")]


def test_edge_rows_and_small_chunks(spark, libraries, monkeypatch):
    want = brute(EDGE, libraries)
    assert result(spark, EDGE) == want
    monkeypatch.setattr(alignment, "CHUNK_UNITS", 5)
    monkeypatch.setattr(alignment, "CACHED_TOKENS", 3)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 10)
    assert result(spark, EDGE) == want


def test_long_text_of_odd_blanks(spark, libraries):
    rng = random.Random(4)
    words = ["the", "Zug", "niño", "x1", "你好", "don't", "été", "--", "a\nb", "…", "UPPER"]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", " \t", ""]) for _ in range(6000))
    rows = [(1, text), (2, text[:777]), (3, text + "\u2581")]
    assert result(spark, rows) == brute(rows, libraries)


def test_empty_table_and_groups(spark, libraries):
    assert result(spark, []) == []
    df = spark.createDataFrame([(5, "abcdefgh unbelievable", 1, 2, "x"), (6, None, 1, 2, "x")], SCHEMA)
    got = {r.doc_id: r.groups for r in alignment.groups(alignment.align(df, *PATHS)).collect()}
    a, b = tokens("abcdefgh unbelievable", libraries)
    assert [i for g in got[5] for i in g.a] == [i for i, _ in a] and [i for g in got[5] for i in g.b] == [i for i, _ in b]
    assert got[6] == []


def test_spelling_takes_little_beside_its_result():
    """Speller.units holds the ids of a slice of units, not those of a whole dictionary, as objects (100 MB here)."""
    rng, n = np.random.default_rng(0), 150_000
    n_g = rng.integers(1, 3, n)
    sizes_a, sizes_b = rng.integers(1, 4, (2, n_g.sum()))
    ids_a, ids_b = rng.integers(0, 32_000, sizes_a.sum()), rng.integers(0, 32_000, sizes_b.sum())
    speller = alignment.Speller()
    speller.units(ids_a[:sizes_a[0]], ids_b[:sizes_b[0]], sizes_a[:1], sizes_b[:1], np.ones(1, np.int64))   # its table
    tracemalloc.start()
    got = speller.units(ids_a, ids_b, sizes_a, sizes_b, n_g)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    want, a, b, g = [], ids_a.tolist(), ids_b.tolist(), 0
    at = np.concatenate([[0], np.cumsum(sizes_a)]).tolist(), np.concatenate([[0], np.cumsum(sizes_b)]).tolist()
    for k in n_g.tolist():
        want.append(";".join("|".join(",".join(map(str, x[e[i]:e[i + 1]])) for x, e in zip((a, b), at))
                             for i in range(g, g + k)).encode())
        g += k
    assert got == want


def test_units_are_encoded_in_slices(spark, libraries, monkeypatch):
    made, sizes = alignment.Tokenizers(*(open(p, "rb").read() for p in PATHS)), []
    encode = made.encode
    monkeypatch.setattr(alignment, "SLICE_UNITS", 3, raising=False)
    monkeypatch.setattr(made, "encode", lambda units: sizes.append(len(units)) or encode(units))
    units = alignment.Units(made)
    first = units.numbers(["one two three four five six seven", "eight nine ten one"])
    assert max(sizes) <= 3 and [x.tolist() for x in first] == [list(range(7)), [7, 8, 9, 0]]
    # A dictionary of some units of several slices, in any chunk after the first.
    used, times = np.array([1, 5, 9]), np.array([2, 1, 4])
    whole = alignment.Units(made)
    monkeypatch.setattr(alignment, "SLICE_UNITS", 100, raising=False)
    whole.numbers(["two six ten"])
    assert units.dictionary(used, times) == whole.dictionary(np.arange(3), times)
