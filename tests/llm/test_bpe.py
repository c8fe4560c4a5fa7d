"""BPE automaton against the tokenizers library, and exact round trips."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer as Library

from small_documents import documents  # noqa: F401

from shopguard.llm import bpe
from shopguard.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Library.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def mine():
    return bpe.Tokenizer(bpe.load_spec(tokenizer_path()))


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def check(mine, library, text):
    got = mine.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(got) == want
    assert mine.decode(got) == library.decode(want, skip_special_tokens=False)


def test_whole_documents(mine, library, documents):
    for r in documents:
        check(mine, library, r.text)


def test_random_texts_and_specials(mine, library):
    rng = random.Random(3)
    letters = " aabbccééth\n\t'sldABC0129#*&ñß漢字🙂　 \r\x1c\x85՘"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        if rng.random() < 0.2:
            text = text[:9] + "<|endoftext|>" + text[9:]
        check(mine, library, text)
    for text in ("a" * 3000, " " * 2000, "=" * 777, "ab" * 500, "\n" * 99, "ab�cd", "<|endoftext|>" * 3):
        check(mine, library, text)


def test_every_code_point_splits_alike(mine, library):
    for c in [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 3), 0x31350, 0x3FFFF]:
        if 0xD800 <= c < 0xE000:
            continue
        text = f"a{chr(c)}1 {chr(c)}{chr(c)}!"
        assert [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)] == mine.split(text), hex(c)


def test_accepts_exactly_the_encodings(mine, library):
    """The automaton accepts a token pair exactly if it is the encoding of its text."""
    rng = random.Random(4)
    labels = [t for t in mine.automaton.readable if t.isalpha() and t.islower()]
    for _ in range(3000):
        a, b = rng.choice(labels), rng.choice(labels)
        pair = [mine.automaton.readable[a], mine.automaton.readable[b]]
        whole = library.encode((a + b).decode(), add_special_tokens=False).ids
        assert mine.automaton.follows(*pair) == (whole == pair)


def test_frames(spark, library):
    data = [(1, None), (2, ""), (3, "the the"), (3, "the the"), (None, "x" * 200000), (5, "é\x00 ñ")]
    df = spark.createDataFrame([(d, t, 7, "y") for d, t in data], "doc_id long, text string, n_tokens int, token_ids string")
    out = bpe.digest_round_trip(df, tokenizer_path()).collect()
    assert len(out) == 6
    for r, (d, t) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), [*data[:4], data[5], data[4]]):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (d, len(want))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((d or 0, t or "") for d, t in data)
    assert bpe.digest_round_trip(df.limit(0), tokenizer_path()).count() == 0


def test_other_id_column_beside_a_doc_id(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, "y")], "doc_id long, body string, key long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in bpe.digest_round_trip(df, tokenizer_path(), "key", "body").collect())
    assert got == [(7, 2), (8, 0)]
    assert sorted(r.doc_id for r in bpe.encode_corpus(df, tokenizer_path(), "key", "body").collect()) == [7, 8]
