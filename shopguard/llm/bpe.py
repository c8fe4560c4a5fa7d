"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens
(Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA",
2024). It starts as one state with a loop per byte. The gadget of merge k,
``(u, v) -> uv``, removes the arc v after u and adds an arc uv wherever u can be
read, leading to where v led. A token sequence is the BPE encoding of its
text exactly if the automaton accepts it, and a text has one accepted sequence.

After all gadgets the state is determined by the last token, and the arc
``t1 -> t2`` is there unless some gadget removed it: the gadget of a pair (a, b)
where a ends t1 and b starts t2 as parts of their merge trees, at a time when
neither had been merged further. The gadgets are stored as tables (the parts
and rank of each token, the rank of each pair), since the full arc table of a
50,000-token vocabulary has 2.5e9 cells; arcs are looked up in them once and
kept. Encoding a word walks the automaton over its byte positions; a position has
one state, so one that leads nowhere is closed for good and the walk is linear.
Decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the split that byte-level BPE vocabularies of this family use.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: code points that are letters or numbers only since Unicode 17, later than the tables
# of the tokenizers library; they split as the symbols it takes them for. Inclusive ranges.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F "
    "12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")
UNASSIGNED = "\u0378"     # splits as a symbol
# Texts below this code point are split by the standard library with classes listed out.
LATIN_END = 0x250
# Words a worker keeps encoded, and arcs it keeps resolved, before it starts afresh.
CACHED_WORDS = 500_000
CACHED_ARCS = 1_000_000
CACHED_WORD_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def splitter() -> Callable[[str], list[str]]:
    """The function that splits a text into words as SPLIT says."""
    general = regex.compile(SPLIT)

    def members(pattern: str) -> str:
        one = regex.compile(pattern)
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if one.match(chr(c)))

    letter, number, blank = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    latin = re.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]")
                       .replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
                       .replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]")).findall
    beyond = re.compile(f"[{chr(LATIN_END)}-\U0010ffff]").search
    spans = [[chr(int(c, 16)) for c in r.split("-")] for r in LATER.split()]
    later = re.compile("[" + "".join("-".join(s) for s in spans) + "]")

    def split(text: str) -> list[str]:
        if not beyond(text):
            return latin(text)
        plain = later.sub(UNASSIGNED, text)
        if plain == text:
            return general.findall(text)
        return [text[m.start():m.end()] for m in general.finditer(plain)]

    return split


class Automaton:
    """Tokenization automaton: ``encode`` a word's bytes to token ids, ``labels`` to decode."""

    def __init__(self, n_tokens: int, byte_ids: dict[bytes, int], merges: list[tuple[int, int, int]],
                 labels: list[bytes]):
        """``merges``: (left id, right id, merged id) in order of rank."""
        self.labels = labels
        self.left, self.right = [-1] * n_tokens, [-1] * n_tokens
        self.rank = [-1] * n_tokens
        self.cut: dict[int, dict[int, int]] = {}     # left id -> right id -> rank
        self.spines: dict[int, tuple] = {}
        self.arcs: dict[int, bool] = {}                # t1 << 32 | t2 -> whether the arc is there
        self.readable = dict(byte_ids)       # label -> token, for tokens some path can read
        alive = set(byte_ids.values())
        for k, (u, v, w) in enumerate(merges):
            # The gadget acts on paths u, v; if earlier gadgets left none it does nothing.
            if v in self.cut.get(u, ()) or u not in alive or v not in alive or not self._passes(u, v):
                continue
            self.cut.setdefault(u, {})[v] = k
            if w not in alive:
                self.left[w], self.right[w], self.rank[w] = u, v, k
                alive.add(w)
                self.readable[labels[w]] = w
        # The longest label that starts with each three bytes bounds the arcs worth trying.
        self.reach: dict[bytes, int] = {}
        for label in self.readable:
            head = label[:3]
            self.reach[head] = max(len(label), self.reach.get(head, 1))

    def _spines(self, t: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The parts that end and that start ``t``, each with the rank at which it was merged further."""
        spines = self.spines.get(t)
        if spines is None:
            ends, starts = [(t, 1 << 60)], [(t, 1 << 60)]
            while self.right[ends[-1][0]] >= 0:
                part = ends[-1][0]
                ends.append((self.right[part], self.rank[part]))
            while self.left[starts[-1][0]] >= 0:
                part = starts[-1][0]
                starts.append((self.left[part], self.rank[part]))
            spines = self.spines[t] = ends, starts
        return spines

    def _passes(self, t1: int, t2: int) -> bool:
        """No gadget so far removed t2 after t1."""
        starts = self._spines(t2)[1]
        for a, a_gone in self._spines(t1)[0]:
            cut = self.cut.get(a)
            if cut is not None:
                for b, b_gone in starts:
                    k = cut.get(b)
                    # At equal ranks the pair further left is merged first.
                    if k is not None and k < a_gone and k <= b_gone:
                        return False
        return True

    def follows(self, t1: int, t2: int) -> bool:
        """Whether the state after t1 has an arc t2."""
        if len(self.arcs) >= CACHED_ARCS:
            self.arcs.clear()
        ok = self.arcs[t1 << 32 | t2] = self._passes(t1, t2)
        return ok

    def encode(self, word: bytes) -> list[int]:
        """The one accepted token sequence with this text, found by walking the longest open arcs."""
        if (t := self.readable.get(word)) is not None:
            return [t]
        n, readable, arcs, reach = len(word), self.readable, self.arcs, self.reach
        out: list[int] = []
        ends = [0]                           # byte position after each token of ``out``
        closed = set()                       # positions from which no accepted sequence goes on
        at, last = 0, -1
        end = min(n, reach.get(word[:3], 2))  # next arc to try: the longest first
        while at < n:
            while end > at:
                t = readable.get(word[at:end])
                if t is not None and end not in closed:
                    ok = last < 0 or arcs.get(last << 32 | t)
                    if ok is None:
                        ok = self.follows(last, t)
                    if ok:
                        out.append(t)
                        ends.append(end)
                        at, last = end, t
                        end = min(n, at + reach.get(word[at:at + 3], 2))
                        break
                end -= 1
            else:                            # every position has one state, so it need not be tried again
                closed.add(at)
                end = ends.pop() - 1
                at = ends[-1]
                out.pop()
                last = out[-1] if out else -1
        return out


class Tokenizer:
    """Encode and decode whole texts as the vocabulary file says."""

    def __init__(self, spec: dict):
        model = spec["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        n = max([*vocab.values(), *added.values()]) + 1
        labels = [b""] * n
        for token, i in vocab.items():
            labels[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            labels[i] = token.encode()
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton(n, {bytes([b]): vocab[c] for c, b in letters.items()}, merges, labels)
        self.added = added
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) \
            if added else None
        self.split = splitter()
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.automaton.encode(raw)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= CACHED_WORD_BYTES:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = packed
        return packed

    def _plain(self, text: str) -> list[bytes]:
        known, word = self.words.get, self._word
        return [known(m) or word(m) for m in self.split(text)]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.special is None:
            return b"".join(self._plain(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out.extend(self._plain(text[at:m.start()]))
            out.append(self.added[m[0]].to_bytes(4, "little"))
            at = m.end()
        out.extend(self._plain(text[at:] if at else text))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        labels = self.automaton.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def load_spec(path: str) -> dict:
    """Read a byte-level BPE vocabulary file on the driver; its size is bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"{path} is not a byte-level BPE vocabulary without a normalizer")
    return {k: spec[k] for k in ("model", "added_tokens")}


def _apply(docs: DataFrame, path: str, text_col: str, keep: list[str], row, schema: str) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(path))
    made: list[Tokenizer] = []               # one per task process, built on first use

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Tokenizer(spec.value))
        for b in batches:
            cols = list(zip(*[row(made[0], t) for t in b.column(b.num_columns - 1).to_pylist()])) or \
                [()] * (len(out.names) - len(keep))
            arrays = [b.column(i) for i in range(len(keep))]
            arrays += [pa.array(c, out.field(len(keep) + i).type) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = docs.select(*keep)
    result = StructType(kept.schema.fields + StructType.fromDDL(schema).fields)
    out = to_arrow_schema(result)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, result)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, token_ids array<int>)`` per row; NULL text encodes as empty, long texts whole."""
    def row(tok: Tokenizer, text: str | None):
        return (np.frombuffer(tok.encode(text or ""), "<u4").astype(np.int32),)

    return _apply(docs, path, text_col, [id_col], row, "token_ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, text)`` of ``(id, token_ids)`` rows; NULL ids decode as the empty text."""
    def row(tok: Tokenizer, ids):
        return (tok.decode(np.array(ids if ids is not None else [], dtype="<u4").tobytes()),)

    return _apply(tokens, path, "token_ids", [id_col], row, "text string")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def digest_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``.

    Encodes each whole text, decodes the ids again and returns digests of both.
    NULL counts as the empty text; repeated rows come back as often as they
    went in; other columns play no part; an empty table gives an empty result.
    """
    def row(tok: Tokenizer, text: str | None):
        ids = tok.encode(text or "")
        return (len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                hashlib.sha256(tok.decode(ids).encode()).hexdigest())

    return _apply(_named(docs, id_col, text_col), path, "text", ["doc_id"], row, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256)`` per row: the encoded corpus with
    the digests that prove its round trip (see ``digest_round_trip`` for NULLs and repeats)."""
    def row(tok: Tokenizer, text: str | None):
        ids = tok.encode(text or "")
        return (len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32), hashlib.sha256(ids).hexdigest(),
                hashlib.sha256(tok.decode(ids).encode()).hexdigest())

    return _apply(_named(docs, id_col, text_col), path, "text", ["doc_id"], row, "n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string")
