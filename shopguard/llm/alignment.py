"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut one text in different places. A cut is a byte offset where a
token of each ends. A blank between two other symbols starts a token of either
vocabulary, so the offset before it is a cut: texts are divided there into units
(mostly words), and a worker aligns each distinct unit once. In an interval
of A's tokens a cut near the middle is located by bisecting the B ends for the ends around it,
outward from the middle; the halves on both sides are searched in turn, and
what was seen to hold no cut is left out of them. Intervals without a cut are
the leaf groups. All intervals of one depth, of all units of a batch, are halved together.

Inside a group every overlapping pair of tokens is a link. Links are counted by
id pair over the whole corpus: texts are dealt to chunks of bounded size, a
chunk holds a dictionary of its distinct units and linked pairs, and only pairs
are shuffled: to the corpus-wide counts, and back to their chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopguard.llm.bpe import byte_letters
from shopguard.llm.common import written

BATCH_CHARS = 1_000_000      # text encoded and aligned at a time
CHUNK_UNITS = 1_000_000      # units of the texts of one chunk, and of the one text that exceeds it
CHUNK_TOKENS = 7_000_000     # tokens of the units a chunk may hold, and those of the batch that exceeds it
CACHED_TOKENS = 1_500_000    # tokens of units a worker keeps aligned for its next chunk; beyond, it starts afresh
SLICE_UNITS = 10_000         # units encoded, aligned or spelled at a time: what that takes on top of its result

# A blank between two symbols that are no white space. A's words start there; for B it is checked that no
# piece has its blank behind anything else.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_BLANK = "\u2581"            # fixed value: stands for a blank in the pieces of B


class Tokenizers:
    """A: byte-level vocabulary file; B: sentencepiece model. Both are read from bytes."""

    def __init__(self, a: bytes, b: bytes):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True          # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        spec = json.loads(a)
        vocab = spec["model"]["vocab"]
        self.labels_a = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1)
        for token, i in vocab.items():
            self.labels_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.labels_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode()
                         for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.labels_a], np.int64)
        self.size_b = np.array([len(x) for x in self.labels_b], np.int64)
        self.divisible = not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)

    def encode(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """(A's ids of a blank and each unit, B's ids of each unit, how many of each per unit, whether
        the bytes of both are those of the unit)."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        raws = [b" " + u.encode() for u in units]
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a, b))
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        size = np.fromiter(map(len, raws), np.int64, len(units))
        good = (_sums(self.size_a[ids_a], n_a) == size) & (_sums(self.size_b[ids_b], n_b) == size)
        whole = b"".join(raws)
        if not (good.all() and b"".join(map(self.labels_a.__getitem__, flat_a)) == whole
                and b"".join(map(self.labels_b.__getitem__, flat_b)) == whole):
            good &= [b"".join(map(self.labels_a.__getitem__, x)) == r and b"".join(map(self.labels_b.__getitem__, y)) == r
                     for x, y, r in zip(a, b, raws)]
        return ids_a, ids_b, n_a, n_b, good


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``n`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(n)
    return total[end] - total[end - n]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, position) for every position of the ranges."""
    n = np.maximum(hi - lo, 0)
    who = np.repeat(np.arange(len(lo)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which positions of ``ends_a`` inside the ranges ``lo`` to ``hi`` (exclusive) are in ``ends_b`` as well.

    Each range is halved at the common end nearest its middle, found by
    bisecting ``ends_b`` for windows around the middle that double until they hold one.
    """
    cut = np.zeros(len(ends_a), bool)
    while True:
        some = lo < hi
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return cut
        mid = (lo + hi) // 2
        todo, seen, reach = np.arange(len(lo)), 0, 1
        next_lo, next_hi = [], []
        while len(todo):
            l, h, m = lo[todo], hi[todo], mid[todo]
            who, at = _ranges(np.concatenate([np.maximum(l, m - reach), np.maximum(l, np.minimum(h, m + seen))]),
                              np.concatenate([np.maximum(l, m - seen), np.minimum(h, m + reach)]))
            who %= len(todo)
            place = np.searchsorted(ends_b, ends_a[at])
            hit = ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a[at]
            who, at = who[hit], at[hit]
            nearest = np.lexsort((at, np.abs(at - m[who]), who))
            who, at = who[nearest], at[nearest]
            first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
            who, at = who[first], at[first]
            cut[at] = True
            # Nothing within ``seen`` of the middle is a cut.
            next_lo += [l[who], np.maximum(at + 1, m[who] + seen)]
            next_hi += [np.minimum(at, np.maximum(m[who] - seen, l[who])), h[who]]
            left = np.ones(len(todo), bool)
            left[who] = False
            left &= (m - reach > l) | (m + reach < h)        # else the whole range was seen: a leaf
            todo, seen, reach = todo[left], reach, reach * 2
        lo, hi = np.concatenate(next_lo), np.concatenate(next_hi)


class Aligned:
    """Groups and links of a batch of texts. Token positions run through the whole batch."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, tok: Tokenizers):
        self.start_a, self.start_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        self.a, self.b = ids_a, ids_b
        ends_a, ends_b = np.cumsum(tok.size_a[self.a]), np.cumsum(tok.size_b[self.b])
        # Both tokenizations of a text have the same bytes, so its last ends agree, and ends grow through the batch.
        last = self.start_a[1:][np.diff(self.start_a) > 0] - 1
        self.cut_a = shared_cuts(ends_a, ends_b, self.start_a[:-1], self.start_a[1:] - 1)
        self.cut_a[last] = True
        self.close_a = np.flatnonzero(self.cut_a)            # last A and B token of each group
        self.close_b = np.searchsorted(ends_b, ends_a[self.close_a])
        self.size_a = np.diff(self.close_a, prepend=-1)
        self.size_b = np.diff(self.close_b, prepend=-1)
        self.start_g = np.searchsorted(self.close_a, self.start_a)
        self.ends_a, self.ends_b = ends_a, ends_b

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pair ``a << 32 | b`` of the link that ends with each A token, and with each B token that doesn't
        close a group: -1 for the others)."""
        group_a = np.repeat(np.arange(len(self.size_a)), self.size_a)
        group_b = np.repeat(np.arange(len(self.size_b)), self.size_b)
        # The B token over an A token's last byte is its group's last, unless the group has more B tokens.
        to_b = self.close_b[group_a]
        inner = np.flatnonzero(~self.cut_a & (self.size_b[group_a] > 1))
        to_b[inner] = np.searchsorted(self.ends_b, self.ends_a[inner])
        to_a = self.close_a[group_b]
        cut_b = np.zeros(len(self.b), bool)
        cut_b[self.close_b] = True
        inner = np.flatnonzero(~cut_b & (self.size_a[group_b] > 1))
        to_a[inner] = np.searchsorted(self.ends_a, self.ends_b[inner])
        by_b = self.a[to_a] << 32 | self.b
        by_b[cut_b] = -1
        return self.a << 32 | self.b[to_b], by_b


class Units:
    """The distinct units a worker has aligned, by number."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.number: dict = {}           # unit (in a tuple if it may stand only where ``_BETWEEN`` cuts) -> number or BAD
        self.parts: list[tuple] = []     # a, b, size_a, size_b, links, and numbers of each per unit, of one batch each
        self.n = self.tokens = 0

    BAD, ODD = -1, -2                    # bytes differ; white space at an edge, so blanks alone don't cut there

    def _add(self, units: list) -> None:
        for i in range(0, len(units), SLICE_UNITS):
            self._add_slice(units[i:i + SLICE_UNITS])

    def _add_slice(self, units: list) -> None:
        a, b, n_a, n_b, fit = self.tok.encode([u if isinstance(u, str) else u[0] for u in units])
        self.number.update(dict.fromkeys([units[i] for i in np.flatnonzero(~fit).tolist()], self.BAD))
        good = [units[i] for i in np.flatnonzero(fit).tolist()]
        if not good:
            return
        al = Aligned(a[np.repeat(fit, n_a)], b[np.repeat(fit, n_b)], n_a[fit], n_b[fit], self.tok)
        by_a, by_b = al.links()
        # A unit's links: those that end with its A tokens, then those that end with its other B tokens.
        rest = by_b >= 0
        owner = np.concatenate([np.repeat(np.arange(len(good)), np.diff(al.start_a)),
                                np.repeat(np.arange(len(good)), np.diff(al.start_b))[rest]])
        links = np.concatenate([by_a, by_b[rest]])[np.argsort(owner, kind="stable")]
        self.parts.append((*(x.astype(np.int32) for x in (al.a, al.b, al.size_a, al.size_b)), links,
                           *(np.diff(x) for x in (al.start_a, al.start_b, al.start_g))))
        self.number.update(zip(good, range(self.n, self.n + len(good))))
        self.n += len(good)
        self.tokens += len(al.a) + len(al.b)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text in order; none for a text without tokens."""
        cut = [t.split(" ") if self.tok.divisible else [(t,)] for t in texts]
        while True:
            known = self.number.get
            found = [list(map(known, us)) for us in cut]
            new = list(dict.fromkeys(u for us, ns in zip(cut, found) if None in ns for u, n in zip(us, ns) if n is None))
            odd = [u for u in new if isinstance(u, str) and (not u or u[0].isspace() or u[-1].isspace())]
            self.number.update(dict.fromkeys(odd, self.ODD))
            self._add([u for u in new if u not in self.number])
            again = False
            for i, (t, ns) in enumerate(zip(texts, found)):
                if None in ns:
                    again = True
                elif self.ODD in ns:                 # cut the text with a look at both sides of each blank
                    cut[i], again = [(u,) for u in _BETWEEN.split(t)], True
                elif self.BAD in ns and len(ns) > 1:  # judged as a whole
                    cut[i], again = [(t,)], True
            if not again:
                return [np.array(ns if t and self.BAD not in ns else [], np.int64) for t, ns in zip(texts, found)]

    def dictionary(self, used: np.ndarray, times: np.ndarray) -> tuple:
        """What the chunk's row holds of the units ``used``, which occur ``times`` times."""
        got: list[list[np.ndarray]] = [[np.empty(0, np.int32)] for _ in range(8)]
        first = 0
        for a, b, size_a, size_b, links, n_a, n_b, n_g in self.parts:
            lo, hi = np.searchsorted(used, [first, first + len(n_g)])
            mine, first = used[lo:hi] - first, first + len(n_g)
            if hi > lo:
                for k, (flat, n) in enumerate(((a, n_a), (b, n_b), (size_a, n_g), (size_b, n_g), (links, n_a + n_b - n_g))):
                    end = np.cumsum(n)[mine]
                    got[k].append(flat[_ranges(end - n[mine], end)[1]])
                for k, n in enumerate((n_a, n_b, n_g), 5):
                    got[k].append(n[mine].astype(np.int32))
        a, b, size_a, size_b, links, n_a, n_b, n_g = (np.concatenate(x) for x in got)
        pairs, place = np.unique(links, return_inverse=True)
        counts = np.bincount(place, np.repeat(times, n_a + n_b - n_g).astype(float), len(pairs)).astype(np.int64)
        return (*(_pack(x) for x in (a, b, size_a, size_b, place, n_a, n_b, n_g)),
                pairs.astype("<i8").tobytes(), counts.astype("<i8").tobytes())

    def renewed(self) -> Units:
        return Units(self.tok) if self.tokens > CACHED_TOKENS or len(self.number) > CACHED_TOKENS else self


_DICTIONARY = ["ids_a", "ids_b", "sizes_a", "sizes_b", "links", "n_a", "n_b", "n_g", "pairs", "counts"]
_ALIGNED = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("units", pa.binary()),
                      *((c, pa.binary()) for c in _DICTIONARY)])
_ALIGNED_DDL = "chunk long, row int, doc_id long, units binary, " + ", ".join(f"{c} binary" for c in _DICTIONARY)


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2**31, all their lowest bytes first, which compress best side by side."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _chunk_rows(chunk: int, ids: list[int | None], docs: list[np.ndarray], units: Units) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk: its documents with their units as places in its dictionary, and the dictionary (row -1)."""
    used, place, times = np.unique(np.concatenate([np.empty(0, np.int64), *docs]), return_inverse=True, return_counts=True)
    edges = np.cumsum([0, *[len(x) for x in docs]])
    none = (None,) * len(_DICTIONARY)
    rows = [(chunk, i, d, _pack(place[edges[i]:edges[i + 1]]), *none) for i, d in enumerate(ids)]
    rows.append((chunk, -1, None, None, *units.dictionary(used, times)))
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 2000]), _ALIGNED)],
                                         schema=_ALIGNED)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align every whole text's tokens by A (of a blank and the text) with those by B.

    Returns a written table that ``groups`` and ``digest`` read: per row of ``docs``
    its units, and per chunk a dictionary of the units' ids, groups and links, packed. Texts that are NULL or
    empty, or whose tokens' bytes differ from a blank and the text, have no
    tokens. Repeated rows come back as often as they went in; other columns play
    no part; an empty table gives an empty result.
    """
    with open(path_a, "rb") as fa, open(path_b, "rb") as fb:       # bounded by the vocabularies
        spec = docs.sparkSession.sparkContext.broadcast((fa.read(), fb.read()))
    made: list[Tokenizers] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        if not made:
            made.append(Tokenizers(*spec.value))
        part, n_chunks = TaskContext.get().partitionId(), 0
        units, ids, rows, held = Units(made[0]), [], [], 0
        for texts in _batches(batches):
            ids += [d for d, _ in texts]
            rows += units.numbers([t for _, t in texts])
            held += sum(len(x) for x in rows[-len(texts):])
            if held >= CHUNK_UNITS or units.tokens > CHUNK_TOKENS:
                yield from _chunk_rows(part << 32 | n_chunks, ids, rows, units)
                units, ids, rows, held, n_chunks = units.renewed(), [], [], 0, n_chunks + 1
        if rows:
            yield from _chunk_rows(part << 32 | n_chunks, ids, rows, units)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(texts.mapInArrow(run, _ALIGNED_DDL), "alignment")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    """(id, text) rows in lists of about BATCH_CHARS characters; a longer text makes a list of its own."""
    out: list[tuple] = []
    n = 0
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for i in range(b.num_rows):
            t = texts[i].as_py() or ""
            if out and n + len(t) > BATCH_CHARS:
                yield out
                out, n = [], 0
            out.append((ids[i].as_py(), t))
            n += len(t)
    if out:
        yield out


def _per_unit(flat: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def groups(aligned: DataFrame) -> DataFrame:
    """``(doc_id, groups)``: each group's ids by A and by B, in the order of the text."""
    def run(docs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        r = {c: _unpack(held[c].iloc[0]) for c in _DICTIONARY[:8]}
        sides = []
        for ids, n, sizes in (("ids_a", "n_a", "sizes_a"), ("ids_b", "n_b", "sizes_b")):
            sides.append([[x.tolist() for x in _per_unit(*u)] for u in
                          zip(_per_unit(r[ids], r[n]), _per_unit(r[sizes], r["n_g"]))])
        made = [[{"a": x, "b": y} for x, y in zip(*u)] for u in zip(*sides)]
        return pd.DataFrame({"doc_id": docs["doc_id"], "groups": [
            [g for u in _unpack(x).tolist() for g in made[u]] for x in docs["units"]]})

    docs = aligned.where("row >= 0").select("chunk", "doc_id", "units")
    held = aligned.where("row < 0").select(F.col("chunk").alias("of"), *_DICTIONARY[:8])
    return docs.groupBy("chunk").cogroup(held.groupBy("of")).applyInPandas(
        run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(chunk, pair, n)`` of the dictionaries, and corpus-wide ``(pair, total, best)``.

    ``pair`` is ``a << 32 | b``; ``best`` says whether its total is the highest of its B id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pairs, counts = (np.frombuffer(b.column(k)[i].as_py(), "<i8") for k in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), b.column(0)[i].as_py())), pa.array(pairs), pa.array(counts)],
                    names=["chunk", "pair", "n"])

    rows = written(aligned.where("row < 0").select("chunk", "pairs", "counts").mapInArrow(
        run, "chunk long, pair long, n long"), "alignment-pairs")
    totals = written(rows.groupBy("pair").agg(F.sum("n").alias("total")), "alignment-totals")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = totals.groupBy(b).agg(F.max("total").alias("most"))     # at most B's vocabulary
    marked = (totals.withColumn("b", b).join(F.broadcast(most), "b")
              .select("pair", "total", (F.col("total") == F.col("most")).alias("best")))
    return rows, marked


def _digits(n: int, end: bytes) -> list[bytes]:
    return [str(i).encode() + end for i in range(n)]


class Speller:
    """Spells groups as ``a1,a2|b1;a3|b2,b3``: every id with each symbol that may follow it is kept."""

    def __init__(self):
        self.width, self.table = 0, []

    def units(self, ids_a, ids_b, sizes_a, sizes_b, n_g) -> list[bytes]:
        """The groups of each of several units."""
        if not len(ids_a):
            return []
        most = int(max(ids_a.max(), ids_b.max())) + 1
        if self.width < most:
            self.width = max(most, 1 << 16)
            self.table = [x for end in (b",", b"|", b";", b"\n") for x in _digits(self.width, end)]
        # Where each unit's groups and tokens begin, and the end of the last one's.
        of_g, of_a, of_b = (np.concatenate([[0], np.cumsum(x)]) for x in (n_g, sizes_a, sizes_b))
        out: list[bytes] = []
        for i in range(0, len(n_g), SLICE_UNITS):
            n = n_g[i:i + SLICE_UNITS]
            g = slice(of_g[i], of_g[i + len(n)])
            out += self._spell(ids_a[of_a[g.start]:of_a[g.stop]], ids_b[of_b[g.start]:of_b[g.stop]],
                               sizes_a[g], sizes_b[g], n)
        return out

    def _spell(self, ids_a, ids_b, sizes_a, sizes_b, n_g) -> list[bytes]:
        end_a, end_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        end_a[np.cumsum(sizes_a) - 1] = 1
        end_b[np.cumsum(sizes_b) - 1] = 2
        end_b[np.cumsum(sizes_b)[np.cumsum(n_g) - 1] - 1] = 3
        group_a, group_b = np.repeat(np.arange(len(sizes_a)), sizes_a), np.repeat(np.arange(len(sizes_b)), sizes_b)
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = ids_a + self.width * end_a
        out[np.arange(len(ids_b)) + np.cumsum(sizes_a)[group_b]] = ids_b + self.width * end_b
        return b"".join(map(self.table.__getitem__, out.tolist())).split(b"\n")[:-1]


def digest(aligned: DataFrame) -> DataFrame:
    """Counts, link scores and the digest of the groups of each document of ``align``.

    ``n_best`` counts the links whose id pair has its B id's highest corpus-wide
    count (ties included), ``count_sum`` sums the counts over the links.
    """
    pairs, marked = pair_counts(aligned)
    spellers: list[Speller] = []

    def score(docs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not spellers:
            spellers.append(Speller())
        known = held.loc[held["pair"].notna(), ["pair", "total", "best"]].sort_values("pair")   # as in the dictionary
        total, best = known["total"].to_numpy().astype(np.int64), known["best"].to_numpy().astype(np.int64)
        row = held[held["pair"].isna()].iloc[0]
        r = {c: _unpack(row[c]) for c in _DICTIONARY[:8]}
        n_l = r["n_a"] + r["n_b"] - r["n_g"]
        per_unit = {"n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_g"], "n_links": n_l,
                    "n_best": _sums(best[r["links"]], n_l), "count_sum": _sums(total[r["links"]], n_l)}
        spelled = spellers[0].units(*(r[c] for c in ("ids_a", "ids_b", "sizes_a", "sizes_b", "n_g")))
        cols: dict[str, list] = {c: [] for c in [*per_unit, "groups_sha256"]}
        for x in docs["units"]:
            at = _unpack(x)
            for c, v in per_unit.items():
                cols[c].append(int(v[at].sum()) if len(at) else 0)
            text = b";".join(map(spelled.__getitem__, at.tolist()))
            cols["groups_sha256"].append(hashlib.sha256(text).hexdigest() if len(at) else "")
        return pd.DataFrame({"doc_id": docs["doc_id"], **cols})

    docs = aligned.where("row >= 0").select("chunk", "doc_id", "units")
    known = (pairs.select(F.col("chunk").alias("of"), "pair").join(marked, "pair")
             .unionByName(aligned.where("row < 0").select(F.col("chunk").alias("of"), *_DICTIONARY[:8]),
                          allowMissingColumns=True))
    return docs.groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(
        score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
