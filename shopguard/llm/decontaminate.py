"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

The items' word sequences go into one automaton whose states are the classes of
word strings that end at the same places of the items. Training documents are
streamed through it word by word: the state and the length of the longest
match that ends at each word are kept, a mismatch falls back along the suffix
links. A window (``window`` consecutive item words, or the whole of a shorter
item) occurs where the match reaches its length; the words it covers are hits,
and spans of hits are removed by length or coverage.

Between two words that stand side by side in no item a match is at most one
word long, so the stream is taken up again at the second of them and stretches
too short for any window are not streamed.

The items are dealt to automata of bounded size, built in tasks. A document
passes all automata in a map; matches of several automata add up in its row, so
there is no shuffle of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import written

WINDOW = 10
# Words of one automaton, and of one piece of a longer item. An automaton of SHARD_WORDS words takes
# about 30 MB in a worker; PASS_SHARDS of them are held at a time.
SHARD_WORDS = 200_000
PIECE_WORDS = 20_000
PASS_SHARDS = 4

# Words are runs of digits, letters (A-Z as a-z) and everything beyond ASCII.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(raw: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return raw.translate(_FOLD).split()


class ItemAutomaton:
    """Generalised suffix automaton over word ids, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        """``items``: (id, words); a NULL id's windows hit but name no item."""
        self.vocab: dict[bytes, int] = {}
        self.step: dict[int, int] = {}               # state << 32 | word -> state
        self.out: list[list[int]] = [[]]             # words that leave each state
        self.link, self.size = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            coded.append((name, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        # A state has one string of each length, so a window is a state and a length.
        found: dict[int, dict[int, set[str]]] = {}
        for name, ids in coded:
            state = 0
            for i, c in enumerate(ids):
                state = self.step[state << 32 | c]
                m = min(window, len(ids))
                if i + 1 >= m:
                    u = state
                    while self.size[self.link[u]] >= m:
                        u = self.link[u]
                    names = found.setdefault(u, {}).setdefault(m, set())
                    if name is not None:
                        names.add(name)
        self.windows = {u: [(m, sorted(n)) for m, n in sorted(w.items())] for u, w in found.items()}
        self.least = min((m for w in found.values() for m in w), default=0)
        pairs = {(a, b) for _, ids in coded for a, b in zip(ids, ids[1:])}
        unknown = len(self.vocab)
        self.pairs = np.array(sorted(a * (unknown + 1) + b for a, b in pairs), np.int64)
        # The nearest state with windows along the suffix links, the state itself included.
        self.up = [-1] * len(self.size)
        for u in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.up[u] = u if u in self.windows else self.up[self.link[u]]
        del self.out

    def _new(self, size: int, link: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.out.append([])
        return len(self.size) - 1

    def _put(self, state: int, c: int, to: int) -> None:
        if (state << 32 | c) not in self.step:
            self.out[state].append(c)
        self.step[state << 32 | c] = to

    def _split(self, p: int, c: int, q: int) -> int:
        """Give the strings of ``q`` that end p's longest string a state of their own."""
        own = self._new(self.size[p] + 1, self.link[q])
        for w in self.out[q]:
            self._put(own, w, self.step[q << 32 | w])
        self.link[q] = own
        while p >= 0 and self.step.get(p << 32 | c) == q:
            self.step[p << 32 | c] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, c: int) -> int:
        q = self.step.get(last << 32 | c)
        if q is not None:                            # read before, by this item or another
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        state, p = self._new(self.size[last] + 1, 0), last
        while p >= 0 and (p << 32 | c) not in self.step:
            self._put(p, c, state)
            p = self.link[p]
        if p >= 0:
            q = self.step[p << 32 | c]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return state

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words, each neighbours in some item, that are long enough for a window."""
        unknown = len(self.vocab)
        if not self.least or len(ids) < self.least:
            return
        key = ids[:-1] * (unknown + 1) + ids[1:]
        at = np.searchsorted(self.pairs, key)
        apart = np.ones(len(key), bool)
        inside = at < len(self.pairs)
        apart[inside] = self.pairs[at[inside]] != key[inside]
        edges = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(ids)]])
        for k in np.flatnonzero(np.diff(edges) >= self.least).tolist():
            if ids[edges[k]] != unknown:
                yield int(edges[k]), int(edges[k + 1])

    def stream(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """(runs of hit words, items with an occurring window, longest match that ends with a window)."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(len(self.vocab))), np.int64, len(words))
        runs: list[list[int]] = []
        named: set[str] = set()
        longest = 0
        step, link, sizes, up, windows = self.step, self.link, self.size, self.up, self.windows
        for a, b in self.stretches(ids):
            state = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                to = step.get(state << 32 | c)
                while to is None and state:
                    state = link[state]
                    size = sizes[state]
                    to = step.get(state << 32 | c)
                if to is None:
                    continue
                state, size = to, size + 1
                u, reach = up[state], 0
                while u >= 0:
                    for m, names in windows[u]:
                        if m <= size:
                            reach = max(reach, m)
                            named.update(names)
                    u = up[link[u]]
                if reach:
                    longest = max(longest, size)
                    if runs and i - reach <= runs[-1][1]:
                        runs[-1] = [min(runs[-1][0], i - reach), i]
                    else:
                        runs.append([i - reach, i])
        return _joined(runs), named, longest


def _joined(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _automata(items: DataFrame, id_col: str, text_col: str, window: int) -> list[DataFrame]:
    """One single-row frame per shard with the pickled automaton of its items."""
    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, text in zip(f["name"].tolist(), f["t"].tolist()):
                w = words_of(bytes(text or b""))
                # Pieces overlap by a window less one word, so no window is lost between them.
                for a in range(0, max(len(w) - window + 1, 1), PIECE_WORDS):
                    part = w[a:a + PIECE_WORDS + window - 1]
                    if part:
                        rows.append((name, len(part), b" ".join(part)))
            yield pd.DataFrame(rows, columns=["name", "n", "words"])

    cut = written(items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("t"))
                  .mapInPandas(pieces, "name string, n long, words binary").distinct(), "decontaminate-items")
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = -(-total // SHARD_WORDS)

    def build(f: pd.DataFrame) -> pd.DataFrame:
        import pickle

        made = ItemAutomaton([(n, bytes(w).split(b" ")) for n, w in zip(f["name"].tolist(), f["words"].tolist())], window)
        return pd.DataFrame([(int(f["shard"].iloc[0]), pickle.dumps(made.__dict__, 5))], columns=["shard", "packed"])

    built = written(cut.withColumn("shard", F.pmod(F.xxhash64("name", "words"), F.lit(max(shards, 1))).cast("int"))
                    .groupBy("shard").applyInPandas(build, "shard int, packed binary"), "decontaminate-automata")
    return [built.where(F.col("shard") == s) for s in range(shards)]


_STATE = [("__n", pa.int64()), ("__longest", pa.int32()), ("__items", pa.list_(pa.string())),
          ("__runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]
_STATE_DDL = ("__n long, __longest int, __items array<string>, __runs array<struct<a:int,b:int>>")


def _streamed(docs: DataFrame, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str,
              window: int) -> DataFrame:
    """``docs`` as a struct ``__row`` with ``__text`` and what all automata found in it."""
    from pyspark.sql.types import StructType

    frame = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text"))
    fields = frame.schema.fields + StructType.fromDDL(_STATE_DDL).fields
    schema = StructType(fields)
    for c, t in zip([f.name for f in fields[2:]], [f.dataType for f in fields[2:]]):
        frame = frame.withColumn(c, F.lit(None).cast(t))
    shards = _automata(items, item_id_col, item_text_col, window)
    if not shards:                                   # no item has a word; the words are counted all the same
        shards = [None]
    for k, shard in enumerate(shards):
        if k and k % PASS_SHARDS == 0:
            frame = written(frame, "decontaminate-pass")
        packed = shard.first() if shard is not None else None
        held = docs.sparkSession.sparkContext.broadcast(bytes(packed["packed"]) if packed else b"")
        frame = frame.mapInArrow(_streamer(held), schema)
    return frame


def _streamer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        made = ItemAutomaton([])
        if held.value:
            made.__dict__.update(pickle.loads(held.value))
        for b in batches:
            ns, longests, names, runs = [], [], [], []
            before = [b.column(k) for k in range(2, 6)]
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                words = words_of(t.as_py() or b"")
                spans, named, longest = made.stream(words)
                if before[0][i].is_valid:            # another automaton saw the row before
                    spans = _joined(spans + [[r["a"], r["b"]] for r in before[3][i].as_py()])
                    named.update(before[2][i].as_py())
                    longest = max(longest, before[1][i].as_py())
                ns.append(len(words))
                longests.append(longest)
                names.append(sorted(named))
                runs.append([{"a": x, "b": y} for x, y in spans])
            made_cols = [pa.array(c, t) for c, (_, t) in zip((ns, longests, names, runs), _STATE)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made_cols], names=b.schema.names)
    return run


def _n_hit() -> Column:
    return F.aggregate("__runs", F.lit(0).cast("long"), lambda n, r: n + (r["b"] - r["a"]).cast("long"))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                       text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, longest, items, spans)`` per row of ``docs``.

    ``spans`` are the maximal runs of hit words as word positions ``a`` to ``b``
    (exclusive), ``items`` the sorted ids (as strings) of the items with an
    occurring window, ``longest`` the words of the longest match that ends with a window.
    NULL and empty texts have no words. An item of fewer words than ``window`` is
    one window, one without words none. Rows that repeat an item id are one
    item; an item without an id hits but is not named. Repeated documents come
    back as often as they went in. Other columns play no part; an empty table
    of items hits nothing, an empty table of documents gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _streamed(rows, "text", items, item_id_col, item_text_col, window)
    return found.select("__row.doc_id", F.col("__n").alias("n_words"), _n_hit().alias("n_hit"),
                        F.col("__longest").alias("longest"), F.col("__items").alias("items"),
                        F.col("__runs").alias("spans"))


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = WINDOW - 1,
                         max_coverage: float = 0.5, text_col: str = "text", item_id_col: str = "item_id",
                         item_text_col: str = "text") -> DataFrame:
    """``docs`` with spans of item words removed from the text; all columns and rows stay.

    A span (maximal run of hit words, with what stands between them) goes if it
    is longer than ``max_words`` words; all spans of a document go if hits are
    more than ``max_coverage`` of its words. A NULL text stays NULL. See
    ``find_contamination`` for the other cases.
    """
    names, kept = docs.columns, docs.schema[text_col]
    found = _streamed(docs, text_col, items, item_id_col, item_text_col, window)
    hit = _n_hit()
    gone = F.when(hit > F.lit(max_coverage) * F.col("__n"), F.col("__runs")).otherwise(
        F.filter("__runs", lambda r: r["b"] - r["a"] > max_words))
    cut = found.select("__row", "__text", gone.alias("__gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                texts.append(without(t, [(g["a"], g["b"]) for g in gone]) if gone else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, b.schema.field(1).type)],
                                             names=["__row", "__text"])

    from pyspark.sql.types import StructField, StructType

    out = StructType([StructField("__row", docs.schema), StructField("__text", kept.dataType)])
    cleaned = cut.mapInArrow(run, out)
    return cleaned.select(*[F.col("__text").alias(n) if n == text_col else F.col("__row")[n].alias(n) for n in names])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the words of each span and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items' ids of ``find_contamination``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
