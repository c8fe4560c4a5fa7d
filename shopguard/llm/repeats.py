"""Suffix-array dedup: remove every byte covered by a long string that occurs elsewhere too.

Windows of ``length`` bytes are first dealt by content: each window start
belongs to the smallest rolling hash (leftmost at ties) of the ``GRAM``-byte
grams inside it, so equal windows, wherever they are, belong to equal grams at equal
offsets. Runs of window starts with one gram make a segment, the bytes all its windows
span; segments tile a document. Only segments of one gram can share a window:

* all segments of a gram are equal: every window of theirs is repeated, or
  there is one segment and none is;
* otherwise the distinct segments meet in one task, which builds an enhanced
  suffix array over them (sorted suffixes, longest common prefixes) and
  stack-scans it into common-prefix intervals. An interval of at least
  ``length`` bytes whose members are preceded by different bytes is a maximal
  repeat, with all members as occurrences; together the occurrences cover
  exactly the repeated windows.

A gram with more than ``group_limit`` distinct segments (a passage that a third
of all documents share, each with its own surroundings) is dealt again: its
windows are cut into ranges of offsets to the gram, and a range's rows meet by the bytes all its
windows have in common. Equal rows collapse on the way, and ranges get narrower until every group
fits, at one window at the latest, where all rows of a group are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import HOT_KEYS, join_weighted, written

LENGTH = 400
GRAM = 64
PIECE = 1 << 21             # window starts hashed at a time; positions fit the 24 bits packed below a hash
GROUP_LIMIT = 128           # distinct segments of a gram that one suffix array takes
SHARD_ROWS = 1024           # segments of one suffix array, whole groups together
NARROWER = 8                # ranges a too large group's windows are cut into

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 24) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        one = np.ones(size, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = _BASE, _BACK
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the gram at every position of the bytes ``x``."""
    up, down = _power_tables(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:len(x)], out=sums[1:])
    g = (sums[gram:] - sums[:-gram]) * down[:len(x) - gram + 1]
    g ^= g >> np.uint64(32)
    g *= _MIX
    return g ^ (g >> np.uint64(29))


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """``(start, n, off, gram hash, content hash)``: n window starts from ``start`` on whose smallest
    gram begins ``off`` bytes after ``start``."""
    last = len(raw) - length                    # last window start
    for lo in range(0, last + 1, PIECE):
        hi = min(lo + PIECE, last + 1)
        x = np.frombuffer(raw, np.uint8, hi - lo + length - 1, lo)
        g = gram_hashes(x, gram)
        low = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
        at = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(first, len(at)))
        place = at[first]
        for s, k, o, h in zip((first + lo).tolist(), n.tolist(), (place - first).tolist(),
                              g[place].view(np.int64).tolist()):
            yield s, k, o, h, _content(raw[s:s + k - 1 + length], o)


def _content(segment: bytes, off: int) -> int:
    h = xxhash.xxh3_64_intdigest(segment, off)
    return h - (1 << 64) if h >> 63 else h


def _row_key(doc_id: int | None, raw: bytes) -> tuple[int, int]:
    """Tells rows apart by id and text: 64 bits of the text's hash beside an id, 128 where there is none.

    Rows that share a key have equal texts, so they share their spans as well.
    """
    if doc_id is not None:
        return doc_id, xxhash.xxh3_64_intdigest(raw) - (1 << 63)
    h = xxhash.xxh3_128_intdigest(raw, 1)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _raw(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        yield d, t or b""


def _frame(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_KEY = [("id", pa.int64()), ("th", pa.int64())]
_SEG = pa.schema([*_KEY, ("start", pa.int32()), ("n", pa.int32()), ("off", pa.int32()),
                  ("g", pa.int64()), ("c", pa.int64())])
_TEXT = pa.schema([*_KEY, ("n_bytes", pa.int64()), ("z", pa.binary()), ("doc_id", pa.int64())])


def _segment_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _SEG]
            for d, raw in _raw(b):
                if len(raw) >= length:
                    key = _row_key(d, raw)
                    for s in segments(raw, length, gram):
                        for c, v in zip(cols, (*key, *s)):
                            c.append(v)
                    if len(cols[0]) >= 50_000:
                        yield _frame(cols, _SEG)
                        cols = [[] for _ in _SEG]
            yield _frame(cols, _SEG)

    return docs.mapInArrow(run, "id long, th long, start int, n int, off int, g long, c long")


def _texts(docs: DataFrame) -> DataFrame:
    """Texts under their row key, compressed, since they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            rows = [(*_row_key(d, raw), len(raw), pack(raw), d) for d, raw in _raw(b)]
            yield _frame([list(c) for c in zip(*rows)] or [[] for _ in _TEXT], _TEXT)

    return docs.mapInArrow(run, "id long, th long, n_bytes long, z binary, doc_id long")


# --- suffix arrays -----------------------------------------------------------------------------------


def suffix_array(x: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Sorted suffixes of the parts that ``x`` (bytes) concatenates, by prefix doubling, and the ranks by
    prefix length (1, 8, 16, ...; equal ranks: equal prefixes that end inside their parts).

    ``room`` is the number of bytes left in each position's part. A part's end
    sorts before every byte and equals no other end.
    """
    n, most = len(x), int(room.max())
    padded = np.concatenate([x.astype(np.uint64), np.zeros(8, np.uint64)])
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | np.where(room > i, padded[i:n + i], np.uint64(0))
    inside = np.minimum(room, 8)
    order = np.lexsort((inside, word))
    w, r = word[order], inside[order]
    new = (w[1:] != w[:-1]) | (r[1:] < 8) | (r[:-1] < 8)
    have, ranks = 8, [(1, x.astype(np.int64))]
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], new.astype(np.int64)]))
        ranks.append((have, rank))
        if have >= most or new.all():
            return order, ranks
        ahead = np.zeros(n, np.int64)
        if have < n:
            ahead[:n - have] = rank[have:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        w = key[order]
        new = w[1:] != w[:-1]
        have *= 2


def common_prefixes(order: np.ndarray, ranks: list[tuple[int, np.ndarray]], room: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted suffix with the one before it, inside their parts."""
    a, b = order[:-1], order[1:]
    most = np.minimum(room[a], room[b])
    got = np.zeros(len(a), np.int64)
    for step, rank in [*ranks[::-1], *[ranks[0]] * 7]:
        can = got < most
        i, j = np.where(can, a + got, 0), np.where(can, b + got, 0)
        got += np.where(can & (rank[i] == rank[j]), step, 0)
    return np.concatenate([[0], np.minimum(got, most)])


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, before: np.ndarray,
                    least: int) -> Iterator[tuple[int, int, int]]:
    """Maximal repeats of at least ``least`` bytes as ``(length, first, last)`` ranges of ``order``.

    Stack scan of the suffix array into its tree of common-prefix intervals;
    an interval is output if its members are preceded by different bytes
    (``before``: the byte before each position, negative and unique where there is none).
    """
    in_run = lcp >= least
    starts = np.flatnonzero(in_run & ~np.concatenate([[False], in_run[:-1]])) - 1
    ends = np.flatnonzero(in_run & ~np.concatenate([in_run[1:], [False]]))
    if not len(starts):
        return
    left = before[order]
    # If a whole run is preceded by one byte, so is every interval in it.
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        if change[hi] == change[lo]:
            continue
        stack: list[list[int]] = []                      # [length, first, byte before or -2 if they differ]
        heights = [*lcp[lo + 1:hi + 1].tolist(), 0]
        chars = left[lo:hi + 1].tolist()
        for i, h in enumerate(heights):
            first, char = lo + i, chars[i]
            while stack and stack[-1][0] > h:
                size, first, c = stack.pop()
                char = c if c == char else -2
                if char == -2:
                    yield size, first, lo + i
            if h >= least and (not stack or stack[-1][0] < h):
                stack.append([h, first, char])
            elif stack:
                if stack[-1][2] != char:
                    stack[-1][2] = -2


def covered(parts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """Maximal covered stretches ``(part, start, end)`` of ``parts``: bytes of occurrences of maximal repeats."""
    sizes = np.array([len(p) for p in parts], np.int64)
    x = np.frombuffer(b"".join(parts), np.uint8)
    if len(x) < 2:
        return
    ends = np.cumsum(sizes)
    begin = ends - sizes
    owner = np.repeat(np.arange(len(parts)), sizes)
    room = ends[owner] - np.arange(len(x))
    order, ranks = suffix_array(x, room)
    # Only suffixes with a whole window left in their segment take part.
    order = order[room[order] >= length]
    if len(order) < 2:
        return
    lcp = common_prefixes(order, ranks, room)
    before = np.concatenate([[-3], x[:-1].astype(np.int64)])
    before[begin] = -3 - np.arange(len(begin))
    mark = np.zeros(len(x) + 1, np.int64)
    for size, first, last in maximal_repeats(order, lcp, before, length):
        at = order[first:last + 1]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + size, -1)
    hit = np.cumsum(mark[:-1]) > 0
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    opens = np.flatnonzero(hit & (new | ~np.concatenate([[False], hit[:-1]])))
    closes = np.flatnonzero(hit & np.concatenate([new[1:] | ~hit[1:], [True]]))
    for a, b in zip(opens.tolist(), closes.tolist()):
        k = int(owner[a])
        yield k, a - int(begin[k]), b + 1 - int(begin[k])


# --- Spark jobs --------------------------------------------------------------------------------------


def _occurrences(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` of grams that occur more than once, with ``mixed``: whether their segments differ."""
    grams = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("w"), (F.min("c") != F.max("c")).alias("mixed"))
                    .where("w > 1"), "repeats-grams")
    total = max(grams.agg(F.sum("w")).first()[0] or 0, 1)
    hot = grams.where(F.col("w") > F.lit(total / HOT_KEYS)).select("g", F.col("mixed").alias("hot"))   # < HOT_KEYS rows
    cold = grams.where(F.col("w") <= F.lit(total / HOT_KEYS)).select(F.col("g").alias("_j"), "mixed")
    keyed = rows.join(F.broadcast(hot), "g", "left").withColumn(
        "_j", F.when(F.col("hot").isNull(), F.col("g")).otherwise(F.xxhash64("id", "th", "start")))
    return written(keyed.join(cold, "_j", "left").withColumn("mixed", F.coalesce("hot", "mixed"))
                   .where("mixed IS NOT NULL").select(*names, "mixed"), "repeats-occurrences")


def _collapse(rows: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose equal occurs elsewhere, one row per distinct content of each group with its ``m``).

    ``rows`` have a group ``g``, content ``c``, and ``copies``: how many equal
    occurrences a row stands for; rows that stand for more than one are covered already.
    """
    cols = ["id", "th", "start", "n", "off", *extra]
    kinds = written(rows.groupBy("g", "c").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("w"),
                                               F.min(F.struct(*cols)).alias("r")), "repeats-kinds")
    again = kinds.where("copies > 1 AND w > 1").select("g", "c", "w")
    total = max(rows.count(), 1)
    known = join_weighted(rows.where("copies = 1").select("g", "c", "id", "th", "start", "n"), again, ["g", "c"], "w",
                          total, "inner").select("id", "th", "start", "n")
    groups = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    distinct = join_weighted(kinds.select("g", "c", "copies", "r.*"), groups.withColumn("_w", F.col("m")), ["g"], "_w",
                             total, "inner")
    return known, distinct


def _fetch(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` segments with their bytes ``x``; of rows with one key (equal texts) one is read."""
    asked = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "off", "g", "c", "copies", "m")).alias("q"))
    out = pa.schema([*_KEY, ("start", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("g", pa.int64()),
                     ("c", pa.int64()), ("copies", pa.int64()), ("m", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(b.num_rows):          # one document's segments at a time
                d, th, z, q = (b.column(k)[i].as_py() for k in range(4))
                raw = unpack(z)
                rows = [(d, th, s["start"], s["n"], s["off"], s["g"], s["c"], s["copies"], s["m"],
                         raw[s["start"]:s["start"] + s["n"] - 1 + length]) for s in q]
                yield _frame([list(c) for c in zip(*rows)], out)

    once = texts.where(F.col("n_bytes") >= length).select("id", "th", "z").dropDuplicates(["id", "th"])
    return once.join(asked, ["id", "th"]).mapInArrow(
        run, "id long, th long, start int, n int, off int, g long, c long, copies long, m long, x binary")


def _narrow(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Rows of too large groups, cut into ranges of ``width`` offsets and grouped by the bytes that all windows
    of a range hold."""
    out = pa.schema([*_KEY, ("start", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("g", pa.int64()),
                     ("c", pa.int64()), ("copies", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                off, n, x = r["off"], r["n"], r["x"]
                for k in range((off - n + 1) // width, off // width + 1):
                    # Offsets of the range, and those of its windows that the row has.
                    l0, l1 = k * width, k * width + width - 1
                    a, z = max(off - l1, 0), min(off - l0, n - 1)
                    core = x[off - l0:off - l1 + length]
                    part = x[a:z + length]
                    g = xxhash.xxh3_64_intdigest(core + r["g"].to_bytes(8, "little", signed=True), k & 0xFFFF)
                    rows.append((r["id"], r["th"], r["start"] + a, z - a + 1, off - a, g - (1 << 63),
                                 _content(part, off - a), r["copies"], part))
            for i in range(0, len(rows), 5000):
                yield _frame([list(c) for c in zip(*rows[i:i + 5000])], out)

    return rows.select("id", "th", "start", "n", "off", "g", "copies", "x").mapInArrow(
        run, "id long, th long, start int, n int, off int, g long, c long, copies long, x binary")


def _suffix_search(rows: DataFrame, length: int) -> DataFrame:
    """Covered stretches of segments of small groups, by suffix arrays over whole groups."""
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["g", "c"], kind="stable")
        ids, ths, starts, copies = (f[c].to_numpy() for c in ("id", "th", "start", "copies"))
        found = [(ids[k], ths[k], starts[k] + a, starts[k] + b) for k, a, b in covered(f["x"].tolist(), length)
                 if copies[k] == 1]
        return pd.DataFrame(found, columns=["id", "th", "a", "b"]).astype({"id": "int64", "th": "int64", "a": "int32",
                                                                         "b": "int32"})

    return rows.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards))).groupBy("shard").applyInPandas(
        search, "id long, th long, a int, b int")


def repeated_stretches(docs: DataFrame, texts: DataFrame, length: int = LENGTH, gram: int = GRAM,
                       group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(id, th, a, b)``: byte ranges of rows that repeated strings cover; they overlap. ``id, th`` is the row's key.

    ``docs`` are ``(doc_id, text)`` and ``texts`` the same rows as ``_texts`` packs them.
    """
    seen = _occurrences(_segment_rows(docs, length, gram), ["id", "th", "start", "n", "off", "g", "c"])
    whole = seen.where("NOT mixed").select("id", "th", "start", "n")
    known, distinct = _collapse(seen.where("mixed").drop("mixed").withColumn("copies", F.lit(1).cast("long")), [])
    ranges = [whole, known]
    rows = written(_fetch(texts, distinct, length), "repeats-segments")
    found, width = [], length - gram + 1
    while True:
        found.append(written(_suffix_search(rows.where(F.col("m") <= group_limit), length), "repeats-stretches"))
        large = rows.where(F.col("m") > group_limit)
        if large.isEmpty():
            break
        width = max(1, -(-width // NARROWER))
        known, distinct = _collapse(written(_narrow(large, width, length), "repeats-narrow"), ["x"])
        ranges.append(known)
        rows = written(distinct, "repeats-segments")
    out = None
    for r in [r.select("id", "th", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b"))
              for r in ranges] + found:
        out = r if out is None else out.unionByName(r)
    return out


def _merge(stretches: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans`` (maximal removed byte runs) and ``kept`` (the other bytes).

    A byte goes if a ``length``-byte string over it also starts anywhere else,
    in the same document or another; strings are judged on the input. NULL
    text counts as empty, a repeated row is a copy like any other, texts
    shorter than ``length`` stay whole, other columns play no part, and an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = written(_texts(docs), "repeats-texts")
    # Sets, since rows that repeat a text under one id bring the same stretches.
    spans = (repeated_stretches(docs, texts, length, gram, group_limit).groupBy("id", "th")
             .agg(F.collect_set(F.struct("a", "b")).alias("s")))
    weighed = spans.join(texts.groupBy("id", "th").agg(F.count(F.lit(1)).alias("w")), ["id", "th"])
    joined = join_weighted(texts, weighed, ["id", "th"], "w", max(texts.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for d, n, z, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw, gone = unpack(z) if n else b"", _merge([(x["a"], x["b"]) for x in s or ()])
                edges = [0, *[e for g in gone for e in g], len(raw)]
                for c, v in zip(cols, (d, n, [{"start": x, "end": y} for x, y in gone],
                                       b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])))):
                    c.append(v)
            yield _frame(cols, out)

    return joined.select("doc_id", "n_bytes", "z", "s").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """Counts and the digest of what ``remove_repeats`` keeps."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                          F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                          (F.col("n_bytes") > F.length("kept")).alias("has_repeats"))
