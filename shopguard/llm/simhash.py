"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint is the bitwise majority of its shingles' XXH64 hashes.
Fingerprints within ``max_bits`` differing bits are linked. Distinct
fingerprints (exact copies collapse to one) are dealt into buckets by bit
masks: of ``max_bits + 1`` disjoint blocks of the 64 bits at least one agrees
in any linked pair, so a pair meets in some block's bucket. Each group of
buckets is one index: fingerprints sorted by Gray rank, upper nodes holding the
bits that all fingerprints below them share (mask and value), searched from
the top with accumulated differences, so a whole group is pruned at once.

A bucket with more fingerprints than ``bucket_limit`` is dealt again by the
blocks of its remaining bits (exactly, by the same argument) until it fits.
Inside a task the search emits one link per fingerprint to the smallest member
of its local component, never all pairs; components join the links globally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import join_weighted, written
from shopguard.llm.components import components

SHINGLE = 3
MAX_BITS = 3
FANOUT = 8
# Fingerprints one bucket may bring to a task, and about as many buckets' worth per index.
BUCKET_LIMIT = 4096
QUERY_BLOCK = 256


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text (UTF-8): bit j is 1 if set in over half of the shingle hashes."""
    words = raw.lower().split()          # ASCII letters and the six ASCII blanks only
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return h(joined, 42)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    hashes = np.array([h(joined[a:b], 42) for a, b in
                       zip(starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):   # bounded scratch for very long texts
        part = hashes[i:i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``: fp is the fingerprint as a signed 64-bit integer; NULL text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()],
                           dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")) \
        .mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the Gray sequence (inverse Gray code)."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchical index over codes sorted by Gray rank.

    ``levels[0]`` are the codes (every bit fixed); a node of ``levels[i + 1]``
    covers FANOUT nodes of ``levels[i]`` and holds the bits they all share.
    """

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.fanout = fanout
        full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(full, codes)]
        while len(self.levels[-1][0]) > fanout:
            mask, value = self.levels[-1]
            first = np.arange(0, len(mask), fanout)
            owner = np.arange(len(mask)) // fanout
            shared = np.bitwise_and.reduceat(mask, first)
            differ = np.bitwise_or.reduceat(value ^ value[first][owner], first)
            shared &= ~differ
            self.levels.append((shared, value[first] & shared))

    def search(self, queries: np.ndarray, fixed: np.ndarray, max_bits: int,
               own: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, code position) pairs within ``max_bits`` that agree on the query's ``fixed`` bits.

        Differences add up on the way down: a node is charged only for bits its
        parent did not fix. A node whose members all carry the query's own
        component label is skipped as well.
        """
        top = len(self.levels) - 1
        uniform = [labels]
        for mask, _ in self.levels[1:]:
            below = uniform[-1]
            first = np.arange(0, len(below), self.fanout)
            lo, hi = np.minimum.reduceat(below, first), np.maximum.reduceat(below, first)
            uniform.append(np.where(lo == hi, lo, -1))
        n_top = len(self.levels[top][0])
        q = np.repeat(np.arange(len(queries)), n_top)
        node = np.tile(np.arange(n_top), len(queries))
        acc = np.zeros(len(q), np.int64)
        parent_mask = np.zeros(len(q), np.uint64)
        for level in range(top, -1, -1):
            mask, value = self.levels[level]
            m = mask[node]
            diff = (queries[q] ^ value[node]) & m & ~parent_mask
            acc = acc + np.bitwise_count(diff)
            keep = (acc <= max_bits) & ((diff & fixed[q]) == 0) & (uniform[level][node] != own[q])
            q, node, acc, m = q[keep], node[keep], acc[keep], m[keep]
            if level:
                n_below = len(self.levels[level - 1][0])
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                q, acc, parent_mask = (np.repeat(x, self.fanout) for x in (q, acc, m))
                real = node < n_below
                q, node, acc, parent_mask = q[real], node[real], acc[real], parent_mask[real]
        return q, node


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each component after linking positions ``a`` and ``b``."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            nxt = labels[labels]
            if np.array_equal(nxt, labels):
                break
            labels = nxt
        differ = labels[a] != labels[b]
        a, b = a[differ], b[differ]
    return labels


def local_links(codes: np.ndarray, fixed: np.ndarray, max_bits: int = MAX_BITS,
                block: int = QUERY_BLOCK) -> np.ndarray:
    """For each code, the position of its local component's representative.

    ``fixed`` holds the bits a code's bucket agrees on; codes are linked within
    ``max_bits`` where they agree on them. A code of several buckets comes once per bucket.
    """
    order = np.lexsort((gray_rank(codes), gray_rank(codes & fixed), fixed))   # bucket by bucket
    codes, fixed = codes[order], fixed[order]
    labels = np.arange(len(codes))
    index = GrayIndex(codes)
    for i in range(0, len(codes), block):
        part = slice(i, min(i + block, len(codes)))
        q, hit = index.search(codes[part], fixed[part], max_bits, labels[part], labels)
        labels = _merge(labels, q + i, hit)
    out = np.empty(len(codes), np.int64)
    out[order] = order[labels]
    return out


def _split(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` runs of its free bits fixed in turn."""
    free = [j for j in range(64) if not mask >> j & 1]
    return [mask | sum(1 << j for j in run.tolist()) for run in np.array_split(free, parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(codes: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """Deal each row (``fp, node, fixed``) into one bucket per block of its free bits.

    The table of masks depends on the depth and ``parts`` alone, not on the data.
    """
    if len(masks) == 1:
        children = F.array(*[F.lit(_signed(c)).cast("long") for c in _split(masks[0], parts)])
        dealt = codes.select("fp", "node", F.explode(children).alias("fixed"))
    else:
        table = codes.sparkSession.createDataFrame(
            [(_signed(m), _signed(c)) for m in masks for c in _split(m, parts)], "fixed long, next long")
        dealt = codes.join(F.broadcast(table), "fixed").select("fp", "node", F.col("next").alias("fixed"))
    return dealt.withColumn("bits", F.col("fp").bitwiseAND(F.col("fixed")))


def links(codes: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` between nodes whose fingerprints are linked, a spanning set, not all pairs.

    ``codes`` has distinct ``fp`` and its ``node``. Every link within
    ``max_bits`` joins two nodes that the edges connect.
    """
    parts = max_bits + 1

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        node = pdf["node"].to_numpy()
        rep = local_links(fp, pdf["fixed"].to_numpy().view(np.uint64), max_bits)
        far = node != node[rep]
        return pd.DataFrame({"a": node[far], "b": node[rep][far]})

    masks, found = [0], None
    rows = codes.select("fp", "node", F.lit(0).cast("long").alias("fixed"))
    while True:
        dealt = _deal(rows, masks, parts)
        masks = [c for m in masks for c in _split(m, parts)]
        sizes = written(dealt.groupBy("fixed", "bits").agg(F.count(F.lit(1)).alias("n"))
                        .where("n > 1"), "simhash-buckets")
        n_rows, n_heavy = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)),
                                    F.count(F.when(F.col("n") > bucket_limit, 1))).first()
        light = dealt.join(sizes.where(F.col("n") <= bucket_limit).drop("n"), ["fixed", "bits"], "left_semi")
        shards = max(1, -(-int(n_rows) // bucket_limit))
        # A stated number of partitions, so that small but heavy shards are not put together.
        edges = written(light.withColumn("shard", F.pmod(F.xxhash64("fixed", "bits"), F.lit(shards)))
                        .repartition(shards, "shard").groupBy("shard").applyInPandas(search, "a long, b long").distinct(), "simhash-links")
        found = edges if found is None else found.unionByName(edges)
        if not n_heavy or all(m == (1 << 64) - 1 for m in masks):
            return found
        rows = written(dealt.join(sizes.where(F.col("n") > bucket_limit).drop("n"), ["fixed", "bits"],
                                  "left_semi").select("fp", "node", "fixed"), "simhash-heavy")


def _fingerprint_components(fps: DataFrame, max_bits: int, bucket_limit: int) -> DataFrame:
    """``(fp, n, best, component)`` per distinct fingerprint of ``fps`` (``fp, best``): its rows, their smallest
    ``best``, and the smallest fingerprint it is linked to."""
    codes = written(fps.groupBy("fp").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n")), "simhash-codes")
    comp = components(links(codes.select("fp", F.col("fp").alias("node")), max_bits, bucket_limit))
    return written(codes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                   .withColumn("component", F.coalesce("component", "fp")), "simhash-components")


def _best_of_components(codes: DataFrame) -> DataFrame:
    """``codes`` with the smallest ``best`` of their component."""
    least = codes.groupBy("component").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("_w"))
    return join_weighted(codes, least, ["component"], "_w", max(codes.count(), 1))


def assign_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                      bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reached over links, the document's own
    included. Links join fingerprints: NULL and blank texts have fingerprint zero, which links like any
    other; a document without an id links others, and its component is NULL
    where no document has one. Rows that repeat an id with another text are
    linked by their texts alone. Repeated rows come back as often as they went
    in. Other columns of ``docs`` play no part; an empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    total = fps.count()
    codes = _best_of_components(_fingerprint_components(fps.withColumn("best", F.col("doc_id")), max_bits, bucket_limit))
    joined = join_weighted(fps, codes.select("fp", "n", F.col("first").alias("component_id")), ["fp"], "n", max(total, 1))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does: that with the smallest id.

    A row without an id stays only where no row of its component has one. Of
    rows that tie one stays. An empty table gives an empty result.
    """
    rows = written(docs.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__rid")), "simhash-rows")
    fps = written(fingerprints(rows.select("__rid", F.col("__row")[text_col].alias("text")), "__rid", "text", shingle)
                  .withColumnRenamed("doc_id", "__rid"), "simhash-fingerprints")
    ids = rows.select("__rid", F.col("__row")[id_col].alias("id"))
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("__rid"))
    codes = _fingerprint_components(fps.join(ids, "__rid").select("fp", best.alias("best")), max_bits, BUCKET_LIMIT)
    stay = codes.groupBy("component").agg(F.min("best").alias("first")).select(F.col("first.__rid").alias("__rid"))
    return rows.join(stay, "__rid", "left_semi").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
