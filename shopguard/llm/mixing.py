"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output over
its share of the input. A document's count is a Poisson draw with that mean,
made by inverting the distribution at a hash of the seed and the document's
id, so a rerun, a lost task or another partitioning draws the same counts. The
copies are then shuffled globally by a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import join_weighted

# A rate above PIECE is drawn as a sum of independent draws with equal means of at most PIECE,
# so exp(-rate) stays far from underflow and the table of thresholds short.
PIECE = 16.0
STEPS = 100          # P(X > 100) < 2^-52 for every mean up to PIECE
UNIT = 1 << 52       # draws are 52-bit integers
# Largest table of sources that is broadcast; beyond it only hot sources are.
BROADCAST_SOURCES = 100_000


def _hash52(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def poisson_thresholds(mean: Column, steps: int = STEPS) -> Column:
    """``floor(P(X <= k) * 2^52)`` for k = 0..steps-1; a draw u means X = number of thresholds <= u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"),
                     F.array(F.floor(F.exp(-mean) * F.lit(float(UNIT))).cast("long")).alias("t"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"),
                        F.concat(acc["t"], F.array(F.floor(c * F.lit(float(UNIT))).cast("long"))).alias("t"))

    ks = F.sequence(F.lit(1), F.lit(steps - 1))
    return F.aggregate(F.transform(ks, lambda k: k.cast("double")), start, step, lambda acc: acc["t"])


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None,
                     default_weight: float = 1.0, total: int | None = None,
                     source_col: str = "source") -> DataFrame:
    """``(source, n, rate)`` per source: the mean number of copies of each of its documents.

    A source's target share is its weight over the sum of the weights of the
    sources present; sources not named get ``default_weight``. ``total`` is the
    expected output size (by default the input size). NULL is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default_weight))
    for s, w in (weights or {}).items():
        if w < 0 or not math.isfinite(w):
            raise ValueError(f"weight of {s!r} must be finite and not negative")
        weight = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    n_all, w_all = counts.agg(F.sum("n"), F.sum("w")).first()
    size = float(total if total is not None else n_all or 0)
    scale = size / w_all if w_all else 0.0
    return counts.select("source", "n", (F.lit(scale) * F.col("w") / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0,
        total: int | None = None, seed: int = 42, id_col: str = "doc_id",
        source_col: str = "source", shuffled: bool = True) -> DataFrame:
    """The replicated, globally shuffled documents: all columns of ``docs`` plus ``copy`` (from 1)
    and ``mix_key`` (the shuffle order).

    A NULL source is a source of its own; a NULL id draws as the id "null".
    Rows that repeat an id draw the same count. Texts may be NULL, empty or
    long; they are only carried. Columns of ``docs`` named ``copy`` or
    ``mix_key`` are replaced. An empty table gives an empty result.
    """
    rates = repetition_rates(docs, weights, default_weight, total, source_col)
    pieces = F.ceil(F.col("rate") / F.lit(PIECE)).cast("int")
    # A NULL source becomes a key of its own, so that the join finds it.
    rates = rates.where("rate > 0").select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("__source"),
        F.col("n").alias("__n"), pieces.alias("__pieces"),
        poisson_thresholds(F.col("rate") / pieces).alias("__thresholds"))
    keyed = docs.drop("copy", "mix_key").withColumn(
        "__source", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")))
    if rates.count() <= BROADCAST_SOURCES:
        rated = keyed.join(F.broadcast(rates.drop("__n")), ["__source"], "inner")
    else:
        rated = join_weighted(keyed, rates, ["__source"], "__n", max(docs.count(), 1), "inner")

    def draw(j: Column) -> Column:
        u = _hash52(F.lit(seed), F.col(id_col), j)
        return F.size(F.filter("__thresholds", lambda t: t <= u))

    n_copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("__pieces")), draw), F.lit(0),
                           lambda a, x: a + x)
    copies = (rated.withColumn("__copies", n_copies).where("__copies > 0")
              .drop("__source", "__pieces", "__thresholds")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")
              .withColumn("mix_key", F.md5(F.concat_ws(
                  ":", F.lit("order"), F.lit(str(seed)),
                  F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")))))
    return copies.orderBy("mix_key", id_col, "copy") if shuffled else copies
