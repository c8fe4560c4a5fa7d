"""Connected components of an edge table by alternating large-star and small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import join_weighted, written


def _stars(edges: DataFrame, total: int) -> DataFrame:
    """``(u, v, m)``: every edge with the smallest of u and its neighbours."""
    mins = edges.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_deg"))
    mins = mins.select("u", F.least("u", "_m").alias("m"), "_deg")
    return join_weighted(edges, mins, ["u"], "_deg", max(total, 1), "inner")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges`` (columns ``a, b``, no NULLs).

    ``component`` is the smallest node that can be reached. Each round is a few
    grouped aggregations and joins, written to the shared folder; only a row
    count and a checksum come to the driver. An empty edge table gives an empty
    result. A hub's edges are spread by ``join_weighted``.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                               F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        n, checksum = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, checksum) == state or n == 0:
            break
        state = (n, checksum)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_stars(both, 2 * n).where("v > u").select(F.col("v").alias("u"),
                                                                  F.col("m").alias("v")).distinct(),
                        "large-star")
        k = large.count()
        small = _stars(large, k)
        now = written(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                     F.struct("u", F.col("m").alias("v")))).alias("e"))
                      .select("e.u", "e.v").where("u <> v").distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
