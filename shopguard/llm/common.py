"""Helpers the training-data operators share: table reads, written intermediate
tables, and a join that no hot key can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopguard.session import checkpoint_dir, scratch_path

# A key that holds more than 1/HOT_KEYS of the rows is hot, so there are fewer
# than HOT_KEYS hot keys whatever the size of the input.
HOT_KEYS = 4096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet`` through Spark's own reader."""
    checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The copy cuts the lineage: a lost executor costs one task, not the whole
    job, and the table can be read more than once without being recomputed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """NULL-safe equality of ``keys`` between two frames."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def join_weighted(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str,
                  total: int, how: str = "left") -> DataFrame:
    """Join ``big`` with ``small`` (unique ``keys``) without a hot shuffle key.

    ``small[weight]`` is the number of rows of ``big`` with that key and
    ``total`` the number of rows of ``big``. Keys with more than
    ``total / HOT_KEYS`` rows number fewer than HOT_KEYS, so they are broadcast
    (a proven bound) and ``big`` keeps its partitioning for them; every other
    key is joined by a shuffle in which no key is hot. ``how`` is ``left`` or
    ``inner``; NULL keys match nothing. ``weight`` is dropped.
    """
    keys = list(keys)
    hot = small.where(F.col(weight) > F.lit(total / HOT_KEYS)).drop(weight)
    cold = small.where(F.col(weight) <= F.lit(total / HOT_KEYS)).drop(weight)
    hits = big.join(F.broadcast(hot), keys, "inner")
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return hits.unionByName(rest)
