"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates side by side without a join.

    The rows are stacked (each frame fills its own columns) and folded by a
    final ``max`` that ignores the NULL gaps.
    """
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def evaluate_once(df: DataFrame, *cols: str) -> DataFrame:
    """Keep ``cols`` computed once per row.

    Catalyst pushes a filter below the projection that defines the columns it
    tests, copying their expressions into the filter; an expensive column then
    runs twice (in the filter and in the projection). Passing the columns
    through a one-row generator stops that copy: a filter on a generator's
    output cannot move below it.
    """
    others = [c for c in df.columns if c not in cols]
    packed = F.array(F.struct(*[F.col(c).alias(c) for c in cols]))
    return df.select(*others, F.inline(packed)).select(*df.columns)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])
