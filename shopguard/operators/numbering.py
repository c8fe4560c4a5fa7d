"""Consecutive row numbers in a global order without a single-partition window.

``row_number() over (order by k)`` with no partition key moves every row into
one task. Instead the rows are range-partitioned on the keys, each range is
numbered by its own task, and the ranges' row counts, summed in order, become
offsets. Only one count per partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OrderKey = tuple[str, bool]  # (column, ascending)


class Ranges:
    """Rows written in ranges of ``keys`` (unique and non-null), each sorted by its own task, with the ranges' counts.

    A row's place in its range is kept, so a row number is the range's offset plus that place:
    nothing is shuffled again, and a lost executor does not send the job back to the source.
    """

    def __init__(self, df: DataFrame, keys: Sequence[OrderKey]):
        from shopguard.session import written_table

        keys = [(k, True) if isinstance(k, str) else k for k in keys]
        order = [F.col(k).asc() if a else F.col(k).desc() for k, a in keys]
        # The identifier holds the partition above its 33rd bit and the row's place in it below.
        rows = written_table(df.repartitionByRange(*order).sortWithinPartitions(*order)
                             .withColumn("_place", F.monotonically_increasing_id()), "ranges")
        self.rows = (rows.withColumn("_part", F.shiftright("_place", 33).cast("int"))
                     .withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))))
        # One count per range comes to the driver.
        self.counts = sorted((r["_part"], r["count"]) for r in self.rows.groupBy("_part").count().collect())
        self.starts = dict(zip([p for p, _ in self.counts], accumulate([n for _, n in self.counts[:-1]], initial=0)))

    def numbered(self, name: str = "rn", first: int = 1) -> DataFrame:
        """All rows with ``name`` = first, first + 1, ... in the order of the keys."""
        offsets = self.rows.sparkSession.createDataFrame(list(self.starts.items()), "_part int, _offset long")
        # One offset per partition: the broadcast is bounded by the shuffle partition count.
        return (self.rows.join(F.broadcast(offsets), "_part")
                .withColumn(name, F.col("_offset") + F.col("_place") + F.lit(first).cast("long"))
                .drop("_part", "_offset", "_place"))

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows numbered from ``offset`` (0-based) on: only the ranges that hold them are read."""
        wanted = [(p, self.starts[p]) for p, n in self.counts if self.starts[p] < offset + limit and self.starts[p] + n > offset]
        hit = F.lit(False)
        for p, start in wanted:
            hit = hit | ((F.col("_part") == p) & F.col("_place").between(offset - start, offset + limit - 1 - start))
        return self.rows.where(hit).orderBy("_part", "_place").drop("_part", "_place")


def global_row_number(df: DataFrame, keys: Sequence[OrderKey], name: str = "rn") -> DataFrame:
    """Add ``name`` = 1..n in the order of ``keys`` (which must be unique and non-null)."""
    return Ranges(df, keys).numbered(name)
