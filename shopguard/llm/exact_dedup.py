"""Exact dedup by skew-safe combining.

Equal texts meet in three steps: each task first combines its own copies, the
task-local winners of one digest then meet per salt, and the salt winners meet
once per digest. The whole normalised text is a grouping key of every step, so
a digest only decides where rows meet, never whether they are equal. A text
that a third of all rows share leaves each task as one row and each salt as
one row, so no task sees the hot group whole.

Texts that have no equal need not move. A first pass counts 64-bit hashes; those
that occur twice or more mark bits in a bitmap of fixed size. A row whose bit is
not marked has no equal and stays where it is; all others go through the steps
above, so a bit that two texts share by chance costs a move and changes no result.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import join_weighted, written

SALTS = 16
# Bits of the map of hashes that occur more than once: 32 MB at most, whatever the input. With more
# marks than bits most rows move, as they would without it.
MARK_BITS = 1 << 28


def normalise(text: Column) -> Column:
    """Lower-case A-Z only; NULL counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _marked(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``__marked``: false only where no other row's ``text`` is equal, A-Z counting as a-z."""
    # Texts that are equal after lower-casing A-Z are equal in their full lower case, which is cheaper to compute.
    hashed = rows.withColumn("__h", F.xxhash64(F.lower(F.coalesce(text, F.lit("")))))
    spot = F.pmod("__h", F.lit(MARK_BITS))
    twice = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    marks = written(twice.groupBy(F.bitmap_bucket_number(spot).alias("__bucket"))
                    .agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("__bits")), "exact-dedup-marks")
    placed = hashed.withColumns({"__bucket": F.bitmap_bucket_number(spot), "__bit": F.bitmap_bit_position(spot)})
    byte = "cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return (placed.join(F.broadcast(marks), "__bucket", "left")
            .withColumn("__marked", F.expr(f"coalesce(shiftright({byte}, cast(__bit % 8 as int)) & 1, 0) = 1"))
            .drop("__h", "__bucket", "__bit", "__bits"))


def combine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            salts: int = SALTS, digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row per distinct normalised text: ``digest, norm, keep_id, group_size``."""
    rows = (docs.select(F.col(id_col).alias("keep_id"), normalise(F.col(text_col)).alias("norm"))
            .select("keep_id", "norm", digest(F.col("norm")).alias("digest"),
                    F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")))
    # Partial aggregation is the local step, its merge the salted step.
    salted = rows.groupBy("digest", "salt", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def assign_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  salts: int = SALTS,
                  digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. NULL texts equal the empty text; a NULL id is
    smaller than every other, so it stays only where all ids of the group are
    NULL (``keep_id`` is then NULL). Of repeated rows with the same id and text
    exactly one is kept. Other columns of ``docs`` play no part. An empty table
    gives an empty result.
    """
    rows = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"))
    digests = written(rows.select("doc_id", "__marked", normalise(F.col("text")).alias("norm"))
                      .select("doc_id", "__marked", digest(F.col("norm")).alias("digest"),
                              sha256_bytes(F.col("norm")).alias("sha")), "exact-dedup-docs")
    alone = digests.where("NOT __marked").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
    narrow = digests.where("__marked").drop("__marked")
    total = narrow.count()
    groups = written(combine(rows.where("__marked"), "doc_id", "text", salts, digest)
                     .select("digest", sha256_bytes(F.col("norm")).alias("sha"), "keep_id",
                             "group_size"), "exact-dedup-groups")
    # Digests under which full comparison found two texts: joined on the text's SHA-256 as well
    # as the digest, which separates every text the combining steps told apart.
    twins = groups.where("group_size > 1").withColumn("_weight", F.col("group_size"))
    joined = join_weighted(narrow, twins, ["digest", "sha"], "_weight", max(total, 1))
    full = joined.select(
        "doc_id", "sha",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    # Repeated rows (same id, same text) come back as often as they went in, one of them kept.
    counted = full.groupBy("doc_id", "sha", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("_n"))
    return alone.unionByName(counted.select(
        "doc_id", "keep_id", "group_size",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"),
        F.lower(F.hex("sha")).alias("text_sha256")) \
        .select("doc_id", "keep_id", "group_size",
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
                "text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts one row with the largest id.

    A row without an id stays only where no equal text has one (see ``assign_groups`` for the other cases).
    """
    # The row travels whole in one column, so that its columns' names meet no name used here.
    rows = _marked(docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")),
                   F.col("__text"))
    shared = rows.where("__marked")
    # Rows that repeat an id and text become one on both sides of the shuffle; the join then moves only the keys that stay.
    key = F.coalesce(F.concat(F.lit("="), F.col("__id").cast("string")), F.lit("null")).alias("__key")
    once = (shared.select("__row", key, sha256_bytes(normalise(F.col("__text"))).alias("__sha"))
            .groupBy("__key", "__sha").agg(F.first("__row").alias("__row")))
    kept = F.coalesce(F.concat(F.lit("="), F.col("keep_id").cast("string")), F.lit("null")).alias("__key")
    stay = combine(shared, "__id", "__text", salts).select(kept, sha256_bytes(F.col("norm")).alias("__sha"))
    stays = rows.where("NOT __marked").select("__row").unionByName(
        once.join(stay, ["__key", "__sha"], "left_semi").select("__row"))
    return stays.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
