"""Text sources and sinks: CSV, audit NDJSON, mixed-shape audit exports,
access-request listings, JSON-array and CSV exports (S2-S4, S6-S8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopguard.operators.common import join_null_safe
from shopguard.session import written_table
from shopguard.sources.tables import AUDIT

CORRUPT = "_corrupt_record"


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Load ``df`` into a written table and return it with counts over all rows that went by, taken in the
    pass that loads (S2-S4): the source is read once."""
    seen = Observation(name)
    table = written_table(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return table, {k: seen.get[k] for k in counts}


# --------------------------------------------------------------------------- S2
def write_csv(df: DataFrame, path: str) -> None:
    """Header-less CSV with minimal quoting (quote only fields that need it); blanks are kept."""
    (df.write.mode("overwrite").option("header", False).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def load_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Header-less CSV with a given column list. ``multi_line`` lets quoted
    fields span lines, at the price of one task per file."""
    return (spark.read.schema(schema).option("header", False).option("multiLine", multi_line)
            .option("escape", '"').option("mode", "FAILFAST").csv(path))


def csv_row_count(loaded: DataFrame) -> DataFrame:
    """The number of rows a load brought in."""
    return loaded.agg(F.count(F.lit(1)).alias("rows"))


def load_counted_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """The loaded rows and how many there are."""
    table, seen = observed(load_csv(spark, path, schema), "csv-load", rows=F.count(F.lit(1)))
    return table, seen["rows"]


# --------------------------------------------------------------------------- S3
def load_audit(spark: SparkSession, path: str) -> DataFrame:
    """S3: audit NDJSON with the fixed schema. Unknown fields are ignored, a
    malformed line becomes one row whose ``_corrupt_record`` holds the text."""
    schema = T.StructType(AUDIT.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def load_counted_audit(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """S3: the records, with the lines read and how many of them were malformed."""
    bad = F.col(CORRUPT).isNotNull()
    table, seen = observed(load_audit(spark, path), "audit-load", lines=F.count(F.lit(1)), malformed=F.count_if(bad))
    return table.where(~bad & F.col("id").isNotNull()).drop(CORRUPT), seen


def audit_scan_report(audit: DataFrame) -> DataFrame:
    """Rows read and malformed lines of an S3 scan.

    Spark refuses a raw-JSON query that reads only the corrupt-record column,
    so ``id`` is read alongside it."""
    bad = F.col(CORRUPT).isNotNull()
    return audit.agg(F.count(F.lit(1)).alias("lines"),
                     F.count_if(bad).alias("malformed"),
                     F.count_if(~bad & F.col("id").isNotNull()).alias("records"))


# --------------------------------------------------------------------------- S4
def flatten_audit(docs: DataFrame, col: str = "doc") -> DataFrame:
    """Each JSON document is an array of records, ``{queries: [...]}``,
    ``{activities: [...]}`` or one bare record; the tests run in that order.
    Returns one row per record as ``record`` (VARIANT) plus its position; a
    document that doesn't parse has no records (``unparsable`` counts those)."""
    v = F.try_parse_json(F.col(col))
    t = F.schema_of_variant(v)
    q = F.try_variant_get(v, "$.queries", "array<variant>")
    a = F.try_variant_get(v, "$.activities", "array<variant>")
    records = (F.when(t.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
               .when(q.isNotNull(), q).when(a.isNotNull(), a)
               .when(v.isNotNull(), F.array(v)))
    shape = (F.when(t.startswith("ARRAY"), "array").when(q.isNotNull(), "queries")
             .when(a.isNotNull(), "activities").otherwise("record"))
    keep = [c for c in docs.columns if c != col]
    return docs.select(*keep, shape.alias("shape"),
                       F.posexplode(records).alias("pos", "record"))


def flatten_counted_audit(docs: DataFrame, col: str = "doc") -> tuple[DataFrame, dict[str, int]]:
    """The records, with the documents read and how many of them are no JSON; each is parsed once."""
    parsed = docs.select(*[c for c in docs.columns if c != col], F.try_parse_json(F.col(col)).alias(col), F.col(col).isNotNull().alias("_text"))
    table, seen = observed(parsed.select("*", F.to_json(col).alias("_json")).drop(col).withColumnRenamed("_json", col), "audit-documents",
                           documents=F.count(F.lit(1)), unparsable=F.count_if(F.col("_text") & F.col(col).isNull()))
    return flatten_audit(table.drop("_text"), col), seen


def unparsable(docs: DataFrame, col: str = "doc") -> DataFrame:
    """Documents and those of them that are no JSON."""
    return docs.agg(F.count(F.lit(1)).alias("documents"),
                    F.count_if(F.col(col).isNotNull() & F.try_parse_json(F.col(col)).isNull()).alias("unparsable"))


def record_field(name: str, typ: str = "string") -> F.Column:
    return F.try_variant_get(F.col("record"), f"$.{name}", typ)


# --------------------------------------------------------------------------- S6
def segment_records(lines: DataFrame, block: int = 4096, header_pattern: str = r"^aq-",
                    part_lines: int = 4096) -> DataFrame:
    """Records start at a line whose first field matches ``header_pattern``
    and run to the next such line. ``lines`` has ``file, line_no, line``.

    A record leaves as parts of at most ``part_lines`` lines, numbered from 0, so one that
    never ends (a listing without a further header) does not meet in one row; ``whole_records`` puts parts together.

    The "last header at or before this line" is found without one window over a
    whole file: lines are cut into blocks of ``block`` line numbers, a running
    max runs inside each block, and the carry-in from earlier blocks comes from
    a small per-block table (one row per block).
    """
    first_field = F.split(F.trim("line"), r"\s+")[0]
    # The header carries its id, so that later parts know it.
    head = F.when(first_field.rlike(header_pattern), F.struct(F.col("line_no").alias("at"), first_field.alias("id")))
    l = lines.withColumn("_blk", F.floor(F.col("line_no") / block)).withColumn("_head", head)
    per_block = l.groupBy("file", "_blk").agg(F.max("_head").alias("_blk_head"))
    wb = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.withColumn("_carry", F.max("_blk_head").over(wb)).drop("_blk_head")
    wl = Window.partitionBy("file", "_blk").orderBy("line_no") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = (join_null_safe(l, carry, ["file", "_blk"])
             .withColumn("_rec", F.coalesce(F.max("_head").over(wl), F.col("_carry")))
             .where(F.col("_rec").isNotNull()))
    part = F.floor((F.col("line_no") - F.col("_rec.at")) / part_lines)
    return (owned.groupBy("file", F.col("_rec.at").alias("start_line"), F.col("_rec.id").alias("record_id"), part.alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_ls"))
            .select("file", "start_line", "record_id", "part",
                    F.concat_ws("\n", F.transform("_ls", lambda x: x["line"])).alias("text")))


def whole_records(parts: DataFrame) -> DataFrame:
    """S6 on request: each record's whole text, its parts put together in one row."""
    return (parts.groupBy("file", "start_line", "record_id")
            .agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("_ps"))
            .select("file", "start_line", "record_id", F.concat_ws("\n", F.transform("_ps", lambda x: x["text"])).alias("text")))


# --------------------------------------------------------------------------- S7/S8
def to_json_array(df: DataFrame, key: str | None = None) -> DataFrame:
    """S7 contract path: a JSON array per group (or one for all rows); ``[]``
    when empty. Meant for capped results (the agent's query results); large
    outputs use ``write_ndjson``."""
    rec = F.struct(*[F.col(c) for c in df.columns if c != key])
    if key is None:
        agg = df.agg(F.to_json(F.array_sort(F.collect_list(rec))).alias("json"))
        return agg.select(F.coalesce("json", F.lit("[]")).alias("json"))
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(rec))).alias("json"))


def write_ndjson(df: DataFrame, path: str) -> None:
    """S7 scale path: newline-delimited JSON, one file per partition."""
    df.write.mode("overwrite").json(path)


def read_csv_with_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The fields of such an export; a header that doesn't name the columns fails."""
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"')
            .option("mode", "FAILFAST").csv(path))


def write_csv_with_header(df: DataFrame, path: str) -> None:
    """CSV export with a header line; blanks are kept."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
