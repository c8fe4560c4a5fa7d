"""PII-safe projections, name-based redaction, row caps and leak scans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The mask text, the result cap and the leak markers.
MASK = "[REDACTED]"
MAX_ROWS = 100
LEAK_MARKERS = ("@", "+1-555-")


def safe_customers(customers_raw: DataFrame) -> DataFrame:
    """The masked projection. The mask is a literal, so Catalyst prunes the
    raw email/phone columns out of the scan and no later alias or expression
    can reach them (P2)."""
    return customers_raw.select("id", "name", F.lit(MASK).alias("email"),
                                F.lit(MASK).alias("phone"), "created_at", "tier")


def cap_rows(df: DataFrame, n: int = MAX_ROWS, order_by: Iterable[str] = ("id",)) -> DataFrame:
    """At most ``min(n, 100)`` rows, in a deterministic order."""
    return df.orderBy(*order_by).limit(min(n, MAX_ROWS))


def redact(df: DataFrame, names: Iterable[str], mask: str = MASK) -> DataFrame:
    """Mask result columns by *name* (misses renamed columns, by design)."""
    present = [c for c in names if c in df.columns]
    return df.withColumns({c: F.lit(mask) for c in present}) if present else df


def leak_flag(col: str) -> F.Column:
    """Any leak marker in the value (plain ``contains`` terms keep codegen)."""
    c = F.col(col).cast("string")
    hit = F.lit(False)
    for m in LEAK_MARKERS:
        hit = hit | F.contains(c, F.lit(m))
    return F.coalesce(hit, F.lit(False))


def find_leaks(df: DataFrame, cols: Iterable[str], source: str) -> DataFrame:
    """P5: per column, rows scanned and rows holding an ``@`` or ``+1-555-``."""
    cols = list(cols)
    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(leak_flag(c)).alias(f"leak_{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', leak_{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"'{source}' AS source", "rows",
                           f"stack({len(cols)}, {stack}) AS (`column`, leak_rows)")


def pii_split(spark: SparkSession, raw_path: str, private_dir: str) -> DataFrame:
    """Move the raw table into the private zone and expose only P1.

    Refuses when neither the raw table nor the private copy exists (never
    creates an empty view); running it twice is a no-op.
    """
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(raw_path), jvm.org.apache.hadoop.fs.Path(private_dir)
    fs = src.getFileSystem(conf)
    if not fs.exists(dst):
        if not fs.exists(src):
            raise FileNotFoundError(f"raw customer table missing: {raw_path}")
        fs.mkdirs(dst.getParent())
        if not fs.rename(src, dst):
            raise OSError(f"could not move {raw_path} to {private_dir}")
    return safe_customers(spark.read.parquet(private_dir))
