"""Dataset lifecycle: fault injection, backup, repair, restore, snapshots.

Parquet tables have no in-place UPDATE/MERGE, so every step is a pure
``DataFrame -> DataFrame`` function; writers save a new version folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopguard import ANCHOR, RECONCILE_BATCH
from shopguard.functions.json import json_text
from shopguard.operators.common import one_row

# Fixed values of the fault scenario.
VICTIM_STATUSES = ("PENDING", "SHIPPED", "DELIVERED")
POISON_STATUS = "PENDING_RECONCILE"
SHAPE_A_ITEMS = "RECONCILE-BATCH-2026-08-28-A"
RECONCILE_SOURCE = "payments-migration-v2"
VICTIMS = 400
SHAPE_A_ROWS = 300


def choose_victims(orders: DataFrame, n: int = VICTIMS) -> DataFrame:
    """Newest ``n`` live orders by id, numbered 1..n.

    The limit runs first (TakeOrderedAndProject), so the numbering window sees
    only ``n`` rows instead of a global single-partition window.
    """
    top = (orders.where(F.col("status").isin(*VICTIM_STATUSES))
           .select("id").orderBy(F.desc("id")).limit(n))
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("id"))))


def _poison_payload(shape_a: F.Column) -> F.Column:
    shipping = F.coalesce(json_text("payload", "$.shipping"), F.lit("null"))
    item_b = F.to_json(F.struct(F.col("sku").alias("sku"), F.col("qty").alias("qty")))
    items = F.when(shape_a, F.lit(f'"{SHAPE_A_ITEMS}"')) \
        .otherwise(F.concat(F.lit("["), item_b, F.lit("]")))
    return F.concat(F.lit('{"schema":2,"channel":"partner-api","items":'), items,
                    F.lit(',"shipping":'), shipping,
                    F.lit(f',"reconcile_batch":"{RECONCILE_BATCH}",'
                          f'"reconcile_source":"{RECONCILE_SOURCE}"}}'))


def inject_fault(orders: DataFrame, victims: DataFrame, anchor: str = ANCHOR,
                 shape_a_rows: int = SHAPE_A_ROWS) -> DataFrame:
    """Rewrite the victims as PENDING_RECONCILE with malformed payloads.

    rn <= ``shape_a_rows`` get a string ``items`` (shape A), the rest an item
    without a price (shape B); created_at = anchor - rn * 3 s. ``victims`` is
    bounded by its limit, so it is broadcast.
    """
    hit = F.col("rn").isNotNull()
    created = F.lit(anchor).cast("timestamp_ntz") - F.make_dt_interval(secs=F.col("rn") * 3)
    return (orders.join(F.broadcast(victims), "id", "left")
            .select("id", "customer_id", "sku", "qty", "amount_cents",
                    F.when(hit, F.lit(POISON_STATUS)).otherwise(F.col("status")).alias("status"),
                    F.when(hit, created).otherwise(F.col("created_at")).alias("created_at"),
                    F.when(hit, _poison_payload(F.col("rn") <= shape_a_rows))
                    .otherwise(F.col("payload")).alias("payload")))


def backup_rows(orders: DataFrame, victims: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """Old status, payload and created_at of the victims."""
    return (orders.join(F.broadcast(victims.select("id")), "id")
            .select("id", "status", "payload", "created_at",
                    F.lit(anchor).cast("timestamp_ntz").alias("backed_up_at")))


def insert_absent(target: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """J4 ``INSERT .. ON CONFLICT (key) DO NOTHING``: existing rows win.

    Duplicates inside ``new`` keep the smallest row, chosen by a partial
    aggregate (map-side combine, so a hot key does not gather in one task).
    """
    cols = new.columns
    dedup = (new.groupBy(key).agg(F.min(F.struct(*[c for c in cols if c != key])).alias("_r"))
             .select(key, "_r.*"))
    fresh = dedup.join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*cols))


def poisoned_rows(orders: DataFrame) -> int:
    """Rows currently in the poisoned status (one aggregate; a single number reaches the driver)."""
    return orders.where(F.col("status") == POISON_STATUS).count()


def poison_with_backup(orders: DataFrame, backup: DataFrame | None = None, n: int = VICTIMS,
                       anchor: str = ANCHOR, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Back the victims up (J3 + J4) and then inject the fault.

    ``strict`` enforces the injection's pre- and postcondition: no poisoned
    rows before, exactly ``n`` after (it runs two counting jobs).
    """
    if strict and poisoned_rows(orders):
        raise RuntimeError("orders already hold poisoned rows; restore before injecting again")
    victims = choose_victims(orders, n)
    new_backup = backup_rows(orders, victims, anchor)
    backup = new_backup if backup is None else insert_absent(backup, new_backup)
    poisoned = inject_fault(orders, victims, anchor)
    if strict and poisoned_rows(poisoned) != n:
        raise RuntimeError(f"injection did not produce exactly {n} poisoned rows")
    return poisoned, backup


def batch_predicate(batch_id: str = RECONCILE_BATCH) -> F.Column:
    """The malformed batch: status PENDING_RECONCILE and reconcile_batch = id."""
    return (F.col("status") == POISON_STATUS) & \
        (json_text("payload", "$.reconcile_batch") == F.lit(batch_id))


def remediate(orders: DataFrame, backup: DataFrame, batch_id: str | None = RECONCILE_BATCH) -> DataFrame:
    """Restore status, payload, created_at from the backup.

    With ``batch_id`` only rows of that batch change (J1); ``None`` undoes all
    backed-up rows (J2). Rows without a backup stay as they are. The join size
    is left to AQE, which broadcasts the backup only when its runtime size is
    under the broadcast threshold.
    """
    b = backup.select("id", F.col("status").alias("b_status"), F.col("payload").alias("b_payload"),
                      F.col("created_at").alias("b_created_at"))
    take = F.col("b_status").isNotNull()
    if batch_id is not None:
        take = take & batch_predicate(batch_id)
    return (orders.join(b, "id", "left")
            .select("id", "customer_id", "sku", "qty", "amount_cents",
                    F.when(take, F.col("b_status")).otherwise(F.col("status")).alias("status"),
                    F.when(take, F.col("b_created_at")).otherwise(F.col("created_at")).alias("created_at"),
                    F.when(take, F.col("b_payload")).otherwise(F.col("payload")).alias("payload")))


def backup_coverage(orders: DataFrame, backup: DataFrame, batch_id: str = RECONCILE_BATCH) -> DataFrame:
    """Bad rows of the batch, how many have a backup, and whether all do."""
    bad = orders.where(batch_predicate(batch_id)).select("id")
    joined = bad.join(backup.select("id", F.lit(True).alias("has_backup")), "id", "left")
    return (joined.agg(F.count(F.lit(1)).alias("bad_rows"),
                       F.count_if(F.col("has_backup")).alias("with_backup"))
            .withColumn("fully_covered", F.col("bad_rows") == F.col("with_backup")))


def repair_report(orders: DataFrame, backup: DataFrame, batch_id: str = RECONCILE_BATCH) -> DataFrame:
    """D3: repair, then count what is left in the poisoned status (must be 0)."""
    fixed = remediate(orders, backup, batch_id)
    return fixed.agg(F.count_if(F.col("status") == POISON_STATUS).alias("remaining"),
                     F.count(F.lit(1)).alias("rows")) \
        .withColumn("ok", F.col("remaining") == 0)


def multiset_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows missing from ``actual`` and extra in it, as multisets.

    The counts of ``expected.exceptAll(actual)`` and ``actual.exceptAll(expected)``
    in one pass: rows are tagged +1 (actual) and -1 (expected), and one grouping
    by every column nets the tags; a negative net is missing, a positive one
    extra. Each input is computed once, and copies of one row are combined
    map-side however many there are.
    """
    cols = expected.columns
    tagged = actual.select(*cols, F.lit(1).alias("_d")).unionByName(
        expected.select(*cols, F.lit(-1).alias("_d")))
    net = tagged.groupBy(*cols).agg(F.sum("_d").alias("_d"))
    zero = F.lit(0).cast("long")
    return (net.agg(F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), zero).alias("missing"),
                    F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), zero).alias("extra"))
            .withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0)))


def write_snapshot(tables: dict[str, DataFrame], snapshot_dir: str) -> dict[str, str]:
    """Replace the snapshot of each table (one Parquet folder per table)."""
    paths = {}
    for name, df in tables.items():
        path = f"{snapshot_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths


def restore(spark: SparkSession, snapshot_dir: str, names=("customers", "orders", "payments"),
            target_dir: str | None = None) -> dict[str, DataFrame]:
    """Read the snapshot (fail when missing) and optionally write a new
    version; the new version's ``poison_backup`` is empty (the next run starts clean)."""
    from shopguard.sources.tables import POISON_BACKUP

    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(snapshot_dir)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    missing = [n for n in names if not fs.exists(jvm_path.suffix(f"/{n}"))]
    if missing:
        raise FileNotFoundError(f"snapshot {snapshot_dir} lacks {', '.join(missing)}")
    out = {n: spark.read.parquet(f"{snapshot_dir}/{n}") for n in names}
    out["poison_backup"] = spark.createDataFrame([], POISON_BACKUP)
    if target_dir:
        for n, df in out.items():
            df.write.mode("overwrite").parquet(f"{target_dir}/{n}")
        out = {n: spark.read.parquet(f"{target_dir}/{n}") for n in out}
    return out


def restore_summary(customers: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """A4: four scalar counts in one row (three one-row aggregates combined)."""
    c = customers.agg(F.count(F.lit(1)).alias("customers"))
    o = orders.agg(F.count(F.lit(1)).alias("orders"),
                   F.count_if(F.col("status") == POISON_STATUS).alias("poisoned_rows_remaining"))
    p = payments.agg(F.count(F.lit(1)).alias("payments"))
    return one_row(c, o, p).select("customers", "orders", "payments", "poisoned_rows_remaining")


def retention(df: DataFrame, ts_col: str, anchor: str, days: int) -> DataFrame:
    """Keep rows newer than ``anchor - days``."""
    cutoff = F.lit(anchor).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return df.where(F.col(ts_col) >= cutoff)


def _cutoff(anchor: str, days: int) -> F.Column:
    return F.lit(anchor).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))


def retained(df: DataFrame, ts_col: str, anchor: str, days: dict[str, int]) -> DataFrame:
    """The rows each prefix keeps, in one pass: a row once per prefix whose rule keeps it."""
    rules = F.array(*[F.struct(F.lit(p).alias("prefix"), _cutoff(anchor, d).alias("cutoff")) for p, d in days.items()])
    kept = F.filter(rules, lambda r: F.col(ts_col) >= r["cutoff"])
    return df.withColumn("prefix", F.explode(F.transform(kept, lambda r: r["prefix"])))


def retention_report(df: DataFrame, ts_col: str, anchor: str, days: dict[str, int]) -> DataFrame:
    """Rows kept and dropped per prefix, from one aggregate."""
    counts = df.agg(*[x for p, d in days.items() for x in (
        F.count_if(F.col(ts_col) >= _cutoff(anchor, d)).alias(f"{p}_kept"),
        F.count_if(F.col(ts_col) < _cutoff(anchor, d)).alias(f"{p}_dropped"))])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("prefix"), F.lit(d).alias("days"), F.col(f"{p}_kept").alias("kept"),
                 F.col(f"{p}_dropped").alias("dropped")) for p, d in days.items()])))
