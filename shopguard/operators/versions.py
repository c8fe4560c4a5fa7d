"""Versions of a set of tables, switched together (D4, S9), and repairs that rewrite only the files they touch.

A dataset folder holds data files and manifests. A manifest names the files of
every table of one version; it is written aside and then renamed, and the rename
fails if another writer took that number first. A reader resolves the newest
manifest, so it sees all tables of one version or all of the version before,
never a mix, whatever an interrupted writer left behind. A manifest has a line per
data file, which is all the driver holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Dataset:
    """The versions under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # --- manifests ----------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest committed version; 0 where there is none."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``{table: {"schema", "files"}}`` of a version (the newest by default)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        where = self._path(f"{self.root}/versions/{version:012d}.json")
        if not self._fs.exists(where):
            raise FileNotFoundError(f"{self.root} has no version {version}")
        stream = self._fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, manifest: Mapping, after: int) -> int:
        """Make ``manifest`` the version that follows ``after``; raises if another writer did so first."""
        made, aside = after + 1, self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(aside, self._path(f"{self.root}/versions/{made:012d}.json"),
                           self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise RuntimeError(f"version {made} of {self.root} was committed by another writer") from e
            raise
        return made

    # --- tables -------------------------------------------------------------------------------------

    def write(self, name: str, df: DataFrame, by: Iterable[str] = ()) -> dict:
        """Write new files of a table, in no version yet; ``by`` names the columns that make folders."""
        base = f"{self.root}/data/{name}/write={uuid.uuid4().hex}"
        by = list(by)
        (df.write.partitionBy(*by) if by else df.write).parquet(base)
        files = []
        found = self._fs.listFiles(self._path(base), True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet"):
                files.append(path.toString())
        return {"schema": df.schema.json(), "files": sorted(files)}

    def read(self, name: str, version: int | None = None, files: list[str] | None = None) -> DataFrame:
        """A table of one version (or some of its files)."""
        entry = self.manifest(version)[name]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        files = entry["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.option("basePath", f"{self.root}/data/{name}").schema(schema).parquet(*files)
                .select(*[f.name for f in schema.fields]))

    def with_file(self, name: str, version: int | None = None) -> DataFrame:
        """A table with ``_file``, the name of the file each row lies in (unique in a dataset)."""
        entry = self.manifest(version)[name]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if not entry["files"]:
            return self.spark.createDataFrame([], schema).withColumn("_file", F.lit(""))
        df = self.spark.read.option("basePath", f"{self.root}/data/{name}").schema(schema).parquet(*entry["files"])
        return df.select(*[f.name for f in schema.fields], F.col("_metadata.file_name").alias("_file"))

    def replace(self, tables: Mapping[str, DataFrame], by: Mapping[str, list[str]] | None = None) -> int:
        """Replace several tables in one commit; the others stay as they are."""
        after = self.version()
        manifest = dict(self.manifest(after) if after else {})
        for name, df in tables.items():
            manifest[name] = self.write(name, df, (by or {}).get(name, ()))
        return self.commit(manifest, after)

    def rewrite(self, name: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame],
                by: Iterable[str] = ()) -> int:
        """Copy on write: rewrite the files named in ``touched`` (column ``_file``) through ``change``; all other
        files enter the new version by reference. The file names are all that comes to the driver."""
        after = self.version()
        manifest = dict(self.manifest(after))
        names = {r["_file"] for r in touched.select("_file").distinct().collect()}
        files = manifest[name]["files"]
        hit = [f for f in files if f.rsplit("/", 1)[1] in names]
        if not hit:
            return after
        new = self.write(name, change(self.read(name, after, hit)), by)
        manifest[name] = {"schema": manifest[name]["schema"], "files": [f for f in files if f not in set(hit)] + new["files"]}
        return self.commit(manifest, after)


# --- the shop's uses ------------------------------------------------------------------------------------


def restore_version(data: Dataset, version: int, names=("customers", "orders", "payments")) -> int:
    """Make the tables of an earlier version current again, in one commit and without copying a file; the
    ``poison_backup`` of the new version is empty (the next run starts clean)."""
    from shopguard.sources.tables import POISON_BACKUP

    old, after = data.manifest(version), data.version()
    missing = [n for n in names if n not in old]
    if missing:
        raise FileNotFoundError(f"version {version} lacks {', '.join(missing)}")
    manifest = dict(data.manifest(after))
    manifest.update({n: old[n] for n in names})
    manifest["poison_backup"] = {"schema": data.spark.createDataFrame([], POISON_BACKUP).schema.json(), "files": []}
    return data.commit(manifest, after)


def repair_version(data: Dataset, batch_id: str | None = None, orders: str = "orders", backup: str = "poison_backup") -> int:
    """J1 (with ``batch_id``) or J2: repair orders from their backup, rewriting only the files that hold rows to repair."""
    from shopguard.operators import lifecycle as lc

    saved = data.read(backup)
    rows = data.with_file(orders)
    if batch_id is not None:
        rows = rows.where(lc.batch_predicate(batch_id))
    touched = rows.select("id", "_file").join(saved.select("id"), "id", "left_semi")
    return data.rewrite(orders, touched, lambda df: lc.remediate(df, saved, batch_id))


def expire(data: Dataset, name: str, cutoffs: Mapping[str, Column], ts_col: str = "ts", prefix_col: str = "prefix",
           day_col: str = "day") -> int:
    """Drop what is older than each prefix's cut-off from a table whose folders are prefix and day.

    Folders of earlier days leave the version as they are; only the day of the
    cut-off is rewritten, and later days enter the new version by reference.
    """
    after = data.version()
    manifest = dict(data.manifest(after))
    spark = data.spark
    days = spark.range(1).select(*[c.cast("date").alias(p) for p, c in cutoffs.items()]).first().asDict()
    keep, edge = [], []
    for f in manifest[name]["files"]:
        folders = dict(x.split("=", 1) for x in f.split("/") if "=" in x)
        day, cut = folders[day_col], days.get(folders[prefix_col])
        if cut is None or day > cut.isoformat():
            keep.append(f)
        elif day == cut.isoformat():
            edge.append(f)
    new = []
    if edge:
        cut_at = F.coalesce(*[F.when(F.col(prefix_col) == p, c) for p, c in cutoffs.items()])
        new = data.write(name, data.read(name, after, edge).where(F.col(ts_col) >= cut_at), [prefix_col, day_col])["files"]
    manifest[name] = {"schema": manifest[name]["schema"], "files": keep + new}
    return data.commit(manifest, after)
