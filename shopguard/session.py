"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python call sites in error messages cost several JVM round trips per
    # DataFrame call while a query is built; the policy and payload columns
    # make thousands of such calls.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The JVM never compiles a method of more than 8,000 bytes of bytecode. A stage
    # whose generated code is longer would run interpreted; it runs as separate operators instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Queries that read a derived table more than once checkpoint it; remove
    # those files once the checkpointed DataFrame is gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "shopguard", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE on and the UI off.

    On a cluster leave ``master`` unset so spark-submit decides; tests pass
    ``local[N]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder. Where it is unset, a session with a
    ``local`` master (tests) gets a scratch folder; any other master raises,
    since executors on other machines would not see the driver's folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="shopguard-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_scratch_roots: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the shared checkpoint folder for written tables.

    All of an application's tables lie in one folder, which is removed when the
    driver's Python process ends.
    """
    root = f"{checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if root not in _scratch_roots:
        _scratch_roots.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, root: str) -> None:
    # A session that was stopped before has no gateway left; its folder then stays.
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage; later reads prune columns and the files live as long as the folder (``spark.checkpoint.dir`` is scratch space).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
