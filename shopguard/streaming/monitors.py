"""Structured Streaming forms of the continuous checks.

Each monitor is a function from a streaming DataFrame to a streaming
DataFrame, built from the same column expressions as its batch form, so on a
finished input it yields the batch result (for windowed aggregates: the
windows the watermark has closed). Event time is cast from TIMESTAMP_NTZ to
TIMESTAMP because watermarks require it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

import shopguard
from shopguard.operators import metrics as mt
from shopguard.operators import policy as pol
from shopguard.operators.payload import classify_payload
from shopguard.session import scratch_path
from shopguard.sources.tables import DRIVER_SCHEMAS, table_path

# The keyed-state functions below run in Python workers. Their code (and the
# package code they reach) travels with the task, so a worker needs no
# installed copy of the package; a cluster may ship it with --py-files instead.
cloudpickle.register_pickle_by_value(shopguard)

# Fixed value: the default watermark (the alert query's 600 s look-back).
WATERMARK = "10 minutes"
# Evaluations without data that one output frame holds at most.
GAP_ROWS = 10_000


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Stream Parquet files, at most ``max_files`` of them per micro-batch. A single file is addressed through a one-file glob,
    since the file source needs a folder or a pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        head, tail = os.path.split(path)
        path = f"{head}/[{tail[0]}]{tail[1:]}"
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_stream(spark, table_path(sf_dir, name), DRIVER_SCHEMAS[name])


def with_event_time(df: DataFrame, col: str = "ts", delay: str = WATERMARK, name: str = "event_time") -> DataFrame:
    return df.withColumn(name, F.col(col).cast("timestamp")).withWatermark(name, delay)


def _window_start(w: str = "w") -> F.Column:
    return F.col(f"{w}.start").cast("timestamp_ntz")


def live_request_counters(log: DataFrame, bucket: str = "15 seconds", delay: str = WATERMARK) -> DataFrame:
    """Per instance, tumbling windows of the scrape interval (append mode)."""
    cls = mt.status_class(F.col("status_code"))
    return (with_event_time(log, delay=delay)
            .groupBy(F.window("event_time", bucket).alias("w"), "instance")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(cls == "2xx").alias("ok_2xx"),
                 F.count_if(cls == "4xx").alias("client_4xx"), F.count_if(cls == "5xx").alias("server_5xx"))
            .select(_window_start().alias("bucket_start"), "instance", "total", "ok_2xx", "client_4xx",
                    "server_5xx"))


def live_error_rate(log: DataFrame, window: str = "2 minutes", slide: str = "60 seconds",
                    window_s: int = mt.RATE_WINDOW_S, delay: str = WATERMARK) -> DataFrame:
    """R2 (from requests): 5xx per second over a sliding window, all instances."""
    return (with_event_time(log, delay=delay)
            .groupBy(F.window("event_time", window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 500).alias("errors"))
            .select(_window_start().alias("window_start"), "requests", "errors",
                    (F.col("errors") / window_s).alias("rate")))


_DELTA_SCHEMA = T.StructType([T.StructField("metric", T.StringType()), T.StructField("instance", T.StringType()),
                              T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType()),
                              T.StructField("delta", T.DoubleType())])
# The last sample given out, and the samples (times in microseconds, values) the watermark has not passed.
_DELTA_STATE = T.StructType([T.StructField("prev_ts", T.LongType()), T.StructField("prev_value", T.DoubleType()),
                             T.StructField("times", T.ArrayType(T.LongType())),
                             T.StructField("values", T.ArrayType(T.DoubleType()))])


def _delta_machine(idle_s: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev_ts, prev_v, times, values = state.get if state.exists else (None, None, [], [])
        parts = [pd.DataFrame({"t": list(times), "v": list(values)}, dtype="float64").astype({"t": "int64"})]
        if not state.hasTimedOut:
            parts += [pd.DataFrame({"t": b["ts"].astype("datetime64[us]").astype("int64"), "v": b["value"]}) for b in batches]
        held = pd.concat(parts, ignore_index=True).sort_values("t", kind="stable", ignore_index=True)
        mark = state.getCurrentWatermarkMs() * 1000
        due = held["t"] <= mark
        ready = held[due]
        before = ready["v"].shift(1)
        if len(ready) and prev_v is not None:
            before.iloc[0] = prev_v
        delta = (ready["v"] - before).where(ready["v"] >= before, ready["v"]).where(before.notna())
        if len(ready):
            prev_ts, prev_v = int(ready["t"].iloc[-1]), float(ready["v"].iloc[-1])
        held = held[~due]
        if state.hasTimedOut and not len(held) and not len(ready):
            state.remove()              # idle: the next sample of the series starts afresh
        else:
            state.update((prev_ts, prev_v, held["t"].tolist(), held["v"].tolist()))
            nxt = int(held["t"].iloc[0]) // 1000 if len(held) else prev_ts // 1000 + idle_s * 1000
            state.setTimeoutTimestamp(max(nxt, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"metric": key[0], "instance": key[1], "ts": pd.to_datetime(ready["t"], unit="us"),
                            "value": ready["v"].astype("float64"), "delta": delta.astype("float64")})

    return run


def counter_deltas(samples: DataFrame, delay: str = WATERMARK, idle_s: int = 86400) -> DataFrame:
    """R2 (from counter samples): reset-adjusted increases per series, keeping
    the previous sample in keyed state (``lag`` does not exist on streams).

    Samples wait until the watermark passes them and are then taken in time
    order, whatever order they came in. One that comes behind the watermark is
    left out by Spark and counted (``numRowsDroppedByWatermark`` of the query's
    progress). Equal samples each count, as in the batch form. A series without samples for ``idle_s`` is forgotten.
    """
    return with_event_time(samples.select("metric", "instance", "ts", "value"), delay=delay) \
        .groupBy("metric", "instance") \
        .applyInPandasWithState(_delta_machine(idle_s), _DELTA_SCHEMA, _DELTA_STATE, "append",
                                GroupStateTimeout.EventTimeTimeout)


_ALERT_SCHEMA = T.StructType([T.StructField("rule", T.StringType()), T.StructField("eval_ts", T.TimestampNTZType()),
                              T.StructField("value", T.DoubleType()), T.StructField("breach", T.BooleanType()),
                              T.StructField("state", T.StringType())])
# Last evaluation given out and start of its run of breaches (microseconds), and the evaluations the
# watermark has not passed.
_ALERT_STATE = T.StructType([T.StructField("last_eval", T.LongType()), T.StructField("breach_start", T.LongType()),
                             T.StructField("times", T.ArrayType(T.LongType())),
                             T.StructField("values", T.ArrayType(T.DoubleType()))])


def _with_gaps(last: int | None, times: np.ndarray, values: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The evaluations in frames of at most GAP_ROWS, with those without data that lie between them (values NaN)."""
    before = np.concatenate([times[:1] if last is None else [last], times[:-1]])
    missing = np.maximum((times - before + step // 2) // step - 1, 0)
    ends = np.cumsum(missing + 1)
    for i in range(0, int(ends[-1]) if len(ends) else 0, GAP_ROWS):
        row = np.arange(i, min(i + GAP_ROWS, int(ends[-1])))
        k = np.searchsorted(ends, row, side="right")
        nth = row - (ends[k] - missing[k] - 1)
        real = nth == missing[k]
        yield np.where(real, times[k], before[k] + (nth + 1) * step), np.where(real, values[k], np.nan)


def _alert_machine(above: float, for_s: int, interval_s: int):
    step = interval_s * 1_000_000

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, start, times, values = state.get if state.exists else (None, None, [], [])
        parts = [pd.DataFrame({"t": list(times), "v": list(values)}, dtype="float64").astype({"t": "int64"})]
        if not state.hasTimedOut:
            parts += [pd.DataFrame({"t": b["eval_ts"].astype("datetime64[us]").astype("int64"),
                                    "v": b["value"].astype("float64")}) for b in batches]
        held = pd.concat(parts, ignore_index=True).sort_values("t", kind="stable", ignore_index=True)
        mark = state.getCurrentWatermarkMs() * 1000
        due = held["t"] <= mark
        ready, held = held[due], held[~due]
        frames = [(ready["t"].to_numpy(), ready["v"].to_numpy())]
        newest = int(ready["t"].iloc[-1]) if len(ready) else last
        if newest is not None:
            # Evaluations without data that whatever comes behind the watermark leaves missing.
            n = max(0, (mark - newest + step // 2) // step - 1)
            frames.append((newest + step * np.arange(n, n + 1 if n else 0), np.full(1 if n else 0, np.nan)))
        for frame in frames:
            for t, v in _with_gaps(last, *frame, step):
                breach = v > above
                calm = np.maximum.accumulate(np.where(breach, -1, np.arange(len(t))))
                began = np.where(calm >= 0, t[np.minimum(calm + 1, len(t) - 1)], t[0] if start is None else start)
                names = np.where(t // 1_000_000 - began // 1_000_000 >= for_s, "firing", "pending")
                last, start = int(t[-1]), int(began[-1]) if breach[-1] else None
                yield pd.DataFrame({"rule": key[0], "eval_ts": pd.to_datetime(t, unit="us"), "value": v, "breach": breach,
                                    "state": np.where(breach, names, "inactive")})
        state.update((last, start, held["t"].tolist(), held["v"].tolist()))
        nxt = [int(x) for x in held["t"].iloc[:1]] + ([] if last is None else [last + step + step // 2])
        state.setTimeoutTimestamp(max(min(nxt) // 1000, state.getCurrentWatermarkMs()) + 1)

    return run


def alert_state_stream(values: DataFrame, above: float = mt.THRESHOLD, for_s: int = mt.FOR_S,
                       interval_s: int = mt.EVAL_INTERVAL_S, delay: str = WATERMARK) -> DataFrame:
    """The alert state machine as keyed state per rule.

    Evaluations wait in state until the watermark passes them and are then taken
    in time order, so the rows are those of the batch form up to the
    watermark, however the input is cut into micro-batches. An event-time
    timeout gives out the evaluations without data of a silent rule.
    """
    v = with_event_time(values, col="eval_ts", delay=delay).select("rule", "eval_ts", "value", "event_time")
    return v.groupBy("rule").applyInPandasWithState(
        _alert_machine(above, for_s, interval_s), _ALERT_SCHEMA, _ALERT_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def malformed_monitor(orders: DataFrame) -> DataFrame:
    """Order changes that fail the payload contract (stateless, T1 reused)."""
    return classify_payload(orders).where(F.col("error_type").isNotNull()) \
        .select("id", "status", "error_type", "error_key", "created_at")


def quarantine_sink(base: str, every: str = "1 minute"):
    """One ``foreachBatch`` function that feeds two tables under ``base`` from one pass over the batch: the
    malformed orders (``quarantine``) and, per minute, how many orders came and how many failed (``counts``).

    Both are written under the batch's id, so a batch that is replayed replaces
    its own rows; ``quarantine_tables`` adds the batches' counts up.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        checked = f"{base}/checked/epoch={epoch}"
        classify_payload(batch).select("id", "status", "error_type", "error_key", "created_at") \
            .write.mode("overwrite").parquet(checked)
        rows = batch.sparkSession.read.parquet(checked)
        rows.where(F.col("error_type").isNotNull()).write.mode("overwrite").parquet(f"{base}/quarantine/epoch={epoch}")
        (rows.groupBy(F.window("created_at", every)["start"].alias("minute"))
         .agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("error_type").isNotNull()).alias("malformed"))
         .write.mode("overwrite").parquet(f"{base}/counts/epoch={epoch}"))

    return sink


def quarantine_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The two tables a ``quarantine_sink`` wrote: ``(quarantine, counts per minute)``."""
    bad = spark.read.schema("id long, status string, error_type string, error_key string, created_at timestamp_ntz, epoch long") \
        .parquet(f"{base}/quarantine")
    counts = spark.read.schema("minute timestamp_ntz, orders long, malformed long, epoch long").parquet(f"{base}/counts")
    return bad, counts.groupBy("minute").agg(F.sum("orders").alias("orders"), F.sum("malformed").alias("malformed"))


def run_quarantine(orders: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Run the two sinks over everything available."""
    (orders.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
     .foreachBatch(quarantine_sink(base)).start().awaitTermination())
    return quarantine_tables(orders.sparkSession, base)


def malformed_per_minute(orders: DataFrame, every: str = "1 minute", delay: str = WATERMARK) -> DataFrame:
    """Per minute, how many order changes came and how many fail the contract."""
    checked = classify_payload(with_event_time(orders, col="created_at", delay=delay))
    return (checked.groupBy(F.window("event_time", every).alias("w"))
            .agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("error_type").isNotNull()).alias("malformed"))
            .select(_window_start().alias("minute"), "orders", "malformed"))


def heartbeat_stream(orders: DataFrame, every: str = "5 minutes", delay: str = WATERMARK) -> DataFrame:
    """PENDING_RECONCILE count and OK flag per heartbeat window."""
    return (with_event_time(orders, col="created_at", delay=delay)
            .groupBy(F.window("event_time", every).alias("w"))
            .agg(F.count_if(F.col("status") == "PENDING_RECONCILE").alias("pending_reconcile"))
            .select(_window_start().alias("window_start"), "pending_reconcile",
                    (F.col("pending_reconcile") == 0).alias("ok")))


def _watch_schema(probes: list[str]) -> T.StructType:
    times = [T.StructField(f"{p}_at", T.TimestampNTZType()) for p in probes]
    return T.StructType([T.StructField("account", T.StringType()), T.StructField("incident", T.StringType()),
                         T.StructField("opened_at", T.TimestampNTZType()), *times,
                         T.StructField("closed_at", T.TimestampNTZType()), T.StructField("complete", T.BooleanType())])


# Opening time, first time of each piece of evidence, last record (microseconds), and whether the run was reported.
_WATCH_STATE = T.StructType([T.StructField("opened", T.LongType()), T.StructField("firsts", T.ArrayType(T.LongType())),
                             T.StructField("newest", T.LongType()), T.StructField("told", T.BooleanType())])


def _watch_machine(probes: list[str], timeout_s: int, keep_s: int):
    wait, keep = timeout_s * 1_000_000, keep_s * 1_000_000
    names = [f.name for f in _watch_schema(probes).fields]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, firsts, newest, told = state.get if state.exists else (None, [None] * len(probes), 0, False)
        firsts = list(firsts)
        for b in [] if state.hasTimedOut else batches:
            t = b["ts"].astype("datetime64[us]").astype("int64")
            opened = int(t.min()) if opened is None else min(opened, int(t.min()))
            newest = max(newest, int(t.max()))
            for i, p in enumerate(probes):
                hits = t[b[p].astype(bool)]
                if len(hits):
                    firsts[i] = int(hits.min()) if firsts[i] is None else min(firsts[i], int(hits.min()))
        mark = state.getCurrentWatermarkMs() * 1000
        seen = [f if f is not None and f <= opened + wait else None for f in firsts]
        complete = None not in seen
        closes = max(seen) if complete else opened + wait
        if not told and closes <= mark:              # nothing still to come can change the row
            told = True
            yield pd.DataFrame([[*key, *(pd.NaT if x is None else pd.Timestamp(x, unit="us")
                                         for x in (opened, *seen, closes)), complete]], columns=names)
        if told and newest + keep <= mark:
            state.remove()
            return
        state.update((opened, firsts, newest, told))
        state.setTimeoutTimestamp(max((newest + keep if told else closes) // 1000, state.getCurrentWatermarkMs()) + 1)

    return run


def incident_watch(records: DataFrame, probes: list[str], timeout_s: int = 12 * 3600, keep_s: int = 86400,
                   delay: str = WATERMARK) -> DataFrame:
    """One row per incident run (``account, incident``) when it closes.

    ``records`` has ``account, incident, ts`` and a boolean column per probe. A
    run opens with its first record. It closes complete at the time its last
    missing piece of evidence first occurs, or incomplete ``timeout_s``
    after it opened; evidence after that doesn't count. The row is given out
    once, when the watermark has passed that time; a reported run is forgotten ``keep_s`` after its last record.
    """
    r = with_event_time(records, delay=delay).select("account", "incident", "ts", *probes, "event_time")
    return r.groupBy("account", "incident").applyInPandasWithState(
        _watch_machine(probes, timeout_s, keep_s), _watch_schema(probes), _WATCH_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def live_decisions(requests: DataFrame, policies=pol.POLICIES) -> DataFrame:
    """The fused policy decision on a request stream (stateless)."""
    return pol.decide(requests, policies)


def run_available_now(df: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> str:
    """Run a streaming query over everything available and return its output
    folder (Parquet). Append mode uses the file sink. Update mode writes each
    micro-batch's rows to a folder of its own (a retried batch replaces its own)
    and in the end keeps, per ``keys``, the row of the latest batch.
    Checkpoints live in the shared checkpoint folder so a restarted query resumes."""
    spark = df.sparkSession
    base = scratch_path(spark, f"stream-{name}")
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    writer = df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return out
    if mode != "update" or not keys:
        raise ValueError("append mode, or update mode with keys")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/updates/epoch={epoch}")

    writer.foreachBatch(sink).outputMode("update").start().awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/updates")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):      # no batch ran: the input is empty
        spark.createDataFrame([], df.schema).write.parquet(out)
        return out
    updates = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])) \
        .parquet(f"{base}/updates")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("epoch")))
    updates.withColumn("_n", newest).where("_n = 1").drop("_n", "epoch").write.parquet(out)
    return out
