"""Request counters, counter rates, reduce/threshold and the alert state machine.

Rates follow the counter-reset rule of the order service's counters: a drop
means the process restarted, so the new value is the increase. Evaluation
grids are built by expanding each sample to the (bounded) set of evaluation
times whose window contains it, then grouping by (series, eval time): no range
join and no window over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopguard.operators.common import join_null_safe
from shopguard.session import written_table

# The alert rule defaults and the metric keep-list.
RATE_WINDOW_S = 120
EVAL_INTERVAL_S = 60
FOR_S = 60
THRESHOLD = 0.05
KEEP_METRICS = r"^(?:http_requests_.*|http_5xx_ratio|orders_.*|orders_api_.*|up|scrape_samples_scraped)$"


def fixed_text(x: Column, places: int) -> Column:
    """Python's ``f"{x:.{places}f}"``: ``x`` rounded half-to-even on its exact
    binary value, as the order service prints its 5xx ratio. (``round``
    differs at decimal ties: it rounds the shortest decimal form half up, so
    139/800, stored just below 0.17375, gives 0.1738 where Python prints 0.1737.)"""
    return F.regexp_replace(F.format_number(x, places), ",", "")


def fixed(x: Column, places: int) -> Column:
    """``fixed_text`` read back as a double."""
    return fixed_text(x, places).cast("double")


def status_class(code: Column) -> Column:
    """5xx, 4xx, else 2xx (3xx counts as 2xx)."""
    return F.when(code >= 500, "5xx").when(code >= 400, "4xx").otherwise("2xx")


def request_counters(log: DataFrame, bucket: str = "15 seconds", by: Sequence[str] = ("instance",)) -> DataFrame:
    """A5: total, 2xx, 4xx, 5xx, unhandled exceptions and the 5xx ratio (0 when
    no requests), per bucket. ``unhandled`` marks requests that ended in an
    unhandled exception (the service's "malformed payload" counter); without
    that column every 500 counts as one."""
    cls = status_class(F.col("status_code"))
    unhandled = F.col("unhandled") if "unhandled" in log.columns else F.col("status_code") == 500
    return (log.groupBy(F.window("ts", bucket).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(cls == "2xx").alias("ok_2xx"),
                 F.count_if(cls == "4xx").alias("client_4xx"),
                 F.count_if(cls == "5xx").alias("server_5xx"),
                 F.count_if(unhandled).alias("unhandled_total"))
            .select(F.col("w.start").alias("bucket_start"), *by, "total", "ok_2xx", "client_4xx",
                    "server_5xx", "unhandled_total",
                    F.when(F.col("total") > 0, fixed(F.col("server_5xx") / F.col("total"), 4))
                    .otherwise(F.lit(0.0)).alias("ratio")))


def keep_series(samples: DataFrame, pattern: str = KEEP_METRICS) -> DataFrame:
    """Keep series whose *whole* name matches (the pattern is anchored)."""
    return samples.where(F.col("metric").rlike(pattern))


def _epoch(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def with_previous(samples: DataFrame, series: Sequence[str], block_s: int = 6 * 3600) -> DataFrame:
    """Add ``prev_v``/``prev_s``: the series' previous sample, without one window
    over a whole series (a hot series would sort in one task).

    Samples are cut into time blocks per series; ``lag`` runs inside a block,
    and the first sample of a block takes the last sample of the nearest
    earlier block from a small per-block table (one row per series and block).
    """
    series = list(series)
    s = samples.withColumn("_blk", F.floor(F.col("ts_s") / block_s))
    w = Window.partitionBy(*series, "_blk").orderBy("ts_s")
    s = s.withColumn("prev_v", F.lag("value").over(w)).withColumn("prev_s", F.lag("ts_s").over(w))
    last = s.groupBy(*series, "_blk").agg(F.max_by(F.struct("ts_s", "value"), "ts_s").alias("_last"))
    wb = Window.partitionBy(*series).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(wb)).drop("_last")
    return (join_null_safe(s, carry, [*series, "_blk"])
            .withColumn("prev_v", F.coalesce("prev_v", F.col("_carry.value")))
            .withColumn("prev_s", F.coalesce("prev_s", F.col("_carry.ts_s")))
            .drop("_blk", "_carry"))


def counter_windows(samples: DataFrame, window_s: int = RATE_WINDOW_S, step_s: int = EVAL_INTERVAL_S,
                    series: Sequence[str] = ("metric", "instance")) -> DataFrame:
    """W2 core: per series and evaluation time t (multiples of ``step_s``), the
    samples in ``(t - window, t]``: count, first/last time and value, and the
    reset-adjusted increase between consecutive samples inside the window."""
    series = list(series)
    s = with_previous(samples.select(*series, "ts", "value").withColumn("ts_s", _epoch("ts")), series)
    s = s.withColumn("delta", F.when(F.col("prev_v").isNull(), F.lit(None).cast("double"))
                     .when(F.col("value") >= F.col("prev_v"), F.col("value") - F.col("prev_v"))
                     .otherwise(F.col("value")))
    first_t = F.ceil(F.col("ts_s") / step_s) * step_s
    last_t = F.floor((F.col("ts_s") + window_s - 1) / step_s) * step_s
    grid = s.where(first_t <= last_t).withColumn(
        "t", F.explode(F.sequence(first_t.cast("long"), last_t.cast("long"), F.lit(step_s).cast("long"))))
    inside = F.col("prev_s") > F.col("t") - window_s
    return (grid.groupBy(*series, "t")
            .agg(F.count(F.lit(1)).alias("samples"),
                 F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"),
                 F.min_by("value", "ts_s").alias("first_v"),
                 F.sum(F.when(inside, F.col("delta"))).alias("increase"))
            .withColumn("eval_ts", _at(F.col("t"))))


def counter_rate(samples: DataFrame, window_s: int = RATE_WINDOW_S, step_s: int = EVAL_INTERVAL_S,
                 extrapolate: bool = False, series: Sequence[str] = ("metric", "instance")) -> DataFrame:
    """Per-series rate at each evaluation time; NULL with fewer than two samples.

    ``extrapolate=False``: increase / window. ``extrapolate=True``: the public
    PromQL rule that extends the sampled interval towards the window edges
    (by at most half an average sample gap unless closer than 1.1 gaps, and
    never before the counter's zero point).
    """
    cw = counter_windows(samples, window_s, step_s, series)
    enough = F.col("samples") >= 2
    if not extrapolate:
        rate = F.when(enough, F.col("increase") / window_s)
    else:
        sampled = (F.col("last_s") - F.col("first_s")).cast("double")
        avg_gap = sampled / (F.col("samples") - 1)
        to_start = (F.col("first_s") - (F.col("t") - window_s)).cast("double")
        to_end = (F.col("t") - F.col("last_s")).cast("double")
        to_zero = F.when((F.col("increase") > 0) & (F.col("first_v") >= 0),
                         sampled * (F.col("first_v") / F.col("increase")))
        to_start = F.when(to_zero.isNotNull() & (to_zero < to_start), to_zero).otherwise(to_start)
        thr = avg_gap * 1.1
        ext = sampled + F.when(to_start < thr, to_start).otherwise(avg_gap / 2) \
            + F.when(to_end < thr, to_end).otherwise(avg_gap / 2)
        rate = F.when(enough & (sampled > 0), F.col("increase") * (ext / sampled) / window_s)
    return cw.select(*series, "eval_ts", "samples", "increase", rate.alias("rate"))


def sum_rate(rates: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """``sum(rate(...))`` over instances, per evaluation time."""
    return rates.where(F.col("rate").isNotNull()).groupBy(*by, "eval_ts").agg(F.sum("rate").alias("value"))


def reduce_last(points: DataFrame, lookback_s: int, step_s: int,
                key: Sequence[str] = ("metric",)) -> DataFrame:
    """At each evaluation time, the newest numeric point of the look-back
    window; NULL and NaN points are dropped first."""
    key = list(key)
    ok = points.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("p_s", _epoch("eval_ts"))
    first_t = F.ceil(F.col("p_s") / step_s) * step_s
    last_t = F.floor((F.col("p_s") + lookback_s - 1) / step_s) * step_s
    grid = ok.withColumn("t", F.explode(F.sequence(first_t.cast("long"), last_t.cast("long"),
                                                   F.lit(step_s).cast("long"))))
    return (grid.groupBy(*key, "t").agg(F.max_by("value", "p_s").alias("value"))
            .select(*key, _at(F.col("t")).alias("eval_ts"), "value"))


def threshold(values: DataFrame, above: float = THRESHOLD) -> DataFrame:
    """Strict greater-than breach flag."""
    return values.withColumn("breach", F.coalesce(F.col("value") > F.lit(above), F.lit(False)))


# Evaluations of a gap that one row expands to at a time.
GAP_PART = 1024


def alert_states(values: DataFrame, above: float = THRESHOLD, for_s: int = FOR_S,
                 interval_s: int = EVAL_INTERVAL_S, rule: str = "rule", block: int = 4096) -> DataFrame:
    """Inactive -> pending on the first breach -> firing once the breach has
    held for ``for_s``; any non-breach resets; no data counts as OK; a row with
    ``error`` set is state error.

    ``values`` has ``rule, eval_ts, value`` (optionally ``error``), one row per
    rule and time (further ones of a time are evaluations of their own). Evaluations need not lie on a fixed grid: between two that
    are n intervals apart (rounded) n - 1 evaluations without data are added.
    Islands: the running count of non-breaching evaluations names each run of
    breaches, and its first time starts the ``for`` clock. Windows run inside
    blocks of evaluations per rule; what crosses a block comes from a table
    with one row per block, so a long history spreads over tasks.
    """
    if interval_s < 10:
        raise ValueError("evaluation interval must be at least 10 s")
    has_err = "error" in values.columns
    width = interval_s * block
    v = (values.select(rule, "eval_ts", "value", *(["error"] if has_err else []))
         .withColumn("_t", _epoch("eval_ts")).withColumn("_blk", F.floor(F.col("_t") / width)))
    # The evaluations and their breaches are each read more than once below; written, they are computed once.
    v = written_table(v, "evaluations")
    # The next evaluation: inside the block, or the first of the rule's next block.
    inside = Window.partitionBy(rule, "_blk").orderBy("_t")
    blocks = Window.partitionBy(rule).orderBy("_blk")
    firsts = v.groupBy(rule, "_blk").agg(F.min("_t").alias("_first")) \
        .withColumn("_after", F.lead("_first").over(blocks)).drop("_first")
    v = join_null_safe(v.withColumn("_next", F.lead("_t").over(inside)), firsts, [rule, "_blk"])
    gap = F.coalesce("_next", "_after") - F.col("_t")
    missing = F.greatest(F.floor((gap + interval_s // 2) / interval_s) - 1, F.lit(0))
    err = F.col("error").isNotNull() if has_err else F.lit(False)
    breach = (~err) & F.coalesce(F.col("value") > F.lit(above), F.lit(False))
    # A gap stays one number beside the evaluation it follows; its evaluations are all calm.
    staged = written_table(
        v.select(rule, "_t", "value", *(["error"] if has_err else []), "_blk", breach.alias("breach"), err.alias("is_error"),
                 F.coalesce(missing, F.lit(0)).cast("long").alias("_gap"))
        .withColumn("_calm", F.when(F.col("breach"), 0).otherwise(1) + F.col("_gap")), "breaches")
    calm = staged.groupBy(rule, "_blk").agg(F.sum("_calm").alias("_in")) \
        .withColumn("_before", F.sum("_in").over(blocks) - F.col("_in")).drop("_in")
    running = Window.partitionBy(rule, "_blk").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    staged = join_null_safe(staged.withColumn("_own", F.sum("_calm").over(running)), calm, [rule, "_blk"]) \
        .withColumn("island", F.col("_before") + F.col("_own") - F.col("_gap")).drop("_before", "_own", "_calm")
    # The start of a run, per block it spans: one row per run and block.
    spans = staged.where("breach").groupBy(rule, "island", "_blk").agg(F.min("_t").alias("_low"))
    runs = Window.partitionBy(rule, "island").orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("_start", F.min("_low").over(runs)).drop("_low")
    full = join_null_safe(staged, spans, [rule, "island", "_blk"], "left")
    # Only here a gap becomes rows: first its parts of GAP_PART evaluations, then each part's.
    full = (full.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_gap") / GAP_PART).cast("long"))))
            .withColumn("_n", F.explode(F.sequence(F.col("_c") * GAP_PART, F.least("_gap", F.col("_c") * GAP_PART + GAP_PART - 1)))))
    real = F.col("_n") == 0
    breach = real & F.col("breach")
    held = F.col("_t") - F.col("_start")
    return full.select(
        rule, _at(F.col("_t") + F.col("_n") * interval_s).alias("eval_ts"), F.when(real, F.col("value")).alias("value"),
        *([F.when(real, F.col("error")).alias("error")] if has_err else []), breach.alias("breach"),
        (F.col("island") + F.col("_n")).alias("island"),
        F.when(real & F.col("is_error"), "error").when(~breach, "inactive").when(held >= for_s, "firing")
        .otherwise("pending").alias("state"),
        F.when(breach, _at(F.col("_start"))).alias("breach_started"))


def alert_episodes(states: DataFrame, interval_s: int = EVAL_INTERVAL_S, rule: str = "rule") -> DataFrame:
    """One row per run of breaches: start, firing time, end, duration, peak."""
    runs = states.where(F.col("breach"))
    return (runs.groupBy(rule, "island")
            .agg(F.min("eval_ts").alias("started_at"),
                 F.min(F.when(F.col("state") == "firing", F.col("eval_ts"))).alias("firing_at"),
                 F.max("eval_ts").alias("last_breach_at"),
                 F.count(F.lit(1)).alias("evaluations"),
                 F.max("value").alias("peak"))
            .withColumn("resolved_at", F.col("last_breach_at") + F.make_dt_interval(secs=F.lit(interval_s)))
            .withColumn("duration_s", _epoch("resolved_at") - _epoch("started_at"))
            .drop("island"))
