"""Registered queries: the streaming monitors run to completion over the tables.

Each query streams the driver's files (or a table Spark derived from them)
with ``availableNow``, writes to the shared checkpoint folder, and returns the
sink's table. Oracles are the batch form; windowed aggregates keep only the
windows closed by the watermark (window end <= max event time - 10 minutes).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shopguard.operators import audit as au
from shopguard.operators import policy as pol
from shopguard.plans import alerting as al
from shopguard.plans.catalog import register
from shopguard.plans.governance import _RUN_PROBES, _RUN_TEXT
from shopguard.plans.shop import _poisoned
from shopguard.session import scratch_path
from shopguard.sources import audit as src
from shopguard.sources import metrics as ms
from shopguard.sources.tables import ORDERS
from shopguard.streaming import monitors as mon

_CLOSED = "(SELECT max(ts) FROM request_log) - INTERVAL 10 MINUTE"


def _events(spark, sf):
    return mon.stream_table(spark, sf, "events")


def _orders_stream(spark, sf):
    path = scratch_path(spark, "order-changes")
    _poisoned(spark, sf).write.mode("overwrite").parquet(path)
    return mon.read_stream(spark, path, ORDERS)


@register("r1_live_request_counters", "R1", oracle=f"""
SELECT * FROM (
  SELECT time_bucket(INTERVAL 15 SECOND, ts) AS bucket_start, instance, count(*) AS total,
         count(*) FILTER (WHERE status_code < 400) AS ok_2xx,
         count(*) FILTER (WHERE status_code >= 400 AND status_code < 500) AS client_4xx,
         count(*) FILTER (WHERE status_code >= 500) AS server_5xx
  FROM request_log GROUP BY ALL)
WHERE bucket_start + INTERVAL 15 SECOND <= {_CLOSED}""")
def r1_live_request_counters(spark, sf):
    out = mon.run_available_now(mon.live_request_counters(ms.request_log_from(_events(spark, sf))), "r1")
    return spark.read.parquet(out)


@register("r2_live_error_rate", "R2", oracle=f"""
SELECT window_start, count(*) AS requests, count(*) FILTER (WHERE status_code >= 500) AS errors,
       count(*) FILTER (WHERE status_code >= 500) / 120 AS rate
FROM (SELECT status_code, ts, unnest([time_bucket(INTERVAL 60 SECOND, ts),
                                      time_bucket(INTERVAL 60 SECOND, ts) - INTERVAL 60 SECOND]) AS window_start
      FROM request_log)
WHERE window_start + INTERVAL 120 SECOND <= {_CLOSED}
GROUP BY window_start""")
def r2_live_error_rate(spark, sf):
    out = mon.run_available_now(mon.live_error_rate(ms.request_log_from(_events(spark, sf))), "r2")
    return spark.read.parquet(out)


@register("r2_counter_deltas", "R2", oracle="""
SELECT metric, instance, ts, value,
       CASE WHEN lag(value) OVER w IS NULL THEN NULL WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w
            ELSE value END AS delta
FROM counter_samples WINDOW w AS (PARTITION BY metric, instance ORDER BY ts)
QUALIFY ts <= (SELECT max(ts) FROM counter_samples) - INTERVAL 10 MINUTE""")
def r2_counter_deltas(spark, sf):
    path = scratch_path(spark, "counter-samples")
    ms.counter_samples(spark, sf).write.mode("overwrite").parquet(path)
    samples = mon.read_stream(spark, path, spark.read.parquet(path).schema)
    return spark.read.parquet(mon.run_available_now(mon.counter_deltas(samples), "r2-deltas"))


@register("r3_alert_state_stream", "R3", oracle="""
SELECT rule, eval_ts, value, breach, state FROM alert_states
WHERE eval_ts <= (SELECT max(eval_ts) FROM alert_states) - INTERVAL 10 MINUTE""")
def r3_alert_state_stream(spark, sf):
    path = scratch_path(spark, "rate-values")
    al._reduced(spark, sf).select(F.lit(al.RULE).alias("rule"), "eval_ts", "value") \
        .write.mode("overwrite").parquet(path)
    values = mon.read_stream(spark, path, spark.read.parquet(path).schema)
    machine = mon.alert_state_stream(values, al.THRESHOLD, al.FOR_S, al.STEP_S)
    return spark.read.parquet(mon.run_available_now(machine, "r3"))


@register("r4_malformed_monitor", "R4", oracle="""
SELECT id, status, error_type, error_key, created_at FROM classified WHERE code IS NOT NULL""")
def r4_malformed_monitor(spark, sf):
    out = mon.run_available_now(mon.malformed_monitor(_orders_stream(spark, sf)), "r4")
    return spark.read.parquet(out)


@register("r4_malformed_per_minute", "R4", oracle="""
SELECT time_bucket(INTERVAL 1 MINUTE, created_at) AS minute, count(*) AS orders,
       count(*) FILTER (WHERE code IS NOT NULL) AS malformed
FROM classified GROUP BY 1
HAVING minute + INTERVAL 1 MINUTE <= (SELECT max(created_at) FROM classified) - INTERVAL 10 MINUTE""")
def r4_malformed_per_minute(spark, sf):
    out = mon.run_available_now(mon.malformed_per_minute(_orders_stream(spark, sf)), "r4-minutes")
    return spark.read.parquet(out)


@register("r4_quarantine_and_counts", "R4", oracle="""
SELECT time_bucket(INTERVAL 1 MINUTE, created_at) AS minute, count(*) AS orders,
       count(*) FILTER (WHERE code IS NOT NULL) AS malformed, max(id) FILTER (WHERE code IS NOT NULL) AS newest_quarantined
FROM classified GROUP BY 1""")
def r4_quarantine_and_counts(spark, sf):
    """Both tables of one stream, per minute."""
    bad, counts = mon.run_quarantine(_orders_stream(spark, sf), scratch_path(spark, "quarantine"))
    newest = bad.groupBy(F.window("created_at", "1 minute")["start"].alias("minute")).agg(
        F.max("id").alias("newest_quarantined"))
    return counts.join(newest, "minute", "left")


@register("r5_heartbeat", "R5", oracle="""
SELECT window_start, pending_reconcile, pending_reconcile = 0 AS ok FROM (
  SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start,
         count(*) FILTER (WHERE status = 'PENDING_RECONCILE') AS pending_reconcile
  FROM poisoned GROUP BY 1)
WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(created_at) FROM poisoned) - INTERVAL 10 MINUTE""")
def r5_heartbeat(spark, sf):
    out = mon.run_available_now(mon.heartbeat_stream(_orders_stream(spark, sf)), "r5")
    return spark.read.parquet(out)


_WATCH = _RUN_PROBES[:3]                             # the three records a run waits for
_WATCH_S = 12 * 3600


@register("r6_incident_watch", "R6", oracle=f"""
WITH hits AS (
  SELECT principal_id AS account, 'INC-' || CAST(event_id // {src.RUN_EVENTS} AS VARCHAR) AS incident, ts,
         {", ".join(f"contains(t, '{p}') AND contains(t, '{a}') AND contains(t, '{b}') AND regexp_matches(t, '(?i)(?:{d})') AS {n}"
                    for n, p, a, b, d in _WATCH)}
  FROM (SELECT *, {_RUN_TEXT} AS t FROM mix_decided)),
runs AS (
  SELECT account, incident, min(ts) AS opened_at, {", ".join(f"min(ts) FILTER (WHERE {n}) AS {n}_first" for n, *_ in _WATCH)}
  FROM hits GROUP BY ALL),
seen AS (
  SELECT account, incident, opened_at,
         {", ".join(f"CASE WHEN epoch({n}_first) - epoch(opened_at) <= {_WATCH_S} THEN {n}_first END AS {n}_at"
                    for n, *_ in _WATCH)} FROM runs),
closed AS (
  SELECT *, {" AND ".join(f"{n}_at IS NOT NULL" for n, *_ in _WATCH)} AS complete FROM seen)
SELECT account, incident, opened_at, {", ".join(f"{n}_at" for n, *_ in _WATCH)},
       CASE WHEN complete THEN greatest({", ".join(f"{n}_at" for n, *_ in _WATCH)})
            ELSE opened_at + INTERVAL {_WATCH_S} SECOND END AS closed_at, complete
FROM closed WHERE closed_at <= {_CLOSED}""")
def r6_incident_watch(spark, sf):
    d = pol.decide(src.request_mix_from(_events(spark, sf)))
    text = F.col("_text")
    records = d.select(F.col("principal_id").alias("account"), src.incident_of(F.col("event_id")).alias("incident"), "ts",
                       src.decided_record(d).alias("_text"))
    records = records.select("account", "incident", "ts",
                             *[au.evidence(text, p, n1, n2, x).alias(n) for n, p, n1, n2, x in _WATCH])
    out = mon.run_available_now(mon.incident_watch(records, [n for n, *_ in _WATCH], _WATCH_S), "r6")
    return spark.read.parquet(out)


@register("r7_live_decisions", "R7", oracle="""
SELECT event_id, principal_id, action, resource_id, decision, array_to_string(permits, ',') AS permits,
       array_to_string(forbids, ',') AS forbids, error, array_to_string(redactions, ',') AS redactions,
       CAST(max_rows AS INTEGER) AS max_rows
FROM decided""")
def r7_live_decisions(spark, sf):
    from shopguard.plans.governance import _decisions

    d = mon.live_decisions(src.policy_requests_from(_events(spark, sf)), pol.POLICIES)
    return spark.read.parquet(mon.run_available_now(_decisions(d), "r7"))
