"""Registered queries: request counters, counter rates and the alert rule, batch form.

``events`` are sparse (one every few minutes), so the checked queries scale the
rule up as FIXTURES.md prescribes: 6 h rate window, 1 h evaluation step, 3 h
look-back, ``for`` 1 h and a threshold of 3 errors per hour. The library
defaults stay 2 min, 60 s, 600 s, 1 min and 0.05 errors per second.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shopguard.operators import metrics as mt
from shopguard.plans.catalog import register
from shopguard.plans.sql import VIEWS
from shopguard.sources import metrics as ms

WINDOW_S, STEP_S, LOOKBACK_S, FOR_S = 6 * 3600, 3600, 3 * 3600, 3600
THRESHOLD = 3.0 / 3600
RULE = "orders-api-5xx-rate"

VIEWS["request_log"] = """
SELECT event_id AS request_id, ts, CASE WHEN user_id % 2 = 0 THEN 'app-01' ELSE 'app-02' END AS instance,
       '/orders' AS path,
       CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status_code,
       event_type = 'error' AS unhandled
FROM events"""
VIEWS["counter_samples"] = """
SELECT metric, 'counter' AS type, 'orders-api' AS job, instance, instance AS host, 'prod' AS env, 'shop' AS project,
       hour + INTERVAL 1 HOUR AS ts,
       CAST(sum(n) OVER (PARTITION BY metric, instance, date_trunc('day', hour) ORDER BY hour) AS DOUBLE) AS value
FROM (SELECT instance, date_trunc('hour', ts) AS hour, 'http_requests_total' AS metric, count(*) AS n
      FROM request_log GROUP BY 1, 2
      UNION ALL
      SELECT instance, date_trunc('hour', ts), 'http_requests_5xx_total', count(*) FILTER (WHERE status_code >= 500)
      FROM request_log GROUP BY 1, 2
      UNION ALL
      SELECT instance, date_trunc('hour', ts), 'http_requests_4xx_total',
             count(*) FILTER (WHERE status_code >= 400 AND status_code < 500) FROM request_log GROUP BY 1, 2
      UNION ALL
      SELECT instance, date_trunc('hour', ts), 'orders_malformed_payload_total', count(*) FILTER (WHERE unhandled)
      FROM request_log GROUP BY 1, 2)"""
VIEWS["counter_windows"] = f"""
SELECT metric, instance, t, count(*) AS samples,
       min(ts_s) AS first_s, max(ts_s) AS last_s, arg_min(value, ts_s) AS first_v,
       sum(delta) FILTER (WHERE prev_s > t - {WINDOW_S}) AS increase
FROM (SELECT *, unnest(range(CAST(ceil(ts_s / {STEP_S}) * {STEP_S} AS BIGINT), ts_s + {WINDOW_S}, {STEP_S})) AS t
      FROM (SELECT *, CASE WHEN prev_v IS NULL THEN NULL WHEN value >= prev_v THEN value - prev_v ELSE value END AS delta
            FROM (SELECT metric, instance, CAST(epoch(ts) AS BIGINT) AS ts_s, value,
                         lag(value) OVER (PARTITION BY metric, instance ORDER BY ts) AS prev_v,
                         lag(CAST(epoch(ts) AS BIGINT)) OVER (PARTITION BY metric, instance ORDER BY ts) AS prev_s
                  FROM counter_samples)))
GROUP BY metric, instance, t"""
VIEWS["summed_rate"] = f"""
SELECT metric, make_timestamp(t * 1000000) AS eval_ts, sum(increase / {WINDOW_S}) AS value
FROM counter_windows WHERE samples >= 2 AND increase IS NOT NULL GROUP BY metric, t"""
VIEWS["reduced"] = f"""
SELECT metric, make_timestamp(t * 1000000) AS eval_ts, arg_max(value, p_s) AS value
FROM (SELECT *, unnest(range(CAST(ceil(p_s / {STEP_S}) * {STEP_S} AS BIGINT), p_s + {LOOKBACK_S}, {STEP_S})) AS t
      FROM (SELECT metric, value, CAST(epoch(eval_ts) AS BIGINT) AS p_s FROM summed_rate
            WHERE metric = 'http_requests_5xx_total' AND value IS NOT NULL AND NOT isnan(value)))
GROUP BY metric, t"""
VIEWS["alert_states"] = f"""
SELECT rule, eval_ts, value, breach, island,
       CASE WHEN NOT breach THEN 'inactive' WHEN epoch(eval_ts) - epoch(st) >= {FOR_S} THEN 'firing' ELSE 'pending' END
           AS state,
       CASE WHEN breach THEN st END AS breach_started
FROM (SELECT *, min(CASE WHEN breach THEN eval_ts END) OVER (PARTITION BY rule, island) AS st
      FROM (SELECT *, CAST(sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY rule ORDER BY eval_ts
                      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
            FROM (SELECT g.rule, g.eval_ts, r.value, coalesce(r.value > {THRESHOLD!r}, false) AS breach
                  FROM (SELECT rule, unnest(range(lo, hi + INTERVAL 1 SECOND, INTERVAL {STEP_S} SECOND)) AS eval_ts
                        FROM (SELECT '{RULE}' AS rule, min(eval_ts) AS lo, max(eval_ts) AS hi FROM reduced)) g
                  LEFT JOIN (SELECT '{RULE}' AS rule, eval_ts, value FROM reduced) r USING (rule, eval_ts))))"""


def _samples(spark, sf):
    return ms.counter_samples(spark, sf)


def _reduced(spark, sf):
    rates = mt.counter_rate(_samples(spark, sf).where(F.col("metric") == "http_requests_5xx_total"),
                            WINDOW_S, STEP_S)
    return mt.reduce_last(mt.sum_rate(rates), LOOKBACK_S, STEP_S)


def _states(spark, sf):
    values = _reduced(spark, sf).select(F.lit(RULE).alias("rule"), "eval_ts", "value")
    return mt.alert_states(values, THRESHOLD, FOR_S, STEP_S)


@register("t9_status_classes", "T9", oracle="""
SELECT instance, CASE WHEN status_code >= 500 THEN '5xx' WHEN status_code >= 400 THEN '4xx' ELSE '2xx' END
           AS status_class, count(*) AS requests
FROM request_log GROUP BY ALL""")
def t9_status_classes(spark, sf):
    log = ms.request_log(spark, sf)
    return log.groupBy("instance", mt.status_class(F.col("status_code")).alias("status_class")) \
        .agg(F.count(F.lit(1)).alias("requests"))


@register("a5_request_counters", ("A5", "R1"), bench=True, oracle="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, instance, count(*) AS total,
       count(*) FILTER (WHERE status_code < 400) AS ok_2xx,
       count(*) FILTER (WHERE status_code >= 400 AND status_code < 500) AS client_4xx,
       count(*) FILTER (WHERE status_code >= 500) AS server_5xx,
       count(*) FILTER (WHERE unhandled) AS unhandled_total,
       CASE WHEN count(*) > 0 THEN CAST(printf('%.4f', count(*) FILTER (WHERE status_code >= 500) / count(*)) AS DOUBLE)
            ELSE 0 END AS ratio
FROM request_log GROUP BY ALL""")
def a5_request_counters(spark, sf):
    return mt.request_counters(ms.request_log(spark, sf), "1 hour")


@register("s5_counter_samples", "S5", oracle="""
SELECT metric, type, job, instance, host, env, project, ts, value FROM counter_samples""")
def s5_counter_samples(spark, sf):
    return _samples(spark, sf)


@register("s5_parse_exposition", "S5", oracle="""
SELECT metric, type, job, instance, host, env, project, '' AS labels, ts, value FROM counter_samples
UNION ALL
SELECT 'http_5xx_ratio', 'gauge', job, instance, host, env, project, '', ts,
       CASE WHEN t > 0 THEN CAST(printf('%.4f', e / t) AS DOUBLE) ELSE 0 END
FROM (SELECT job, instance, host, env, project, ts,
             max(value) FILTER (WHERE metric = 'http_requests_total') AS t,
             max(value) FILTER (WHERE metric = 'http_requests_5xx_total') AS e
      FROM counter_samples GROUP BY ALL)
UNION ALL
SELECT unnest(['up', 'orders_api_up']), 'gauge', job, instance, host, env, project, '', ts, 1.0 FROM counter_samples
WHERE metric = 'http_requests_total'
UNION ALL
SELECT 'orders_api_uptime_seconds', 'gauge', job, instance, host, env, project, '', ts,
       epoch(ts) - epoch(date_trunc('day', ts - INTERVAL 1 HOUR)) FROM counter_samples WHERE metric = 'http_requests_total'
UNION ALL
SELECT 'process_cpu_seconds_total', 'counter', job, instance, host, env, project, '', ts, round(value * 0.01, 2)
FROM counter_samples WHERE metric = 'http_requests_total'
UNION ALL
SELECT 'http_responses_total', 'counter', job, instance, host, env, project,
       unnest(['class=5xx,path=/orders', 'class=other,path=/orders']), ts, unnest([e, t - e])
FROM (SELECT job, instance, host, env, project, ts,
             max(value) FILTER (WHERE metric = 'http_requests_total') AS t,
             max(value) FILTER (WHERE metric = 'http_requests_5xx_total') AS e
      FROM counter_samples GROUP BY ALL)""")
def s5_parse_exposition(spark, sf):
    parsed = ms.parse_exposition(ms.exposition_lines(_samples(spark, sf)))
    return parsed.withColumn("labels", ms.label_text(F.col("labels")))


@register("p9_keep_list", "P9", oracle="""
SELECT metric, count(*) AS samples, count(DISTINCT instance) AS series FROM (
  SELECT metric, instance FROM counter_samples
  UNION ALL SELECT 'http_5xx_ratio', instance FROM counter_samples WHERE metric = 'http_requests_total'
  UNION ALL SELECT unnest(['up', 'orders_api_up', 'orders_api_uptime_seconds']), instance FROM counter_samples
            WHERE metric = 'http_requests_total')
GROUP BY metric""")
def p9_keep_list(spark, sf):
    parsed = ms.parse_exposition(ms.exposition_lines(_samples(spark, sf)))
    return mt.keep_series(parsed).groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("instance").alias("series"))


@register("w2_counter_rate", "W2", bench=True, oracle=f"""
SELECT metric, instance, make_timestamp(t * 1000000) AS eval_ts, samples, increase,
       CASE WHEN samples >= 2 THEN increase / {WINDOW_S} END AS rate
FROM counter_windows""")
def w2_counter_rate(spark, sf):
    return mt.counter_rate(_samples(spark, sf), WINDOW_S, STEP_S)


_EXT = f"""
SELECT metric, instance, make_timestamp(t * 1000000) AS eval_ts, samples, increase,
       CASE WHEN samples >= 2 AND last_s > first_s THEN
         increase * (((last_s - first_s)
                      + CASE WHEN to_start < gap * 1.1 THEN to_start ELSE gap / 2 END
                      + CASE WHEN to_end < gap * 1.1 THEN to_end ELSE gap / 2 END)
                     / (last_s - first_s)) / {WINDOW_S} END AS rate
FROM (SELECT *, CASE WHEN increase > 0 AND first_v >= 0
                      AND (last_s - first_s) * (first_v / increase) < first_s - (t - {WINDOW_S})
                     THEN (last_s - first_s) * (first_v / increase)
                     ELSE CAST(first_s - (t - {WINDOW_S}) AS DOUBLE) END AS to_start,
             CAST(t - last_s AS DOUBLE) AS to_end,
             CAST(last_s - first_s AS DOUBLE) / (samples - 1) AS gap
      FROM counter_windows)"""


@register("w2_counter_rate_extrapolated", "W2", oracle=_EXT)
def w2_counter_rate_extrapolated(spark, sf):
    return mt.counter_rate(_samples(spark, sf), WINDOW_S, STEP_S, extrapolate=True)


@register("w2_sum_rate", "W2", oracle="SELECT metric, eval_ts, value FROM summed_rate")
def w2_sum_rate(spark, sf):
    return mt.sum_rate(mt.counter_rate(_samples(spark, sf), WINDOW_S, STEP_S))


@register("w3_reduce_last", "W3", oracle="SELECT metric, eval_ts, value FROM reduced")
def w3_reduce_last(spark, sf):
    return _reduced(spark, sf)


@register("w4_threshold", "W4", oracle=f"""
SELECT metric, eval_ts, value, coalesce(value > {THRESHOLD!r}, false) AS breach FROM reduced""")
def w4_threshold(spark, sf):
    return mt.threshold(_reduced(spark, sf), THRESHOLD)


@register("w5_alert_states", "W5", bench=True, oracle="""
SELECT rule, eval_ts, value, breach, island, state, breach_started FROM alert_states""")
def w5_alert_states(spark, sf):
    return _states(spark, sf).select("rule", "eval_ts", "value", "breach", "island", "state",
                                     "breach_started")


@register("w6_alert_episodes", "W6", oracle=f"""
SELECT rule, min(eval_ts) AS started_at, min(eval_ts) FILTER (WHERE state = 'firing') AS firing_at,
       max(eval_ts) AS last_breach_at, count(*) AS evaluations, max(value) AS peak,
       max(eval_ts) + INTERVAL {STEP_S} SECOND AS resolved_at,
       CAST(epoch(max(eval_ts) + INTERVAL {STEP_S} SECOND) - epoch(min(eval_ts)) AS BIGINT) AS duration_s
FROM alert_states WHERE breach GROUP BY rule, island""")
def w6_alert_episodes(spark, sf):
    return mt.alert_episodes(_states(spark, sf), STEP_S)
