"""Request log, counter samples and exposition text derived from ``events``.

error -> 500, signup -> 404, anything else 200; instance app-01 for even
user ids, else app-02. Counter samples: per (instance, hour) the cumulative
request and 5xx counts since the start of the day, scraped at the end of the
hour, so every midnight is a counter reset (FIXTURES.md section 3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopguard.operators.metrics import fixed_text
from shopguard.sources.tables import load_table

# Target and external labels of the scrape, HELP texts.
JOB, ENV, PROJECT = "orders-api", "prod", "shop"
COUNTERS = ("http_requests_total", "http_requests_5xx_total", "http_requests_4xx_total",
            "orders_malformed_payload_total")
HELP = {
    "http_requests_total": "Total HTTP requests handled.",
    "http_requests_5xx_total": "Total responses with status >= 500.",
    "http_requests_4xx_total": "Total responses with status 400-499.",
    "orders_api_up": "1 if the process is serving.",
    "orders_api_uptime_seconds": "Seconds since process start.",
    "orders_malformed_payload_total": "Order payloads that failed enrichment.",
    "http_5xx_ratio": "Fraction of requests failing with 5xx.",
    "up": "1 if the target is up.",
    "http_responses_total": "Total HTTP responses by path and class.",
    "process_cpu_seconds_total": "Total user and system CPU time spent in seconds.",
}


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log_from(load_table(spark, sf_dir, "events"))


def request_log_from(e: DataFrame) -> DataFrame:
    """``request_log`` over any events frame (batch or streaming)."""
    return e.select(
        F.col("event_id").alias("request_id"), "ts",
        F.when(F.col("user_id") % 2 == 0, "app-01").otherwise("app-02").alias("instance"),
        F.lit("/orders").alias("path"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404)
        .otherwise(200).alias("status_code"),
        (F.col("event_type") == "error").alias("unhandled"))


def hourly_counts(log: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return log.groupBy("instance", hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status_code") >= 500).alias("errors"),
        F.count_if((F.col("status_code") >= 400) & (F.col("status_code") < 500)).alias("refused"),
        F.count_if("unhandled").alias("malformed"))


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, type, job, instance, host, env, project, ts, value."""
    h = hourly_counts(request_log(spark, sf_dir))
    long = h.select("instance", "hour", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(c).alias("n"))
          for m, c in zip(COUNTERS, ("total", "errors", "refused", "malformed"))])).alias("m")) \
        .select("instance", "hour", "m.metric", "m.n")
    day = F.date_trunc("day", F.col("hour")).cast("timestamp_ntz")
    # A day holds at most 24 samples per series: the window groups stay small.
    w = Window.partitionBy("metric", "instance", day).orderBy("hour")
    return long.select(
        "metric", F.lit("counter").alias("type"), F.lit(JOB).alias("job"), "instance",
        F.col("instance").alias("host"), F.lit(ENV).alias("env"), F.lit(PROJECT).alias("project"),
        (F.col("hour") + F.make_dt_interval(hours=F.lit(1))).alias("ts"),
        F.sum("n").over(w).cast("double").alias("value"))


def exposition_lines(samples: DataFrame) -> DataFrame:
    """Prometheus text exposition, one scrape per (instance, ts): HELP/TYPE/sample lines."""
    scrape = samples.groupBy("instance", "ts").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c)
          for m, c in zip(COUNTERS, ("total", "errors", "refused", "malformed"))])
    # The counters start at midnight, and so does the process.
    uptime = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(
        F.date_trunc("day", F.col("ts") - F.make_dt_interval(hours=F.lit(1))).cast("timestamp"))
    # Printed as the service prints it: f"{rate:.4f}", 0.0 when no requests.
    ratio = F.when(F.col("total") > 0, fixed_text(F.col("errors") / F.col("total"), 4)).otherwise("0.0000")
    metrics = [("orders_api_up", "gauge", F.lit("1")),
               ("orders_api_uptime_seconds", "gauge", F.concat(uptime.cast("string"), F.lit(".0"))),
               ("http_requests_4xx_total", "counter", F.col("refused")),
               ("orders_malformed_payload_total", "counter", F.col("malformed")),
               ("http_requests_total", "counter", F.col("total")),
               ("http_requests_5xx_total", "counter", F.col("errors")),
               ("http_5xx_ratio", "gauge", ratio),
               ("up", "gauge", F.lit(1.0)),
               ("process_cpu_seconds_total", "counter", F.round(F.col("total") * 0.01, 2))]
    lines = []
    for name, typ, val in metrics:
        lines += [F.lit(f"# HELP {name} {HELP[name]}"), F.lit(f"# TYPE {name} {typ}"),
                  F.concat(F.lit(name + " "), val.cast("string"))]
    # One metric whose series differ in their labels only.
    name = "http_responses_total"
    lines += [F.lit(f"# HELP {name} {HELP[name]}"), F.lit(f"# TYPE {name} counter"),
              F.concat(F.lit(name + '{path="/orders",class="5xx"} '), F.col("errors").cast("string")),
              F.concat(F.lit(name + '{class="other",path="/orders"} '), (F.col("total") - F.col("errors")).cast("string"))]
    return scrape.select(
        F.concat_ws("|", "instance", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("scrape_id"),
        "instance", "ts", F.posexplode(F.array(*lines)).alias("line_no", "line"))


def parse_exposition(lines: DataFrame) -> DataFrame:
    """Parse ``name[{labels}] value``, attach the ``# TYPE`` of the same
    scrape, and add target (instance, job) and external labels. The sample's own
    labels stay, as a map; they are part of its series.

    One pass: a TYPE line carries its type to the samples of its metric by a
    window over (scrape, metric), whose groups are one scrape's lines.
    """
    name = r"([a-zA-Z_:][a-zA-Z0-9_:]*)"
    is_type = F.col("line").startswith("# TYPE ")
    pair = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\\\]|\\\\.)*)"'
    inner = F.regexp_extract("line", r"^[a-zA-Z_:][a-zA-Z0-9_:]*\{(.*)\}", 1)
    staged = lines.where(is_type | (~F.col("line").startswith("#") & (F.trim("line") != ""))).select(
        "scrape_id", "instance", "ts", is_type.alias("_is_type"),
        F.when(is_type, F.regexp_extract("line", rf"^# TYPE {name}", 1))
        .otherwise(F.regexp_extract("line", rf"^{name}", 1)).alias("metric"),
        F.when(is_type, F.regexp_extract("line", rf"^# TYPE {name} (\S+)", 2)).alias("_type"),
        F.map_from_arrays(F.regexp_extract_all(inner, F.lit(pair), F.lit(1)),
                          F.regexp_extract_all(inner, F.lit(pair), F.lit(2))).alias("labels"),
        F.expr(r"try_cast(regexp_extract(line, '\\s(\\S+)\\s*$', 1) AS DOUBLE)").alias("value"))
    typed = staged.withColumn("type", F.max("_type").over(Window.partitionBy("scrape_id", "metric")))
    return (typed.where("NOT _is_type")
            .select("metric", F.coalesce("type", F.lit("untyped")).alias("type"), F.lit(JOB).alias("job"),
                    "instance", F.col("instance").alias("host"), F.lit(ENV).alias("env"),
                    F.lit(PROJECT).alias("project"), "labels", "ts", "value"))


def label_text(labels: F.Column) -> F.Column:
    """A label map as ``a=1,b=2``, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
