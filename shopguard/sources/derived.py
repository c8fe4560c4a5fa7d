"""Operational text tables derived from the driver tables.

Alert webhooks and incident records come from ``events`` of type error; the
access-request listing from the access requests; jobs from ``documents``
(their text is the job's output); rule-group documents from the alert states.
Every shape the parsers must handle appears, chosen by the row's own data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopguard.sources.tables import load_table

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
JOB_EPOCH = "2026-08-28 00:00:00"


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def alert_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One webhook body per error event, in four shapes (by ``event_id % 4``):
    a full envelope, one with an empty fingerprint and common labels, one with
    an empty alert list, and a flat payload."""
    e = load_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k")
    iso = F.date_format("ts", ISO)
    inst = F.when(F.col("user_id") % 2 == 0, "app-01").otherwise("app-02")
    full = F.concat(
        F.lit('{"title":"Orders API 5xx","status":"firing","externalURL":"https://alerts.example/",'
              '"message":"5xx rate above threshold on '), inst,
        F.lit('","alerts":[{"fingerprint":"fp'), _s("event_id"),
        F.lit('","labels":{"alertname":"OrdersApi5xx","severity":"critical","service":"orders-api"},'
              '"annotations":{"summary":"5xx burst","description":"errors on app"},"startsAt":"'), iso,
        F.lit('","generatorURL":"https://alerts.example/rule/'), _s("event_id"), F.lit('"}]}'))
    partial = F.concat(
        F.lit('{"status":"resolved","externalURL":"https://alerts.example/",'
              '"commonLabels":{"alertname":"OrdersApi5xx","severity":"warning"},'
              '"alerts":[{"fingerprint":"","labels":{"alertname":"OrdersApi5xx"},'
              '"annotations":{"summary":"5xx on '), inst, F.lit('","description":"count '), k,
        F.lit('"},"startsAt":"'), iso, F.lit('"}]}'))
    empty = F.lit('{"title":"","commonLabels":{"alertname":"OrdersApiDown","service":"checkout"},'
                  '"commonAnnotations":{"summary":"down"},"alerts":[]}')
    flat = F.concat(F.lit('{"incident_id":"INC-'), _s(F.col("event_id") % 50 + 100),
                    F.lit('","title":"Manual page","urgency":"low"}'))
    m = F.col("event_id") % 4
    body = F.when(m == 0, full).when(m == 1, partial).when(m == 2, empty).otherwise(flat)
    return e.select("event_id", body.alias("payload"))


def incident_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident records as JSON; the id sits under ``incidentID`` or ``id``."""
    e = load_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    key = F.when(F.col("event_id") % 2 == 0, F.lit("incidentID")).otherwise(F.lit("id"))
    sev = (F.when(k % 4 == 0, "pending").when(k % 4 == 1, "minor").when(k % 4 == 2, "major")
           .otherwise("critical"))
    status = F.when(k % 3 == 0, "resolved").otherwise("active")
    doc = F.concat(F.lit('{"'), key, F.lit('":"INC-'), _s("event_id"),
                   F.lit('","title":"5xx on orders","severity":"'), sev, F.lit('","status":"'), status,
                   F.lit('","isDrill":false,"createdAt":"'), F.date_format("ts", ISO), F.lit('"}'))
    return e.select("event_id", doc.alias("doc"))


def listing_lines(requests: DataFrame) -> DataFrame:
    """A text listing of access requests per day: a column header line, then per
    request a header line starting with its id and two indented detail lines."""
    day = F.date_format("submitted_at", "yyyy-MM-dd")
    head = F.concat_ws("  ", "request_id", "status", "resource", "duration", "account")
    lines = F.array(
        F.struct(F.lit(0).alias("i"), head.alias("line")),
        F.struct(F.lit(1).alias("i"), F.concat(F.lit("    reason: "), F.col("reason")).alias("line")),
        F.struct(F.lit(2).alias("i"), F.concat(F.lit("    incident: "), F.col("incident_id")).alias("line")))
    body = requests.select(F.concat(F.lit("listing-"), day).alias("file"), "event_id",
                           F.explode(lines).alias("l")) \
        .select("file", (F.col("event_id") * 10 + F.col("l.i") + 1).alias("line_no"), F.col("l.line").alias("line"))
    title = body.select("file").distinct().select(
        "file", F.lit(0).cast("long").alias("line_no"),
        F.lit("ID  STATUS  RESOURCE  DURATION  ACCOUNT").alias("line"))
    return title.unionByName(body)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent jobs: one per document; its text is the job's stdout."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    m = F.col("doc_id") % 5
    return d.select(
        F.concat(F.lit("job-"), F.lpad(_s("doc_id"), 6, "0")).alias("job_id"),
        F.concat(F.lit("session-"), _s(F.col("doc_id") % 4)).alias("session"),
        (F.lit(JOB_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id") * 97)).alias("submitted_at"),
        (m == 4).alias("timed_out"),
        F.when(m == 3, 1).otherwise(0).alias("exit_code"),
        F.col("text").alias("stdout"),
        F.when(m == 4, F.lit("agent exceeded 900s and was killed"))
        .otherwise(F.concat(F.lit("lang="), F.col("lang"), F.lit(" source="), F.col("source"))).alias("stderr"),
        (F.col("n_chars") / 73.0).alias("duration_raw"))


def rule_group_docs(states: DataFrame, rule_name: str) -> DataFrame:
    """Rule-group documents per evaluation: the rule's state, a second rule, and
    a later group that repeats the rule name (the first one must win)."""
    doc = F.concat(
        F.lit('{"data":{"groups":[{"name":"orders","rules":[{"name":"' + rule_name + '","state":"'),
        F.col("state"),
        F.lit('"},{"name":"orders-api-latency","state":"inactive"}]},'
              '{"name":"other","rules":[{"name":"' + rule_name + '","state":"inactive"}]}]}}'))
    return states.select(F.unix_seconds(F.col("eval_ts").cast("timestamp")).alias("doc_id"), doc.alias("doc"))


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent's shell command log: one command and one file path per event.

    SQL events run the query wrapper (a view with ``k % 5 = 4`` chains a denied
    config command), purchases ask for access, errors check or administer the
    gateway, signups try host commands; paths fall inside, at the edge of, or
    outside the workspace prefixes.
    """
    e = load_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    ks = _s(k)
    view = F.concat(F.lit('./bin/db-query.sh "SELECT * FROM public.orders WHERE id = '), ks, F.lit('"'),
                    F.when(k % 5 == 4, F.lit("; picoclaw config show")).otherwise(F.lit("")))
    command = (F.when(et == "view", view)
               .when(et == "click", F.concat(F.lit('bin/db-query.sh --json "SELECT id, name FROM public.customers '
                                                   'WHERE id = '), ks, F.lit('"')))
               .when(et == "purchase", F.concat(F.lit("./bin/sdm-request-access.sh pg-prod-remediation 15m INC-"),
                                                _s(F.col("event_id") % 50 + 100)))
               .when(et == "error", F.when(k % 2 == 0, F.lit("sdm status")).otherwise(F.lit("sdm admin users list")))
               .when(k % 3 == 0, F.lit("crontab -l"))
               .when(k % 3 == 1, F.lit("systemctl restart orders-api"))
               .otherwise(F.lit("curl -s https://status.example/")))
    path = (F.when(et == "view", F.concat(F.lit("/opt/agent/workspace/sessions/"), _s("event_id"), F.lit(".json")))
            .when(et == "click", F.lit("/opt/agent/workspace/notes.md"))
            .when(et == "purchase", F.lit("/var/log/agent/agent.log"))
            .when(et == "error", F.lit("/opt/agent/workspace/memory"))
            .otherwise(F.concat(F.lit("/opt/agent/workspace-old/"), ks)))
    return e.select("event_id", "ts", F.concat(F.lit("session-"), _s(F.col("user_id") % 4)).alias("session"),
                    command.alias("command"), path.alias("path"))


# The login role of each events user and its attributes.
ROLE_PREFIX = "app_u"


def role_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``pg_roles``-like catalog: one login role per events user, in the
    user's account class (``user_id % 3``, as in the audit binding); a few
    roles carry administrative attributes, chosen by the user id."""
    u = F.col("user_id")
    users = load_table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit(ROLE_PREFIX), _s(u)).alias("rolname"), (u % 3).alias("account_class"),
        ((u % 3 == 1) & (u % 7 == 0)).alias("rolsuper"),
        (u % 11 == 0).alias("rolcreatedb"),
        ((u % 3 == 1) & (u % 5 == 0)).alias("rolcreaterole"),
        ((u % 3 == 2) & (u % 13 == 0)).alias("rolbypassrls"),
        (u % 17 != 0).alias("rolinherit"))
