"""Registered queries: alerts, access requests, jobs, incidents, rule states,
drift checks, text sources and sinks, snapshots and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopguard.operators import lifecycle as lc
from shopguard.operators import policy as pol
from shopguard.operators import privacy as pv
from shopguard.operators import quality as qa
from shopguard.operators import records as rc
from shopguard.operators import versions as vs
from shopguard.plans.alerting import RULE, _states
from shopguard.plans.catalog import register
from shopguard.plans.sql import VIEWS
from shopguard.session import scratch_path
from shopguard.sources import audit as src
from shopguard.sources import bindings as b
from shopguard.sources import derived as dv
from shopguard.sources import text as tx
from shopguard.sources.tables import ORDERS

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_INST = "CASE WHEN user_id % 2 = 0 THEN 'app-01' ELSE 'app-02' END"
VIEWS["alert_webhooks"] = f"""
SELECT event_id, CASE event_id % 4
  WHEN 0 THEN '{{"title":"Orders API 5xx","status":"firing","externalURL":"https://alerts.example/","message":"5xx rate above threshold on '
       || {_INST} || '","alerts":[{{"fingerprint":"fp' || event_id
       || '","labels":{{"alertname":"OrdersApi5xx","severity":"critical","service":"orders-api"}},"annotations":{{"summary":"5xx burst","description":"errors on app"}},"startsAt":"'
       || {_ISO} || '","generatorURL":"https://alerts.example/rule/' || event_id || '"}}]}}'
  WHEN 1 THEN '{{"status":"resolved","externalURL":"https://alerts.example/","commonLabels":{{"alertname":"OrdersApi5xx","severity":"warning"}},"alerts":[{{"fingerprint":"","labels":{{"alertname":"OrdersApi5xx"}},"annotations":{{"summary":"5xx on '
       || {_INST} || '","description":"count ' || json_extract_string(props, '$.k') || '"}},"startsAt":"' || {_ISO} || '"}}]}}'
  WHEN 2 THEN '{{"title":"","commonLabels":{{"alertname":"OrdersApiDown","service":"checkout"}},"commonAnnotations":{{"summary":"down"}},"alerts":[]}}'
  ELSE '{{"incident_id":"INC-' || (event_id % 50 + 100) || '","title":"Manual page","urgency":"low"}}' END AS payload
FROM events WHERE event_type = 'error'"""


def _nonempty(j: str, path: str) -> str:
    return f"(json_type({j}, '{path}') = 'OBJECT' AND len(json_keys({j}, '{path}')) > 0)"


def _get(j: str, path: str, default: str) -> str:
    return f"(CASE WHEN json_type({j}, '{path}') IS NOT NULL THEN json_extract_string({j}, '{path}') ELSE '{default}' END)"


def _or(*xs: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} <> '' THEN {x}" for x in xs[:-1]) + f" ELSE {xs[-1]} END)"


_T4 = f"""
WITH a AS (
  SELECT event_id, payload AS p, json_type(payload, '$.alerts') = 'ARRAY' AS is_list,
         CASE WHEN json_type(payload, '$.alerts[0]') = 'OBJECT' THEN json_extract(payload, '$.alerts[0]')
              ELSE JSON '{{}}' END AS f
  FROM alert_webhooks),
b AS (
  SELECT *, CASE WHEN {_nonempty('f', '$.labels')} THEN json_extract(f, '$.labels')
                 WHEN {_nonempty('p', '$.commonLabels')} THEN json_extract(p, '$.commonLabels') ELSE JSON '{{}}' END AS lb,
            CASE WHEN {_nonempty('f', '$.annotations')} THEN json_extract(f, '$.annotations')
                 WHEN {_nonempty('p', '$.commonAnnotations')} THEN json_extract(p, '$.commonAnnotations') ELSE JSON '{{}}' END AS an
  FROM a)
SELECT event_id, coalesce(is_list, false) AS from_webhook,
  CASE WHEN is_list THEN {_or("json_extract_string(f, '$.fingerprint')", "json_extract_string(lb, '$.alertname')", "'GRAFANA-ALERT'")}
       ELSE {_get('p', '$.incident_id', 'UNKNOWN')} END AS incident_id,
  CASE WHEN is_list THEN {_or("json_extract_string(p, '$.title')", "json_extract_string(an, '$.summary')", _get('lb', '$.alertname', ''))}
       ELSE {_get('p', '$.title', 'Untitled alert')} END AS title,
  CASE WHEN is_list THEN {_get('lb', '$.service', 'orders-api')} ELSE {_get('p', '$.service', 'orders-api')} END AS service,
  CASE WHEN is_list THEN {_get('lb', '$.severity', 'high')} ELSE {_get('p', '$.urgency', 'high')} END AS urgency,
  {_get('p', '$.status', 'firing')} AS status,
  CASE WHEN is_list THEN {_get('f', '$.startsAt', '')} ELSE {_get('p', '$.created_at', '')} END AS created_at,
  CASE WHEN is_list THEN {_or("json_extract_string(f, '$.generatorURL')", _get('p', '$.externalURL', ''))}
       ELSE {_get('p', '$.html_url', '')} END AS html_url,
  CASE WHEN is_list THEN substring({_or("json_extract_string(p, '$.message')", _get('an', '$.description', ''))}, 1, 2000)
       ELSE {_get('p', '$.details', '')} END AS details
FROM b"""


@register("t4_normalise_alerts", "T4", oracle=_T4)
def t4_normalise_alerts(spark, sf):
    return rc.normalise_alerts(dv.alert_webhooks(spark, sf))


@register("t7_validate_requests", "T7", oracle="""
SELECT request_id, length(reason) >= 80 AS reason_length, contains(reason, incident_id) AS reason_has_incident,
       duration = '15m' AS duration_15m, contains(reason, 'UPDATE public.orders') AS mentions_update,
       contains(reason, '400') AS mentions_row_count, contains(reason, 'poison_backup') AS mentions_backup,
       array_to_string(list_filter([
         CASE WHEN NOT length(reason) >= 80 THEN 'reason_length' END,
         CASE WHEN NOT contains(reason, incident_id) THEN 'reason_has_incident' END,
         CASE WHEN NOT duration = '15m' THEN 'duration_15m' END,
         CASE WHEN NOT contains(reason, 'UPDATE public.orders') THEN 'mentions_update' END,
         CASE WHEN NOT contains(reason, '400') THEN 'mentions_row_count' END,
         CASE WHEN NOT contains(reason, 'poison_backup') THEN 'mentions_backup' END], lambda x: x IS NOT NULL), ',')
         AS failed_rules
FROM access_requests""")
def t7_validate_requests(spark, sf):
    v = rc.validate_requests(src.access_requests(src.policy_requests(spark, sf)))
    return v.select("request_id", "reason_length", "reason_has_incident", "duration_15m", "mentions_update",
                    "mentions_row_count", "mentions_backup", F.array_join("failed_rules", ",").alias("failed_rules"))


def _listing(spark, sf):
    return dv.listing_lines(src.access_requests(src.policy_requests(spark, sf)))


VIEWS["segments"] = """
SELECT 'listing-' || strftime(submitted_at, '%Y-%m-%d') AS file, event_id * 10 + 1 AS start_line,
       request_id AS record_id,
       concat_ws('  ', request_id, status, resource, duration, account) || chr(10) || '    reason: ' || reason
         || chr(10) || '    incident: ' || incident_id AS text
FROM access_requests"""


@register("s6_segment_listing", ("S6", "W11"), oracle="SELECT file, start_line, record_id, text FROM segments")
def s6_segment_listing(spark, sf):
    return tx.whole_records(tx.segment_records(_listing(spark, sf), part_lines=2))


@register("s6_record_parts", ("S6", "W11"), oracle="""
SELECT file, start_line, record_id, CAST(unnest([0, 1]) AS BIGINT) AS part,
       unnest([split_part(text, chr(10), 1) || chr(10) || split_part(text, chr(10), 2), split_part(text, chr(10), 3)]) AS text
FROM segments""")
def s6_record_parts(spark, sf):
    return tx.segment_records(_listing(spark, sf), part_lines=2)


@register("p12_request_state", "P12", oracle="""
SELECT file, count(*) AS requests, bool_or(split_part(text, '  ', 2) = 'Pending') AS blocks_clean_start,
       count(*) FILTER (WHERE regexp_matches(text, '(?i)approved|granted')) AS approved
FROM segments GROUP BY file""")
def p12_request_state(spark, sf):
    return rc.request_state(tx.whole_records(tx.segment_records(_listing(spark, sf))))


_T0, _T1 = "2024-01-10 00:00:00", "2024-01-12 00:00:00"


@register("x1_new_requests", "X1", oracle=f"""
SELECT request_id FROM access_requests WHERE submitted_at < TIMESTAMP '{_T1}'
EXCEPT ALL SELECT request_id FROM access_requests WHERE submitted_at < TIMESTAMP '{_T0}'""")
def x1_new_requests(spark, sf):
    from shopguard.operators.audit import new_ids

    req = src.access_requests(src.policy_requests(spark, sf))
    at = lambda t: req.where(F.col("submitted_at") < F.lit(t).cast("timestamp_ntz"))
    return new_ids(at(_T1), at(_T0))


VIEWS["jobs"] = f"""
SELECT 'job-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS job_id, 'session-' || (doc_id % 4) AS session,
       TIMESTAMP '{dv.JOB_EPOCH}' + to_seconds(doc_id * 97) AS submitted_at, doc_id % 5 = 4 AS timed_out,
       CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END AS exit_code, text AS stdout,
       CASE WHEN doc_id % 5 = 4 THEN 'agent exceeded 900s and was killed' ELSE 'lang=' || lang || ' source=' || source END
           AS stderr,
       n_chars / 73.0 AS duration_raw
FROM documents"""
VIEWS["job_states"] = """
SELECT job_id, session, submitted_at,
       CASE WHEN timed_out THEN 'timeout' WHEN exit_code = 0 THEN 'finished' ELSE 'failed' END AS state,
       CASE WHEN timed_out THEN NULL ELSE exit_code END AS exit_code,
       CASE WHEN timed_out THEN '' WHEN length(stdout) > 20000 THEN right(stdout, 20000) ELSE stdout END AS stdout,
       CASE WHEN length(stderr) > 8000 THEN right(stderr, 8000) ELSE stderr END AS stderr,
       CAST(printf('%.1f', duration_raw) AS DOUBLE) AS duration_seconds
FROM jobs"""


@register("t8_job_states", "T8", oracle="""
SELECT job_id, session, state, exit_code, CAST(length(stdout) AS INTEGER) AS stdout_chars, md5(stdout) AS stdout_md5,
       stderr, duration_seconds FROM job_states""")
def t8_job_states(spark, sf):
    j = rc.job_states(dv.jobs(spark, sf))
    return j.select("job_id", "session", "state", "exit_code", F.length("stdout").alias("stdout_chars"),
                    F.md5("stdout").alias("stdout_md5"), "stderr", "duration_seconds")


@register("w8_recent_jobs", "W8", oracle="""
SELECT job_id, state, submitted_at FROM job_states ORDER BY submitted_at DESC, job_id DESC LIMIT 20""")
def w8_recent_jobs(spark, sf):
    j = rc.job_states(dv.jobs(spark, sf))
    return rc.recent(j, 50, 20, "submitted_at", "job_id").select("job_id", "state", "submitted_at")


VIEWS["incident_docs"] = """
SELECT event_id, '{"' || CASE WHEN event_id % 2 = 0 THEN 'incidentID' ELSE 'id' END || '":"INC-' || event_id
       || '","title":"5xx on orders","severity":"'
       || CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'minor' WHEN 2 THEN 'major' ELSE 'critical' END
       || '","status":"' || CASE WHEN k % 3 = 0 THEN 'resolved' ELSE 'active' END
       || '","isDrill":false,"createdAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS doc
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error')"""


@register("p13_open_incidents", "P13", oracle="""
SELECT coalesce(json_extract_string(doc, '$.incidentID'), json_extract_string(doc, '$.id')) AS incident_id,
       json_extract_string(doc, '$.title') AS title, json_extract_string(doc, '$.severity') AS severity,
       json_extract_string(doc, '$.status') AS status,
       CAST(strptime(json_extract_string(doc, '$.createdAt'), '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AS created_at
FROM incident_docs WHERE json_extract_string(doc, '$.status') = 'active'
ORDER BY created_at DESC, incident_id DESC LIMIT 25""")
def p13_open_incidents(spark, sf):
    return rc.open_incidents(dv.incident_docs(spark, sf))


@register("p13_no_stale_incident", "P13", oracle="""
SELECT count(*) AS open_incidents, count(*) = 0 AS clean
FROM incident_docs WHERE json_extract_string(doc, '$.status') = 'active'""")
def p13_no_stale_incident(spark, sf):
    v = F.try_parse_json(F.col("doc"))
    active = dv.incident_docs(spark, sf).where(F.try_variant_get(v, "$.status", "string") == "active")
    return active.agg(F.count(F.lit(1)).alias("open_incidents")).withColumn("clean", F.col("open_incidents") == 0)


_NAMES = [RULE, "orders-api-latency", "disk-full"]


@register("p14_rule_state", "P14", oracle=f"""
SELECT CAST(epoch(eval_ts) AS BIGINT) AS doc_id, n.name,
       CASE n.name WHEN '{RULE}' THEN state WHEN 'orders-api-latency' THEN 'inactive' ELSE '' END AS state,
       n.name <> 'disk-full' AS "exists"
FROM alert_states, (VALUES ('{RULE}'), ('orders-api-latency'), ('disk-full')) n(name)""")
def p14_rule_state(spark, sf):
    return rc.rule_state(dv.rule_group_docs(_states(spark, sf), RULE), _NAMES)


_EXPECTED_SQL = "(VALUES " + ", ".join(f"('{r}', '{o}', '{c}', '{p}')" for r, o, c, p in rc.EXPECTED_GRANTS) + \
    ') e(role, object, "column", privilege)'


_USED_SQL = " UNION ALL ".join(
    f"SELECT 'shop_remediation' AS role, '{obj}' AS object, '{c}' AS \"column\", '{priv}' AS privilege FROM allowed "
    f"WHERE resource_id <> 'pg-prod-read' AND regexp_matches({text}, '{pat}')"
    for c in rc.GRANT_COLUMNS for text, pat, obj, priv in (
        ("regexp_extract(query_body, ' SET (.*?) FROM ', 1)", f"(^|, ){c} = ", "public.orders", "UPDATE"),
        ("query_body", f"\\bo\\.{c}\\b", "public.orders", "SELECT"),
        ("query_body", f"\\bb\\.{c}\\b", "public.poison_backup", "SELECT")))


@register("x4_grant_drift", "X4", oracle=f"""
WITH allowed AS (SELECT * FROM recorded WHERE decision = 'allow' AND has_sql),
actual AS (
  SELECT DISTINCT * FROM (
    SELECT 'shop_read' AS role, 'public.' || t AS object, '*' AS "column",
           CASE WHEN list_contains(write_tables, t) THEN 'UPDATE' ELSE 'SELECT' END AS privilege
    FROM (SELECT *, unnest(tables) AS t FROM allowed WHERE resource_id = 'pg-prod-read')
    UNION ALL {_USED_SQL})),
expected AS (SELECT * FROM {_EXPECTED_SQL})
SELECT *, 'missing' AS finding FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)
UNION ALL SELECT *, 'extra' FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)""")
def x4_grant_drift(spark, sf):
    """Column privileges the recorded statements used, against the grants that should be there."""
    rec = pol.decide(src.policy_requests(spark, sf), pol.policy_set(exclude=src.RECORDED_POLICY_EXCLUDES))
    allowed = rec.where((F.col("decision") == "allow") & F.col("has_sql"))
    whole = F.transform("tables", lambda t: F.struct(
        F.concat(F.lit("public."), t).alias("object"), F.lit("*").alias("column"),
        F.when(F.array_contains("write_tables", t), "UPDATE").otherwise("SELECT").alias("privilege")))
    read = F.col("resource_id") == pol.READ_RESOURCE
    used = F.when(read, whole).otherwise(rc.repair_privileges(F.col("query_body")))
    actual = allowed.select(F.when(read, "shop_read").otherwise("shop_remediation").alias("role"),
                            F.explode(used).alias("u")).select("role", "u.*")
    expected = spark.createDataFrame(list(rc.EXPECTED_GRANTS), "role string, object string, column string, privilege string")
    return rc.grant_drift(expected, actual)


VIEWS["role_catalog"] = f"""
SELECT '{dv.ROLE_PREFIX}' || user_id AS rolname, user_id % 3 AS account_class,
       user_id % 3 = 1 AND user_id % 7 = 0 AS rolsuper, user_id % 11 = 0 AS rolcreatedb,
       user_id % 3 = 1 AND user_id % 5 = 0 AS rolcreaterole, user_id % 3 = 2 AND user_id % 13 = 0 AS rolbypassrls,
       user_id % 17 <> 0 AS rolinherit
FROM (SELECT DISTINCT user_id FROM events)"""


@register("a12_role_boundary", "A12", oracle="""
SELECT CAST(account_class AS BIGINT) AS account_class, count(*) AS roles,
       count(*) FILTER (WHERE rolsuper OR rolcreatedb OR rolcreaterole OR rolbypassrls) AS administrative_roles,
       bool_and(NOT rolsuper AND NOT rolcreatedb AND NOT rolcreaterole AND NOT rolbypassrls) AS non_administrative
FROM role_catalog GROUP BY account_class""")
def a12_role_boundary(spark, sf):
    return qa.role_boundary_by(dv.role_catalog(spark, sf), ["account_class"])


_ALLOW_SQL = "(VALUES " + ", ".join([f"('grafana', '{t}')" for t in pol.GRAFANA_TOOLS]
                                    + [f"('github', '{t}')" for t in pol.GITHUB_TOOLS]) + ") a(server, tool)"
_REQ_SQL = "(VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in rc.REQUIRED_TOOLS) + ") r(server, tool)"


@register("x5_tool_drift", "X5", oracle=f"""
WITH exposed AS (SELECT DISTINCT CASE resource_id WHEN 'grafana-mcp' THEN 'grafana' ELSE 'github' END AS server,
                        substr(action, 6) AS tool FROM policy_requests WHERE action LIKE 'MCP::%'),
req AS (SELECT * FROM {_REQ_SQL}), allow AS (SELECT * FROM {_ALLOW_SQL})
SELECT server, tool, 'required_not_exposed' AS finding FROM req
  WHERE NOT EXISTS (SELECT 1 FROM exposed e WHERE e.server = req.server AND e.tool = req.tool)
UNION ALL SELECT server, tool, 'exposed_not_allowlisted' FROM exposed
  WHERE NOT EXISTS (SELECT 1 FROM allow a WHERE a.server = exposed.server AND a.tool = exposed.tool)
UNION ALL SELECT server, tool, 'allowlisted_not_exposed' FROM allow
  WHERE NOT EXISTS (SELECT 1 FROM exposed e WHERE e.server = allow.server AND e.tool = allow.tool)""")
def x5_tool_drift(spark, sf):
    req = src.policy_requests(spark, sf).where(F.col("action").startswith("MCP::"))
    exposed = req.select(F.when(F.col("resource_id") == pol.GRAFANA_MCP, "grafana").otherwise("github").alias("server"),
                         F.expr("substring(action, 6)").alias("tool"))
    required = spark.createDataFrame(list(rc.REQUIRED_TOOLS), "server string, tool string")
    return rc.tool_drift(exposed, required, rc.allowlist(spark))


# --------------------------------------------------------------------------- text sources / sinks
def _audit_ndjson(spark, sf) -> str:
    """Write the audit log as NDJSON; each MCP record is followed by a broken line (a writer that died)."""
    a = src.audit_log(spark, sf)
    line = F.to_json(F.struct(*[F.col(c) for c in a.columns]))
    broken = F.when(F.col("resource_type") == "mcp", F.substring(line, 1, 40))
    text = a.select(F.explode(F.array_compact(F.array(line, broken))).alias("value"))
    path = scratch_path(spark, "audit-ndjson")
    text.write.mode("overwrite").text(path)
    return path


@register("s3_audit_scan", "S3", oracle="""
SELECT count(*) + count(*) FILTER (WHERE resource_type = 'mcp') AS lines,
       count(*) FILTER (WHERE resource_type = 'mcp') AS malformed, count(*) AS records FROM audit_log""")
def s3_audit_scan(spark, sf):
    return tx.audit_scan_report(tx.load_audit(spark, _audit_ndjson(spark, sf)))


@register("s3_counted_load", "S3", oracle="""
SELECT id, account_id, "authorization", (SELECT count(*) + count(*) FILTER (WHERE resource_type = 'mcp') FROM audit_log) AS lines,
       (SELECT count(*) FROM audit_log WHERE resource_type = 'mcp') AS malformed FROM audit_log""")
def s3_counted_load(spark, sf):
    """The loaded records beside the counts of the pass that loaded them."""
    records, seen = tx.load_counted_audit(spark, _audit_ndjson(spark, sf))
    return records.select("id", "account_id", "authorization", *[F.lit(n).cast("long").alias(k) for k, n in seen.items()])


_Q9_COLS = ["id", "timestamp", "account_id", "account_email", "account_first_name", "account_last_name",
            "resource_id", "resource_name", "resource_type", "remote_identity_username", "query_body", "query_hash",
            "duration", "record_count", "authorization", "error", "source_ip", "client_ip", "user_agent",
            "egress_node_id", "encrypted", "capture"]


@register("q9_audit_null_rates", ("Q9", "S3"), oracle="\nUNION ALL ".join(
    f"""SELECT 'audit' AS tbl, '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE "{c}" IS NULL) AS nulls,
       round(count(*) FILTER (WHERE "{c}" IS NULL) / count(*), 6) AS null_rate,
       count(*) FILTER (WHERE "{c}" IS NULL) = count(*) AS all_null
FROM audit_log""" for c in _Q9_COLS))
def q9_audit_null_rates(spark, sf):
    a = tx.load_audit(spark, _audit_ndjson(spark, sf))
    return qa.null_rates(a.where(F.col(tx.CORRUPT).isNull()).drop(tx.CORRUPT), "audit")


@register("s4_flatten_audit", "S4", oracle="""
SELECT id, account_id, "authorization",
       CASE (CAST(substr(id, 3) AS BIGINT) // 8) % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'queries'
            WHEN 2 THEN 'activities' ELSE 'record' END AS shape
FROM audit_log""")
def s4_flatten_audit(spark, sf):
    flat = tx.flatten_audit(_audit_documents(spark, sf))
    return flat.select(tx.record_field("id").alias("id"), tx.record_field("account_id").alias("account_id"),
                       tx.record_field("authorization").alias("authorization"), "shape")


@register("s4_counted_flatten", "S4", oracle="""
WITH blocks AS (SELECT id, CAST(substr(id, 3) AS BIGINT) // 8 AS g FROM audit_log),
docs AS (SELECT count(DISTINCT g) FILTER (WHERE g % 4 <> 3) + count(*) FILTER (WHERE g % 4 = 3) AS n,
                count(DISTINCT g) FILTER (WHERE g % 4 <> 3 AND g % 10 = 0) + count(*) FILTER (WHERE g % 4 = 3 AND g % 10 = 0) AS broken
         FROM blocks)
SELECT id, n AS documents, broken AS unparsable FROM blocks, docs WHERE g % 10 <> 0""")
def s4_counted_flatten(spark, sf):
    """Records of audit documents a tenth of which were cut off, beside the counts of the pass that parsed them."""
    whole = _audit_documents(spark, sf)
    cut = F.when(F.col("g") % 10 == 0, F.expr("substring(doc, 1, length(doc) - 1)")).otherwise(F.col("doc"))
    flat, seen = tx.flatten_counted_audit(whole.select("g", cut.alias("doc")))
    return flat.select(tx.record_field("id").alias("id"), *[F.lit(n).cast("long").alias(k) for k, n in seen.items()])


def _audit_documents(spark, sf):
    a = src.audit_log(spark, sf)
    rec = F.to_json(F.struct(*[F.col(c) for c in a.columns]))
    g = F.floor(F.regexp_extract("id", r"^q-(\d+)$", 1).cast("long") / 8)
    staged = a.select(g.alias("g"), F.col("id"), rec.alias("rec"))
    bare = staged.where(F.col("g") % 4 == 3).select("g", F.col("rec").alias("doc"))
    # Each document holds the (at most 8) records of one id block.
    grouped = (staged.where(F.col("g") % 4 != 3).groupBy("g")
               .agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("rec")), ","), F.lit("]")).alias("arr")))
    docs = grouped.select("g", F.when(F.col("g") % 4 == 0, F.col("arr"))
                          .when(F.col("g") % 4 == 1, F.concat(F.lit('{"queries":'), "arr", F.lit("}")))
                          .otherwise(F.concat(F.lit('{"activities":'), "arr", F.lit("}"))).alias("doc"))
    return docs.unionByName(bare)


_D6_ANCHOR = "2024-01-30 00:00:00"


_RETENTION = (("audit", 30), ("results", 7))


@register("d6_retention", "D6", oracle="\nUNION ALL ".join(
    f"""SELECT '{p}' AS prefix, {d} AS days, count(*) FILTER (WHERE ts >= TIMESTAMP '{_D6_ANCHOR}' - INTERVAL {d} DAY) AS kept,
       count(*) FILTER (WHERE ts < TIMESTAMP '{_D6_ANCHOR}' - INTERVAL {d} DAY) AS dropped FROM audit_log"""
    for p, d in _RETENTION))
def d6_retention(spark, sf):
    """What each prefix's rule keeps and drops, counted in one pass."""
    return lc.retention_report(src.audit_with_time(src.audit_log(spark, sf)), "ts", _D6_ANCHOR, dict(_RETENTION))


@register("d6_kept_rows", "D6", oracle="\nUNION ALL ".join(
    f"SELECT '{p}' AS prefix, id, ts FROM audit_log WHERE ts >= TIMESTAMP '{_D6_ANCHOR}' - INTERVAL {d} DAY"
    for p, d in _RETENTION))
def d6_kept_rows(spark, sf):
    """The rows that stay under each prefix."""
    audit = src.audit_with_time(src.audit_log(spark, sf)).select("id", "ts")
    return lc.retained(audit, "ts", _D6_ANCHOR, dict(_RETENTION)).select("prefix", "id", "ts")


@register("d6_expired_version", "D6", oracle="\nUNION ALL ".join(
    f"""SELECT '{p}' AS prefix, id, ts FROM audit_log WHERE ts >= TIMESTAMP '{_D6_ANCHOR}' - INTERVAL {d} DAY"""
    for p, d in _RETENTION))
def d6_expired_version(spark, sf):
    """Retention over files laid out by prefix and day: whole days leave, only the day of the cut-off is rewritten."""
    audit = src.audit_with_time(src.audit_log(spark, sf)).select("id", "ts")
    data = vs.Dataset(spark, scratch_path(spark, "versions"))
    prefixes = F.array(*[F.lit(p) for p, _ in _RETENTION])
    laid = audit.withColumn("prefix", F.explode(prefixes)).withColumn("day", F.col("ts").cast("date"))
    data.replace({"audit": laid.repartitionByRange("prefix", "day")}, {"audit": ["prefix", "day"]})
    vs.expire(data, "audit", {p: lc._cutoff(_D6_ANCHOR, d) for p, d in _RETENTION})
    return data.read("audit").select("prefix", "id", "ts")


@register("s2_csv_roundtrip", "S2", oracle="SELECT * FROM shop_orders")
def s2_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "orders-csv")
    tx.write_csv(b.shop_orders(spark, sf), path)
    return tx.load_csv(spark, path, ORDERS)


@register("s2_counted_load", "S2", oracle="SELECT *, count(*) OVER () AS loaded FROM shop_orders")
def s2_counted_load(spark, sf):
    """The loaded orders beside the number the load brought in."""
    path = scratch_path(spark, "orders-csv")
    tx.write_csv(b.shop_orders(spark, sf), path)
    rows, n = tx.load_counted_csv(spark, path, ORDERS)
    return rows.withColumn("loaded", F.lit(n).cast("long"))


@register("s7_json_array", "S7", oracle="""
SELECT CAST(to_json(list({'id': id, 'name': name, 'email': email, 'tier': tier} ORDER BY id)) AS VARCHAR) AS json
FROM (SELECT * FROM safe_customers ORDER BY id LIMIT 100)""")
def s7_json_array(spark, sf):
    safe = pv.cap_rows(pv.safe_customers(b.customers_raw(spark, sf)).select("id", "name", "email", "tier"), 100)
    return tx.to_json_array(safe)


@register("s7_json_array_pages", "S7", oracle="""
SELECT CAST(floor(id / 100) AS BIGINT) AS page,
       CAST(to_json(list({'id': id, 'name': name, 'email': email, 'tier': tier} ORDER BY id)) AS VARCHAR) AS json
FROM safe_customers GROUP BY 1""")
def s7_json_array_pages(spark, sf):
    """All customers, one array per block of 100 ids."""
    safe = pv.safe_customers(b.customers_raw(spark, sf)).select("id", "name", "email", "tier")
    return tx.to_json_array(safe.withColumn("page", F.floor(F.col("id") / 100).cast("long")), "page")


@register("s7_ndjson_roundtrip", "S7", oracle="SELECT id, name, email, tier FROM safe_customers")
def s7_ndjson_roundtrip(spark, sf):
    """All customers through the scale path, written and read back."""
    safe = pv.safe_customers(b.customers_raw(spark, sf)).select("id", "name", "email", "tier")
    path = scratch_path(spark, "customers-ndjson")
    tx.write_ndjson(safe, path)
    return spark.read.schema(safe.schema).json(path)


@register("s7_json_array_empty", "S7", oracle="""
SELECT coalesce(CAST(to_json(list({'id': id, 'tier': tier})) AS VARCHAR), '[]') AS json
FROM safe_customers WHERE tier = 'none'""")
def s7_json_array_empty(spark, sf):
    safe = pv.safe_customers(b.customers_raw(spark, sf)).where(F.col("tier") == "none").select("id", "tier")
    return tx.to_json_array(safe)


@register("s8_csv_export", "S8", oracle="""
SELECT 'id,name,email,phone,created_at,tier' AS header, count(*) AS data_lines FROM safe_customers""")
def s8_csv_export(spark, sf):
    path = scratch_path(spark, "customers-csv")
    tx.write_csv_with_header(pv.safe_customers(b.customers_raw(spark, sf)), path)
    lines = spark.read.text(path)
    is_header = F.col("value") == "id,name,email,phone,created_at,tier"
    return lines.agg(F.max(F.when(is_header, F.col("value"))).alias("header"),
                     F.count_if(~is_header).alias("data_lines"))


@register("s8_csv_fields", "S8", oracle="SELECT * FROM safe_customers")
def s8_csv_fields(spark, sf):
    """The fields of the export, read back under its header."""
    path = scratch_path(spark, "customers-csv")
    safe = pv.safe_customers(b.customers_raw(spark, sf))
    tx.write_csv_with_header(safe, path)
    return tx.read_csv_with_header(spark, path, safe.schema)


@register("d4_restored_version", ("D4", "S9"), oracle="""
SELECT 'customers' AS "table", (SELECT count(*) FROM customers_raw) AS rows, CAST(0 AS BIGINT) AS poisoned
UNION ALL SELECT 'orders', (SELECT count(*) FROM shop_orders), 0
UNION ALL SELECT 'payments', (SELECT count(*) FROM payments), 0
UNION ALL SELECT 'poison_backup', 0, 0""")
def d4_restored_version(spark, sf):
    """Poison the orders as version 2, then make version 1 of all tables current in one commit."""
    from shopguard.plans.shop import _poisoned_and_backup

    data = vs.Dataset(spark, scratch_path(spark, "versions"))
    orders = b.shop_orders(spark, sf)
    first = data.replace({"customers": b.customers_raw(spark, sf), "orders": orders,
                          "payments": b.payments_from_orders(orders)})
    poisoned, backup = _poisoned_and_backup(spark, sf)
    data.replace({"orders": poisoned, "poison_backup": backup})
    vs.restore_version(data, first)
    out = None
    for name in ("customers", "orders", "payments", "poison_backup"):
        df = data.read(name)
        bad = F.count_if(F.col("status") == lc.POISON_STATUS) if "status" in df.columns else F.lit(0).cast("long")
        row = df.agg(F.count(F.lit(1)).alias("rows"), bad.alias("poisoned")).select(F.lit(name).alias("table"), "rows", "poisoned")
        out = row if out is None else out.unionByName(row)
    return out


@register("j1_copy_on_write", ("J1", "D3", "D4"), oracle="SELECT * FROM remediated")
def j1_copy_on_write(spark, sf):
    """The repair as a new version of the orders: only files that hold victims are rewritten."""
    from shopguard.plans.shop import _poisoned_and_backup

    data = vs.Dataset(spark, scratch_path(spark, "versions"))
    poisoned, backup = _poisoned_and_backup(spark, sf)
    data.replace({"orders": poisoned.repartitionByRange("id"), "poison_backup": backup})
    vs.repair_version(data, lc.RECONCILE_BATCH)
    return data.read("orders")


@register("s9_snapshot_restore", ("S9", "D4", "X2", "X3", "A4"), oracle="""
SELECT (SELECT count(*) FROM customers_raw) AS customers, (SELECT count(*) FROM shop_orders) AS orders,
       (SELECT count(*) FROM payments) AS payments, CAST(0 AS INTEGER) AS poisoned_rows_remaining,
       CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra""")
def s9_snapshot_restore(spark, sf):
    from shopguard.operators.common import one_row

    orders = b.shop_orders(spark, sf)
    snap = scratch_path(spark, "pristine")
    lc.write_snapshot({"customers": b.customers_raw(spark, sf), "orders": orders,
                       "payments": b.payments_from_orders(orders)}, snap)
    restored = lc.restore(spark, snap, target_dir=scratch_path(spark, "restored"))
    summary = lc.restore_summary(restored["customers"], restored["orders"], restored["payments"])
    diff = lc.multiset_diff(restored["orders"], spark.read.parquet(f"{snap}/orders")).select("missing", "extra")
    return one_row(summary, diff).select("customers", "orders", "payments",
                                         F.col("poisoned_rows_remaining").cast("int"), "missing", "extra")


@register("d5_pii_split", "D5", oracle="SELECT * FROM safe_customers")
def d5_pii_split(spark, sf):
    base = scratch_path(spark, "zones")
    raw = f"{base}/public/customers_raw"
    b.customers_raw(spark, sf).write.mode("overwrite").parquet(raw)
    first = pv.pii_split(spark, raw, f"{base}/private/customer_pii")
    # A second run is a no-op (idempotent): the private copy already exists.
    return pv.pii_split(spark, raw, f"{base}/private/customer_pii").unionByName(first.limit(0))

