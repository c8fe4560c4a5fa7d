"""Registered queries: policy decisions, entitlements, grant windows and audit forensics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopguard.operators import audit as au
from shopguard.operators import policy as pol
from shopguard.operators import privacy as pv
from shopguard.plans.catalog import register
from shopguard.plans.sql import VIEWS
from shopguard.sources import audit as src
from shopguard.sources import bindings as b
from shopguard.sources import derived as dv

_CANON = src.CANONICAL_UPDATE.replace("'", "''")
_ACC = "CASE user_id % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"


def _acc(i: int) -> str:
    vals = [src.ACCOUNTS[k][i] for k in (0, 1, 2)]
    if isinstance(vals[0], list):
        lits = ["CAST([" + ", ".join(f"'{x}'" for x in v) + "] AS VARCHAR[])" for v in vals]
    else:
        lits = [f"'{v}'" for v in vals]
    return _ACC.format(*lits)


VIEWS["policy_requests"] = f"""
SELECT event_id, ts, user_id, event_type, value, k,
       {_acc(0)} AS principal_id, {_acc(1)} AS account_type, {_acc(2)} AS roles,
       CASE WHEN event_type IN ('view', 'click') THEN 'SQL::select'
            WHEN event_type IN ('purchase', 'error') THEN 'SQL::update' ELSE 'MCP::merge_pull_request' END AS action,
       CASE WHEN event_type = 'signup' THEN 'github-mcp'
            WHEN event_type IN ('purchase', 'error') AND k % 2 = 0 THEN 'pg-prod-remediation'
            ELSE 'pg-prod-read' END AS resource_id,
       CASE WHEN event_type = 'signup' THEN NULL ELSE 'prod' END AS env_tag,
       event_type <> 'signup' AS has_sql,
       CASE WHEN event_type = 'view' THEN ['orders'] WHEN event_type = 'click' THEN ['customers']
            WHEN event_type = 'purchase' AND k % 2 = 0 THEN ['orders', 'poison_backup']
            WHEN event_type = 'purchase' THEN ['orders'] WHEN event_type = 'error' THEN ['payments'] END AS tables,
       CASE WHEN event_type = 'purchase' THEN ['orders'] WHEN event_type = 'error' THEN ['payments']
            WHEN event_type IN ('view', 'click') THEN CAST([] AS VARCHAR[]) END AS write_tables,
       CASE WHEN event_type = 'purchase' THEN ['public.orders'] WHEN event_type = 'error' THEN ['public.payments']
            WHEN event_type IN ('view', 'click') THEN CAST([] AS VARCHAR[]) END AS qualified_write_tables,
       CASE WHEN event_type = 'view' THEN 'SELECT * FROM public.orders WHERE id = ' || k
            WHEN event_type = 'click' THEN 'SELECT id, name, email FROM public.customers WHERE id = ' || k
            WHEN event_type = 'purchase' AND k % 2 = 0 THEN '{_CANON};'
            WHEN event_type = 'purchase' THEN 'UPDATE public.orders SET status = ''SHIPPED''' || chr(10) || 'WHERE id = ' || k || ';'
            WHEN event_type = 'error' THEN 'UPDATE public.payments SET amount_cents = 0 WHERE id = ' || k
            ELSE 'merge_pull_request {{"pull_number":' || k || '}}' END AS query_body,
       {_acc(3)} AS account_email, {_acc(4)} AS account_first_name, {_acc(5)} AS account_last_name
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""

_AGENT = "principal_id = 'acct-agent'"
_REM_WRITE = (f"({_AGENT} AND action = 'SQL::update' AND resource_id = 'pg-prod-remediation' AND has_sql "
              "AND qualified_write_tables IS NOT NULL "
              "AND list_sort(list_distinct(qualified_write_tables)) = ['public.orders'])")
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_CUST = "(has_sql AND tables IS NOT NULL AND list_contains(tables, 'customers'))"
_SQL_POLICIES = [  # (pid, effect, condition, error)
    ("baseline.connect", "permit", "list_contains(roles, 'ai-agents') AND action = 'StrongDM::connect' AND "
     f"resource_id IN {_IN([pol.READ_RESOURCE, pol.REMEDIATION_RESOURCE, pol.GRAFANA_MCP, pol.GITHUB_MCP])}", None),
    ("baseline.read", "permit", f"list_contains(roles, 'ai-agents') AND action IN {_IN(pol.READ_ACTIONS)} "
     "AND resource_id = 'pg-prod-read' AND has_sql AND tables IS NOT NULL AND NOT list_contains(tables, 'customers')", None),
    ("baseline.request_access", "permit", f"{_AGENT} AND action = 'StrongDM::Resource::requestAccess' "
     "AND resource_id = 'pg-prod-remediation'", None),
    ("baseline.access_requests", "permit", f"{_AGENT} AND action IN "
     "('StrongDM::AccessRequest::create', 'StrongDM::AccessRequest::list')", None),
    ("baseline.oncall", "permit", "list_contains(roles, 'sre-oncall')", None),
    ("readonly.prod_write", "forbid", "account_type = 'service' AND has_sql AND write_tables IS NOT NULL "
     f"AND len(write_tables) > 0 AND env_tag = 'prod' AND NOT coalesce({_REM_WRITE}, false)", pol.WRITE_FORBID_ERROR),
    ("pii.email", "permit", f"list_contains(roles, 'ai-agents') AND action IN {_IN(pol.PII_READ_ACTIONS)} "
     f"AND resource_id = 'pg-prod-read' AND {_CUST}", None),
    ("pii.phone", "permit", f"list_contains(roles, 'ai-agents') AND action IN {_IN(pol.PII_READ_ACTIONS)} "
     f"AND resource_id = 'pg-prod-read' AND {_CUST}", None),
    ("remediation.write", "permit", _REM_WRITE, None),
    ("mcp.grafana_allow", "permit", f"{_AGENT} AND resource_id = 'grafana-mcp' AND action IN "
     f"{_IN(['MCP::' + t for t in pol.GRAFANA_TOOLS])}", None),
    ("mcp.github_allow", "permit", f"{_AGENT} AND resource_id = 'github-mcp' AND action IN "
     f"{_IN(['MCP::' + t for t in pol.GITHUB_TOOLS])}", None),
    ("mcp.no_create_incident", "forbid", f"{_AGENT} AND action = 'MCP::create_incident' "
     "AND resource_id = 'grafana-mcp'", pol.INCIDENT_FORBID_ERROR),
    ("mcp.no_merge", "forbid", f"{_AGENT} AND action IN {_IN(['MCP::' + t for t in pol.GITHUB_FORBIDDEN])} "
     "AND resource_id = 'github-mcp'", pol.MERGE_FORBID_ERROR),
]
assert [p[0] for p in _SQL_POLICIES] == [p.pid for p in pol.POLICIES]


def decision_sql(exclude=()) -> str:
    """SELECT list computing the C10 decision columns in DuckDB."""
    ps = [p for p in _SQL_POLICIES if p[0] not in exclude]
    hit = lambda c: f"coalesce({c}, false)"
    permits = "list_filter([" + ", ".join(f"CASE WHEN {hit(c)} THEN '{i}' END" for i, e, c, _ in ps
                                          if e == "permit") + "], lambda x: x IS NOT NULL)"
    forbids = "list_filter([" + ", ".join(f"CASE WHEN {hit(c)} THEN '{i}' END" for i, e, c, _ in ps
                                          if e == "forbid") + "], lambda x: x IS NOT NULL)"
    err = "coalesce(" + ", ".join(f"CASE WHEN {hit(c)} THEN '{m.replace(chr(39), chr(39) * 2)}' END"
                                  for i, e, c, m in ps if e == "forbid" and m) + f", '{pol.DEFAULT_DENY_ERROR}')"
    red = ("list_sort(list_distinct(flatten([" + ", ".join(
        f"CASE WHEN {hit(c)} THEN ['{i.split('.')[1]}'] ELSE CAST([] AS VARCHAR[]) END"
        for i, e, c, _ in ps if i.startswith("pii.")) + "])))") if any(
        i.startswith("pii.") for i, *_ in ps) else "CAST([] AS VARCHAR[])"
    cap = ("CASE WHEN " + hit(dict((p[0], p[2]) for p in ps)["pii.email"]) + " THEN 100 END") \
        if any(p[0] == "pii.email" for p in ps) else "CAST(NULL AS INTEGER)"
    allow = f"(len({permits}) > 0 AND len({forbids}) = 0)"
    return (f"CASE WHEN {allow} THEN 'allow' ELSE 'deny' END AS decision, {permits} AS permits, "
            f"{forbids} AS forbids, CASE WHEN {allow} THEN NULL ELSE {err} END AS error, "
            f"CASE WHEN {allow} THEN {red} ELSE CAST([] AS VARCHAR[]) END AS redactions, "
            f"CASE WHEN {allow} THEN {cap} END AS max_rows")


def _sql_list(xs) -> str:
    return "CAST(NULL AS VARCHAR[])" if xs is None else "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"


VIEWS["request_mix"] = f"""
SELECT event_id, ts, {_acc(0)} AS principal_id, {_acc(1)} AS account_type, {_acc(2)} AS roles, q.action, q.resource_id,
       q.env_tag, q.tables IS NOT NULL AS has_sql, q.tables, q.write_tables,
       list_transform(q.write_tables, lambda x: 'public.' || x) AS qualified_write_tables
FROM events JOIN (VALUES {", ".join(f"({i}, '{a}', '{r}', {repr(e) if e else 'CAST(NULL AS VARCHAR)'}, {_sql_list(t)}, {_sql_list(w)})"
                                    for i, (a, r, e, t, w) in enumerate(src.REQUEST_KINDS))})
     q(i, action, resource_id, env_tag, tables, write_tables) ON event_id % {len(src.REQUEST_KINDS)} = q.i"""
VIEWS["mix_decided"] = f"SELECT *, {decision_sql()} FROM request_mix"
VIEWS["decided"] = f"SELECT *, {decision_sql()} FROM policy_requests"
VIEWS["recorded"] = f"SELECT *, {decision_sql(src.RECORDED_POLICY_EXCLUDES)} FROM policy_requests"
VIEWS["audit_log"] = """
SELECT 'q-' || event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp",
       principal_id AS account_id, account_email, account_first_name, account_last_name, resource_id,
       resource_id AS resource_name, CASE WHEN resource_id <> 'github-mcp' THEN 'postgres' ELSE 'mcp' END AS resource_type,
       CASE resource_id WHEN 'pg-prod-read' THEN 'shop_read' WHEN 'pg-prod-remediation' THEN 'shop_remediation' END
           AS remote_identity_username,
       query_body, md5(query_body) AS query_hash, CAST(CAST(floor(value * 3) AS BIGINT) AS VARCHAR) AS duration,
       CAST(CASE WHEN decision <> 'allow' THEN 0 WHEN action = 'SQL::select' THEN CAST(floor(value * 10) AS BIGINT)
                 ELSE 1 END AS VARCHAR) AS record_count,
       CASE WHEN decision = 'allow' THEN 'allowed' ELSE 'denied' END AS "authorization", error,
       '10.0.1.' || (user_id % 250) AS source_ip, '127.0.0.1' AS client_ip,
       CASE WHEN resource_id <> 'github-mcp' THEN 'psql' ELSE 'mcp-client' END AS user_agent,
       'relay-1' AS egress_node_id, true AS encrypted, CAST(NULL AS VARCHAR) AS capture,
       ts
FROM recorded"""

_JOIN = "array_to_string({0}, ',')"


def _decisions(df, prefix=""):
    return df.select("event_id", "principal_id", "action", "resource_id", f"{prefix}decision",
                     F.array_join(f"{prefix}permits", ",").alias("permits"),
                     F.array_join(f"{prefix}forbids", ",").alias("forbids"), f"{prefix}error",
                     F.array_join(f"{prefix}redactions", ",").alias("redactions"),
                     F.col(f"{prefix}max_rows").cast("int").alias("max_rows"))


@register("c10_decide", ("C1", "C2", "C3", "C4", "C5", "C6", "C7", "C8", "C9", "C10", "J9", "R7"),
          bench=True, oracle="""
SELECT event_id, principal_id, action, resource_id, decision, array_to_string(permits, ',') AS permits,
       array_to_string(forbids, ',') AS forbids, error, array_to_string(redactions, ',') AS redactions,
       CAST(max_rows AS INTEGER) AS max_rows
FROM decided""")
def c10_decide(spark, sf):
    return _decisions(pol.decide(src.policy_requests(spark, sf)))


@register("c_policy_hits", ("C1", "C2", "C3", "C4", "C5", "C6", "C7", "C8", "C9"), oracle="""
SELECT pid, effect, count(*) AS matched FROM (
  SELECT unnest(permits) AS pid, 'permit' AS effect FROM mix_decided
  UNION ALL SELECT unnest(forbids), 'forbid' FROM mix_decided) GROUP BY ALL""")
def c_policy_hits(spark, sf):
    d = pol.decide(src.request_mix(spark, sf))
    named = lambda c, effect: F.transform(c, lambda p: F.struct(p.alias("pid"), F.lit(effect).alias("effect")))
    hits = d.select(F.explode(F.concat(named("permits", "permit"), named("forbids", "forbid"))).alias("h"))
    return hits.groupBy("h.pid", "h.effect").agg(F.count(F.lit(1)).alias("matched"))


@register("c10_decide_mix", ("C1", "C2", "C3", "C4", "C5", "C6", "C7", "C8", "C9", "C10"), oracle="""
SELECT event_id, principal_id, action, resource_id, decision, array_to_string(permits, ',') AS permits,
       array_to_string(forbids, ',') AS forbids, error, array_to_string(redactions, ',') AS redactions,
       CAST(max_rows AS INTEGER) AS max_rows
FROM mix_decided""")
def c10_decide_mix(spark, sf):
    return _decisions(pol.decide(src.request_mix(spark, sf)))


@register("c10_decision_summary", "C10", oracle="""
SELECT principal_id, action, resource_id, decision, count(*) AS requests FROM decided GROUP BY ALL""")
def c10_decision_summary(spark, sf):
    d = pol.decide(src.policy_requests(spark, sf))
    return d.groupBy("principal_id", "action", "resource_id", "decision").agg(
        F.count(F.lit(1)).alias("requests"))


@register("c11_obligations_applied", ("C11", "P3", "P4"), oracle="""
SELECT event_id, id, name, CASE WHEN list_contains(redactions, 'email') THEN '[REDACTED]' ELSE email END AS email,
       CASE WHEN list_contains(redactions, 'phone') THEN '[REDACTED]' ELSE phone END AS phone, tier
FROM (SELECT d.event_id, d.redactions, d.max_rows, c.*,
             row_number() OVER (PARTITION BY d.event_id ORDER BY c.id) AS n
      FROM decided d JOIN customers_raw c ON c.id = d.k
      WHERE d.decision = 'allow' AND list_contains(d.tables, 'customers'))
WHERE max_rows IS NULL OR n <= max_rows""")
def c11_obligations_applied(spark, sf):
    """Every allowed customer read, with the obligations of its own decision on the rows it returns."""
    reads = (pol.decide(src.policy_requests(spark, sf))
             .where((F.col("decision") == "allow") & F.array_contains("tables", "customers"))
             .select("event_id", "redactions", "max_rows", F.col("k").cast("long").alias("id")))
    rows = reads.join(b.customers_raw(spark, sf).select("id", "name", "email", "phone", "tier"), "id")
    return pol.apply_obligations_by_row(rows, ["email", "phone"], "event_id", "id") \
        .select("event_id", "id", "name", "email", "phone", "tier")


@register("c12_policy_audit", ("C12", "T6"), oracle="""
SELECT r.event_id,
       CASE WHEN r.error IS NULL THEN 'ok'
            WHEN regexp_matches(r.error, '(?i)not permitted|not allowed|denied|forbid|policy|unauthori[sz]ed|autonomous agents cannot write')
            THEN 'denied' ELSE 'error' END AS recorded_outcome,
       d.decision AS current_decision
FROM recorded r JOIN decided d ON r.event_id = d.event_id
WHERE (CASE WHEN r.error IS NULL THEN 'allow' ELSE 'deny' END) <> d.decision""")
def c12_policy_audit(spark, sf):
    audit = src.audit_log(spark, sf).select(
        F.regexp_extract("id", r"^q-(\d+)$", 1).cast("long").alias("event_id"),
        au.outcome(F.col("error")).alias("recorded_outcome"))
    current = pol.decide(src.policy_requests(spark, sf)).select("event_id",
                                                                 F.col("decision").alias("current_decision"))
    recorded_allow = F.when(F.col("recorded_outcome") == "ok", "allow").otherwise("deny")
    return audit.join(current, "event_id").where(recorded_allow != F.col("current_decision"))


@register("c14_policy_change_impact", "C14", oracle=f"""
SELECT event_id, before_decision, after_decision FROM (
  SELECT p.event_id,
         d.decision AS before_decision, a.decision AS after_decision
  FROM policy_requests p JOIN decided d USING (event_id)
  JOIN (SELECT event_id, {decision_sql(('remediation.write', 'readonly.prod_write'))} FROM policy_requests) a
    USING (event_id))
WHERE before_decision <> after_decision""")
def c14_policy_change_impact(spark, sf):
    after = pol.policy_set(exclude=("remediation.write", "readonly.prod_write"))
    flips = pol.policy_change_impact(src.policy_requests(spark, sf), pol.POLICIES, after)
    return flips.select("event_id", "before_decision", "after_decision")


@register("j10_entitlements", "J10", oracle="""
WITH members AS (SELECT DISTINCT principal_id, unnest(roles) AS role FROM policy_requests),
granted AS (
  SELECT 'ai-agents' AS role, 'pg-prod-read' AS resource_id UNION ALL SELECT 'ai-agents', 'grafana-mcp'
  UNION ALL SELECT 'ai-agents', 'github-mcp'
  UNION ALL SELECT 'sre-oncall', r FROM (VALUES ('agent-vm'), ('pg-prod-read'), ('pg-prod-remediation'),
                                               ('pg-prod-admin'), ('app-01'), ('app-02')) v(r))
SELECT principal_id, resource_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS via_roles
FROM members JOIN granted USING (role) GROUP BY ALL""")
def j10_entitlements(spark, sf):
    members = (src.policy_requests(spark, sf).select("principal_id", F.explode("roles").alias("role"))
               .distinct())
    ent = pol.entitlements(members, pol.role_rules_frame(spark), pol.resources_frame(spark))
    return ent.withColumn("via_roles", F.array_join("via_roles", ","))


VIEWS["access_requests"] = """
SELECT 'aq-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS request_id, event_id, ts - INTERVAL 2 MINUTE AS submitted_at,
       principal_id AS account, 'pg-prod-remediation' AS resource,
       CASE k % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Denied' ELSE 'Approved' END AS status,
       CASE WHEN k % 7 = 0 THEN '30m' ELSE '15m' END AS duration,
       'INC-' || (event_id % 50 + 100) AS incident_id,
       'Incident INC-' || (event_id % 50 + 100) || ': '
         || CASE WHEN k % 3 <> 0 THEN 'run UPDATE public.orders from public.poison_backup for ' ELSE 'repair ' END
         || CASE WHEN k % 4 <> 1 THEN '400' ELSE 'the' END
         || ' malformed rows; rollback restores poison_backup values.' AS reason
FROM policy_requests
WHERE event_type = 'purchase' AND principal_id = 'acct-agent' AND resource_id = 'pg-prod-remediation'"""
VIEWS["grants"] = """
SELECT account AS principal_id, resource AS resource_id, submitted_at + INTERVAL 1 MINUTE AS granted_at
FROM access_requests WHERE status = 'Approved'"""


@register("j11_grant_window", "J11", oracle="""
WITH st AS (SELECT event_id, principal_id, resource_id, ts FROM policy_requests
            WHERE resource_id = 'pg-prod-remediation' AND principal_id = 'acct-agent')
SELECT st.event_id, st.ts, bool_or(coalesce(g.granted_at <= st.ts AND st.ts < g.granted_at + INTERVAL 15 MINUTE, false))
           AS covered,
       min(CASE WHEN g.granted_at <= st.ts AND st.ts < g.granted_at + INTERVAL 15 MINUTE THEN g.granted_at END)
           AS grant_at
FROM st LEFT JOIN grants g ON st.principal_id = g.principal_id AND st.resource_id = g.resource_id
GROUP BY st.event_id, st.ts""")
def j11_grant_window(spark, sf):
    reqs = src.policy_requests(spark, sf)
    st = reqs.where((F.col("resource_id") == pol.REMEDIATION_RESOURCE) & (F.col("principal_id") == pol.AGENT)) \
        .select("event_id", "principal_id", "resource_id", "ts")
    grants = src.access_requests(reqs).where(F.col("status") == "Approved").select(
        F.col("account").alias("principal_id"), F.col("resource").alias("resource_id"),
        (F.col("submitted_at") + F.make_dt_interval(mins=F.lit(1))).alias("granted_at"))
    return pol.covered_by_grant(st, grants).select("event_id", "ts", "covered", "grant_at")


VIEWS["entitled"] = """
SELECT DISTINCT principal_id, resource_id
FROM (SELECT DISTINCT principal_id, unnest(roles) AS role FROM policy_requests)
JOIN (SELECT 'ai-agents' AS role, 'pg-prod-read' AS resource_id UNION ALL SELECT 'ai-agents', 'grafana-mcp'
      UNION ALL SELECT 'ai-agents', 'github-mcp'
      UNION ALL SELECT 'sre-oncall', r FROM (VALUES ('agent-vm'), ('pg-prod-read'), ('pg-prod-remediation'),
                                                   ('pg-prod-admin'), ('app-01'), ('app-02')) v(r)) USING (role)"""


@register("c10_effective_access", ("C10", "J10", "J11"), oracle="""
WITH f AS (SELECT event_id, principal_id, resource_id, decision,
       EXISTS (SELECT 1 FROM entitled e WHERE e.principal_id = d.principal_id AND e.resource_id = d.resource_id) AS entitled,
       EXISTS (SELECT 1 FROM grants g WHERE g.principal_id = d.principal_id AND g.resource_id = d.resource_id
               AND g.granted_at <= d.ts AND d.ts < g.granted_at + INTERVAL 15 MINUTE) AS granted FROM decided d)
SELECT *, decision = 'allow' AND (entitled OR granted) AS effective FROM f""")
def c10_effective_access(spark, sf):
    """A request goes through if the policies allow it and a role or a current grant opens the resource."""
    reqs = src.policy_requests(spark, sf)
    members = reqs.select("principal_id", F.explode("roles").alias("role")).distinct()
    open_to = pol.entitlements(members, pol.role_rules_frame(spark), pol.resources_frame(spark)) \
        .select("principal_id", "resource_id", F.lit(True).alias("entitled"))
    grants = src.access_requests(reqs).where(F.col("status") == "Approved").select(
        F.col("account").alias("principal_id"), F.col("resource").alias("resource_id"),
        (F.col("submitted_at") + F.make_dt_interval(mins=F.lit(1))).alias("granted_at"))
    asked = pol.decide(reqs).select("event_id", "principal_id", "resource_id", "ts", "decision")
    facts = (pol.covered_by_grant(asked, grants).join(open_to, ["principal_id", "resource_id"], "left")
             .withColumn("entitled", F.coalesce("entitled", F.lit(False))))
    return facts.select("event_id", "principal_id", "resource_id", "decision", "entitled", F.col("covered").alias("granted"),
                        ((F.col("decision") == "allow") & (F.col("entitled") | F.col("covered"))).alias("effective"))


# ---------------------------------------------------------------------------
# Audit forensics
# ---------------------------------------------------------------------------
# Some statements get a second one behind a carriage return or a next-line character, which end no line here.
_TAILS = {1: "'; ' || chr(13) || 'DROP TABLE x'", 2: "';' || chr(133) || 'SELECT 2'", 3: "' ; ' || chr(13) || chr(10) || 'SELECT 3;'"}
_T5 = f"""
SELECT id, regexp_replace(query_body || CASE CAST(substr(id, 3) AS BIGINT) % 10 {" ".join(
    f"WHEN {k} THEN {v}" for k, v in _TAILS.items())} ELSE '' END, '(?m);[ \\t\\r\\f\\x0B]*$', '', 'g') AS stripped
FROM audit_log"""


@register("t5_classify_statements", "T5", bench=True, oracle=f"""
WITH s AS ({_T5}),
n AS (SELECT id, stripped,
             regexp_replace(regexp_replace(regexp_replace(translate(stripped, chr(10) || chr(9), '  '), ' +', ' ', 'g'),
                            '^ ', ''), ' $', '') AS normalized FROM s)
SELECT id, contains(stripped, ';') AS multi_statement, normalized,
       lower(regexp_extract(normalized, '^([A-Za-z]+)', 1)) AS verb,
       regexp_matches(stripped, '(?im)^[ \\t\\r\\f\\x0B]*(select|with|values|table|show)[ \\t\\r\\f\\x0B(]') AS is_read,
       normalized = '{_CANON}' AS is_canonical_repair
FROM n""")
def t5_classify_statements(spark, sf):
    log = src.audit_log(spark, sf)
    kind = F.regexp_extract("id", r"^q-(\d+)$", 1).cast("long") % 10
    tail = F.when(kind == 1, "; \rDROP TABLE x").when(kind == 2, ";\u0085SELECT 2").when(kind == 3, " ; \r\nSELECT 3;").otherwise("")
    c = au.classify_statements(log.withColumn("query_body", F.concat("query_body", tail)), src.CANONICAL_UPDATE)
    return c.select("id", "multi_statement", "normalized", "verb", "is_read", "is_canonical_repair")


_OUTCOME = ("CASE WHEN error IS NULL THEN 'ok' WHEN regexp_matches(error, '(?i)not permitted|not allowed|denied|"
            "forbid|policy|unauthori[sz]ed|autonomous agents cannot write') THEN 'denied' ELSE 'error' END")


@register("t6_outcomes", "T6", oracle=f"""
SELECT {_OUTCOME} AS outcome, count(*) AS statements FROM audit_log GROUP BY 1""")
def t6_outcomes(spark, sf):
    a = src.audit_log(spark, sf)
    return a.groupBy(au.outcome(F.col("error")).alias("outcome")).agg(F.count(F.lit(1)).alias("statements"))


@register("a9_decision_summary", ("A9", "T5", "T6"), oracle=f"""
SELECT account_id, resource_name, lower(regexp_extract(ltrim(query_body), '^([A-Za-z]+)', 1)) AS verb,
       {_OUTCOME} AS outcome, count(*) AS statements, min(ts) AS first_ts, max(ts) AS last_ts
FROM audit_log GROUP BY ALL""")
def a9_decision_summary(spark, sf):
    a = src.audit_with_time(src.audit_log(spark, sf))
    c = au.classify_statements(a, src.CANONICAL_UPDATE).withColumn("outcome", au.outcome(F.col("error")))
    return au.decision_summary(c)


@register("a10_row_cap_audit", "A10", oracle="""
SELECT account_id, count(*) AS violations, max(TRY_CAST(record_count AS BIGINT)) AS max_rows FROM audit_log
WHERE contains(query_body, 'customers') AND TRY_CAST(record_count AS BIGINT) > 100 GROUP BY 1""")
def a10_row_cap_audit(spark, sf):
    return au.row_cap_violations(src.audit_log(spark, sf))


@register("p11_forensic_trail", "P11", oracle="""
SELECT "timestamp", account_email, resource_name, "authorization", error, query_body FROM audit_log
WHERE account_id = 'acct-agent' ORDER BY "timestamp" DESC, id DESC LIMIT 100""")
def p11_forensic_trail(spark, sf):
    return au.forensic_trail(src.audit_log(spark, sf), pol.AGENT)


# The evidence searched for in the audit log.
_PROBES = [
    ("denied_orders_update", pol.AGENT, pol.READ_RESOURCE, "UPDATE public.orders", "denied|deny|forbid|not permitted"),
    ("permitted_repair", pol.AGENT, pol.REMEDIATION_RESOURCE, "FROM public.poison_backup", "allow|permit|success"),
    ("denied_merge", pol.AGENT, pol.GITHUB_MCP, "merge_pull_request", "denied|deny|forbid|not permitted"),
]
_BEFORE, _AFTER = "2024-01-10 00:00:00", "2024-01-10 06:00:00"


def _evidence_sql() -> str:
    cols = ["id", "timestamp", "account_id", "account_email", "account_first_name", "account_last_name",
            "resource_id", "resource_name", "resource_type", "remote_identity_username", "query_body",
            "query_hash", "duration", "record_count", "authorization", "error", "source_ip", "client_ip",
            "user_agent", "egress_node_id", "encrypted", "capture"]
    text = "to_json({" + ", ".join(f"'{c}': \"{c}\"" for c in cols) + "})"
    parts = []
    for name, p, n1, n2, dec in _PROBES:
        hit = (f"(contains(t, '{p}') AND contains(t, '{n1}') AND contains(t, '{n2}') "
               f"AND regexp_matches(t, '(?i)(?:{dec})'))")
        parts.append(f"""SELECT '{name}' AS probe, count(*) FILTER (WHERE {hit}) AS matches,
  count(*) FILTER (WHERE {hit}) >= 1 AS at_least_one, count(*) FILTER (WHERE {hit}) = 1 AS exactly_one,
  count(*) FILTER (WHERE {hit} AND ts < TIMESTAMP '{_BEFORE}') AS "before",
  count(*) FILTER (WHERE {hit} AND ts < TIMESTAMP '{_AFTER}') AS "after",
  count(*) FILTER (WHERE {hit} AND ts < TIMESTAMP '{_AFTER}') - count(*) FILTER (WHERE {hit} AND ts < TIMESTAMP '{_BEFORE}') = 1
      AS grew_by_one
FROM (SELECT ts, {text} AS t FROM audit_log)""")
    return "\nUNION ALL ".join(parts)


@register("a8_evidence_counts", ("A8", "P10"), bench=True, oracle=_evidence_sql())
def a8_evidence_counts(spark, sf):
    a = src.audit_with_time(src.audit_log(spark, sf)).drop("rows_returned", "duration_ms")
    return au.evidence_counts(a, _PROBES, _BEFORE, _AFTER)


# The evidence of a run's tool calls and of its one repair.
_RUN_PROBES = [
    ("denied_orders_update", pol.AGENT, pol.READ_RESOURCE, "UPDATE public.orders", "denied|deny|forbid|not permitted"),
    ("read_incident", pol.AGENT, pol.GRAFANA_MCP, "get_incident", "allow|permit|success"),
    ("timeline_entry", pol.AGENT, pol.GRAFANA_MCP, "add_activity_to_incident", "allow|permit|success"),
    ("filed_issue", pol.AGENT, pol.GITHUB_MCP, "issue_write", "allow|permit|success"),
    ("permitted_repair", pol.AGENT, pol.REMEDIATION_RESOURCE, "SQL::update", "allow|permit|success"),
]
_RUN_TEXT = "'{\"account\":\"' || principal_id || '\",\"resource\":\"' || resource_id || '\",\"action\":\"' || action || '\"' || " \
    "CASE WHEN len(write_tables) > 0 THEN ',\"query\":\"' || upper(split_part(action, '::', 2)) || ' ' || " \
    "array_to_string(qualified_write_tables, ', ') || '\"' ELSE '' END || " \
    "',\"authorization\":\"' || CASE decision WHEN 'allow' THEN 'allowed' ELSE 'denied' END || '\"}'"


@register("a8_evidence_by_run", ("A8", "P10"), oracle=f"""
WITH t AS (SELECT principal_id AS account, CAST(date_trunc('day', ts) AS TIMESTAMP) AS run_day, {_RUN_TEXT} AS t FROM mix_decided),
hits AS ({" UNION ALL ".join(
    f"SELECT account, run_day, '{n}' AS probe, contains(t, '{p}') AND contains(t, '{a}') AND contains(t, '{b_}') "
    f"AND regexp_matches(t, '(?i)(?:{d})') AS hit FROM t" for n, p, a, b_, d in _RUN_PROBES)}),
runs AS (SELECT account, run_day, probe, count(*) FILTER (WHERE hit) AS matches FROM hits GROUP BY ALL),
sums AS (SELECT *, CAST(sum(matches) OVER (PARTITION BY account, probe ORDER BY run_day) AS BIGINT) AS "after" FROM runs)
SELECT account, run_day, probe, matches, matches >= 1 AS at_least_one, matches = 1 AS exactly_one,
       "after" - matches AS "before", "after", matches = 1 AS grew_by_one FROM sums""")
def a8_evidence_by_run(spark, sf):
    d = pol.decide(src.request_mix(spark, sf))
    return au.evidence_by_run(d, src.decided_record(d), _RUN_PROBES)


_BROAD_RE = pol.BROAD_PERMIT_PATTERN.replace("'", "''")


@register("c13_broad_permits", "C13", oracle=f"""
SELECT origin, source, count(*) AS texts,
       count(*) FILTER (WHERE regexp_matches(text, '{_BROAD_RE}')) AS broad_texts
FROM (SELECT 'documents' AS origin, source, text FROM documents
      UNION ALL SELECT 'conversations', role, text FROM conversations)
GROUP BY ALL""")
def c13_broad_permits(spark, sf):
    """Free text that may carry pasted policy (documents, conversation turns),
    scanned whole for an unconditional permit or the words "global access"."""
    texts = src.policy_texts(spark, sf)
    return (pol.broad_permits(texts).groupBy("origin", "source")
            .agg(F.count(F.lit(1)).alias("texts"), F.count_if("broad").alias("broad_texts")))


def _rx_any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in patterns) + ")"


def _under_sql(col: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({col} || '/', '{p.rstrip('/')}/')" for p in prefixes) + ")"


VIEWS["command_log"] = """
SELECT event_id, ts, 'session-' || (user_id % 4) AS session,
       CASE WHEN event_type = 'view' THEN './bin/db-query.sh "SELECT * FROM public.orders WHERE id = ' || k || '"'
                 || CASE WHEN k % 5 = 4 THEN '; picoclaw config show' ELSE '' END
            WHEN event_type = 'click' THEN 'bin/db-query.sh --json "SELECT id, name FROM public.customers WHERE id = '
                 || k || '"'
            WHEN event_type = 'purchase' THEN './bin/sdm-request-access.sh pg-prod-remediation 15m INC-'
                 || (event_id % 50 + 100)
            WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'sdm status' ELSE 'sdm admin users list' END
            WHEN k % 3 = 0 THEN 'crontab -l' WHEN k % 3 = 1 THEN 'systemctl restart orders-api'
            ELSE 'curl -s https://status.example/' END AS command,
       CASE WHEN event_type = 'view' THEN '/opt/agent/workspace/sessions/' || event_id || '.json'
            WHEN event_type = 'click' THEN '/opt/agent/workspace/notes.md'
            WHEN event_type = 'purchase' THEN '/var/log/agent/agent.log'
            WHEN event_type = 'error' THEN '/opt/agent/workspace/memory'
            ELSE '/opt/agent/workspace-old/' || k END AS path
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


@register("c15_command_gate", "C15", oracle=f"""
SELECT event_id, session, command, path,
       {_rx_any("command", pol.COMMAND_ALLOW)} AND NOT {_rx_any("command", pol.COMMAND_DENY)} AS command_allowed,
       {_rx_any("command", pol.COMMAND_DENY)} AS command_denied_by_pattern,
       {_under_sql("path", pol.READ_PREFIXES + pol.WRITE_PREFIXES)} AS path_readable,
       {_under_sql("path", pol.WRITE_PREFIXES)} AS path_writable
FROM command_log""")
def c15_command_gate(spark, sf):
    return pol.command_gate(dv.command_log(spark, sf)).select(
        "event_id", "session", "command", "path", "command_allowed", "command_denied_by_pattern",
        "path_readable", "path_writable")
