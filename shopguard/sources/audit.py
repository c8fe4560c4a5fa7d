"""Access requests and the audit log, derived from ``events`` (FIXTURES.md section 3).

Account by ``user_id % 3``: 0 the agent service account (role ai-agents), 1 a
human on call (sre-oncall), 2 a service account without roles. view -> select
on orders, click -> select on customers, purchase -> update public.orders,
error -> update public.payments, signup -> the GitHub tool merge_pull_request.
Writes go to the remediation resource when ``props.k`` is even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopguard.operators import policy as pol
from shopguard.sources.tables import load_table

# Fixed values of the audit binding.
ACCOUNTS = {
    0: (pol.AGENT, "service", [pol.ROLE_AGENTS], "agent@ops.example", "Ops", "Agent"),
    1: ("acct-oncall", "human", [pol.ROLE_ONCALL], "oncall@ops.example", "On", "Call"),
    2: ("acct-batch", "service", [], "batch@ops.example", "Batch", "Job"),
}
CANONICAL_UPDATE = (
    "UPDATE public.orders AS o SET status = b.status, payload = b.payload, created_at = "
    "b.created_at FROM public.poison_backup AS b WHERE b.id = o.id AND o.status = "
    "'PENDING_RECONCILE' AND o.payload->>'reconcile_batch' = 'RECONCILE-BATCH-2026-08-28'")
# The policy generation that recorded the log: it predates the PII read permits.
RECORDED_POLICY_EXCLUDES = ("pii.email", "pii.phone")


def _by_account(idx: int) -> Column:
    m = F.col("user_id") % 3
    vals = {k: v[idx] for k, v in ACCOUNTS.items()}
    if isinstance(vals[0], list):
        lit = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    else:
        lit = F.lit
    return F.when(m == 0, lit(vals[0])).when(m == 1, lit(vals[1])).otherwise(lit(vals[2]))


def _arr(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def policy_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy request row per event, with the statement text it carried."""
    return policy_requests_from(load_table(spark, sf_dir, "events"))


def policy_requests_from(e: DataFrame) -> DataFrame:
    """``policy_requests`` over any events frame (batch or streaming)."""
    # A column of its own, so the JSON is searched once a row and not once a branch.
    e, k = e.withColumn("_k", F.get_json_object("props", "$.k").cast("int")), F.col("_k")
    et = F.col("event_type")
    write = et.isin("purchase", "error")
    remediation = write & (k % 2 == 0)
    resource = (F.when(et == "signup", F.lit(pol.GITHUB_MCP))
                .when(remediation, F.lit(pol.REMEDIATION_RESOURCE)).otherwise(F.lit(pol.READ_RESOURCE)))
    ks = k.cast("string")
    body = (F.when(et == "view", F.concat(F.lit("SELECT * FROM public.orders WHERE id = "), ks))
            .when(et == "click", F.concat(F.lit("SELECT id, name, email FROM public.customers WHERE id = "), ks))
            .when((et == "purchase") & remediation, F.lit(CANONICAL_UPDATE + ";"))
            .when(et == "purchase",
                  F.concat(F.lit("UPDATE public.orders SET status = 'SHIPPED'\nWHERE id = "), ks, F.lit(";")))
            .when(et == "error", F.concat(F.lit("UPDATE public.payments SET amount_cents = 0 WHERE id = "), ks))
            .otherwise(F.concat(F.lit('merge_pull_request {"pull_number":'), ks, F.lit("}"))))
    tables = (F.when(et == "view", _arr("orders")).when(et == "click", _arr("customers"))
              .when((et == "purchase") & remediation, _arr("orders", "poison_backup"))
              .when(et == "purchase", _arr("orders")).when(et == "error", _arr("payments")))
    wt = F.when(et == "purchase", _arr("orders")).when(et == "error", _arr("payments")) \
        .when(et.isin("view", "click"), _arr())
    qwt = F.when(et == "purchase", _arr("public.orders")).when(et == "error", _arr("public.payments")) \
        .when(et.isin("view", "click"), _arr())
    tags = F.when(et == "signup", F.create_map().cast("map<string,string>")) \
        .otherwise(F.create_map(F.lit("env"), F.lit("prod")))
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", k.alias("k"),
        _by_account(0).alias("principal_id"), _by_account(1).alias("account_type"),
        _by_account(2).alias("roles"),
        F.when(et.isin("view", "click"), "SQL::select").when(write, "SQL::update")
        .otherwise("MCP::merge_pull_request").alias("action"),
        resource.alias("resource_id"), tags.alias("resource_tags"),
        (et != "signup").alias("has_sql"), tables.alias("tables"), wt.alias("write_tables"),
        qwt.alias("qualified_write_tables"), body.alias("query_body"),
        _by_account(3).alias("account_email"), _by_account(4).alias("account_first_name"),
        _by_account(5).alias("account_last_name"))


# Requests of every kind the policies speak of, one template per event in turn:
# action, resource, env tag, tables, written tables (None: no SQL).
REQUEST_KINDS = (
    (pol.CONNECT, pol.READ_RESOURCE, "prod", None, None),
    (pol.CONNECT, pol.ADMIN_RESOURCE, "prod", None, None),
    (pol.REQUEST_ACCESS, pol.REMEDIATION_RESOURCE, "prod", None, None),
    (pol.ACCESS_REQUEST_ACTIONS[0], pol.REMEDIATION_RESOURCE, "prod", None, None),
    (pol.ACCESS_REQUEST_ACTIONS[1], pol.READ_RESOURCE, "prod", None, None),
    ("SQL::select", pol.READ_RESOURCE, "prod", ("orders",), ()),
    ("SQL::select", pol.READ_RESOURCE, "prod", ("customers", "orders"), ()),
    ("SQL::with", pol.READ_RESOURCE, "prod", ("customers",), ()),
    ("SQL::values", pol.READ_RESOURCE, "prod", (), ()),
    ("SQL::show", pol.READ_RESOURCE, "prod", (), ()),
    ("SQL::set", pol.READ_RESOURCE, "prod", ("customers",), ()),
    ("SQL::update", pol.REMEDIATION_RESOURCE, "prod", ("orders", "poison_backup"), ("orders",)),
    ("SQL::update", pol.REMEDIATION_RESOURCE, "prod", ("orders", "payments"), ("orders", "payments")),
    ("SQL::delete", pol.READ_RESOURCE, "prod", ("payments",), ("payments",)),
    ("SQL::update", pol.READ_RESOURCE, "prod", ("orders",), ("orders",)),
    ("SQL::insert", pol.READ_RESOURCE, None, ("orders",), ("orders",)),
    ("MCP::get_incident", pol.GRAFANA_MCP, None, None, None),
    ("MCP::add_activity_to_incident", pol.GRAFANA_MCP, None, None, None),
    ("MCP::create_incident", pol.GRAFANA_MCP, None, None, None),
    ("MCP::update_dashboard", pol.GRAFANA_MCP, None, None, None),
    ("MCP::issue_write", pol.GITHUB_MCP, None, None, None),
    ("MCP::create_pull_request", pol.GITHUB_MCP, None, None, None),
    ("MCP::push_files", pol.GITHUB_MCP, None, None, None),
    ("MCP::delete_file", pol.GITHUB_MCP, None, None, None),
)


def request_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy request per event, of the kinds in ``REQUEST_KINDS`` in turn."""
    return request_mix_from(load_table(spark, sf_dir, "events"))


def request_mix_from(events: DataFrame) -> DataFrame:
    """``request_mix`` over any events frame (batch or streaming)."""
    kinds = F.array(*[F.struct(
        F.lit(a).alias("action"), F.lit(r).alias("resource_id"), F.lit(env).cast("string").alias("env"),
        F.lit(t is not None).alias("has_sql"),
        (F.lit(None).cast("array<string>") if t is None else _arr(*t)).alias("tables"),
        (F.lit(None).cast("array<string>") if w is None else _arr(*w)).alias("write_tables"))
        for a, r, env, t, w in REQUEST_KINDS])
    picked = events.select("event_id", "ts", "user_id").withColumn("r", F.get(kinds, (F.col("event_id") % len(REQUEST_KINDS)).cast("int")))
    return picked.select(
        "event_id", "ts", _by_account(0).alias("principal_id"), _by_account(1).alias("account_type"),
        _by_account(2).alias("roles"), "r.action", "r.resource_id",
        F.when(F.col("r.env").isNull(), F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("env"), F.col("r.env"))).alias("resource_tags"),
        "r.has_sql", "r.tables", "r.write_tables",
        F.transform("r.write_tables", lambda t: F.concat(F.lit("public."), t)).alias("qualified_write_tables"))


# Events that one incident run of the binding spans.
RUN_EVENTS = 240


def incident_of(event_id: Column) -> Column:
    """The incident an event belongs to: consecutive events, ``RUN_EVENTS`` at a time."""
    return F.concat(F.lit("INC-"), F.floor(event_id / RUN_EVENTS).cast("string"))


def decided_record(decided: DataFrame) -> Column:
    """Compact JSON record of a decided request: who, what, on which resource, with the statement of a write."""
    statement = F.when(F.size("qualified_write_tables") > 0, F.concat(
        F.upper(F.substring_index("action", "::", -1)), F.lit(" "), F.array_join("qualified_write_tables", ", ")))
    return F.to_json(F.struct(
        F.col("principal_id").alias("account"), F.col("resource_id").alias("resource"), "action", statement.alias("query"),
        F.when(F.col("decision") == "allow", "allowed").otherwise("denied").alias("authorization")))


def audit_log(spark: SparkSession, sf_dir: str, policies=None) -> DataFrame:
    """The audit table: one string record per statement, decisions as recorded."""
    return audit_from(policy_requests(spark, sf_dir), policies)


def audit_from(requests: DataFrame, policies=None) -> DataFrame:
    """``audit_log`` over any policy-request frame (batch or streaming)."""
    policies = policies or pol.policy_set(exclude=RECORDED_POLICY_EXCLUDES)
    r = pol.decide(requests, policies)
    allowed = F.col("decision") == "allow"
    is_db = F.col("resource_id") != pol.GITHUB_MCP
    rows = (F.when(~allowed, F.lit(0)).when(F.col("action") == "SQL::select",
                                            F.floor(F.col("value") * 10)).otherwise(F.lit(1)))
    return r.select(
        F.concat(F.lit("q-"), F.col("event_id").cast("string")).alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("principal_id").alias("account_id"), "account_email", "account_first_name",
        "account_last_name", "resource_id", F.col("resource_id").alias("resource_name"),
        F.when(is_db, "postgres").otherwise("mcp").alias("resource_type"),
        F.when(F.col("resource_id") == pol.READ_RESOURCE, "shop_read")
        .when(F.col("resource_id") == pol.REMEDIATION_RESOURCE, "shop_remediation")
        .alias("remote_identity_username"),
        "query_body", F.md5("query_body").alias("query_hash"),
        F.floor(F.col("value") * 3).cast("long").cast("string").alias("duration"),
        rows.cast("long").cast("string").alias("record_count"),
        F.when(allowed, "allowed").otherwise("denied").alias("authorization"),
        F.col("error"),
        F.concat(F.lit("10.0.1."), (F.col("user_id") % 250).cast("string")).alias("source_ip"),
        F.lit("127.0.0.1").alias("client_ip"),
        F.when(is_db, "psql").otherwise("mcp-client").alias("user_agent"),
        F.lit("relay-1").alias("egress_node_id"),
        F.lit(True).alias("encrypted"), F.lit(None).cast("string").alias("capture"))


def audit_with_time(audit: DataFrame) -> DataFrame:
    """Typed view of the string audit table: ``ts`` parsed, counts cast safely."""
    return audit.withColumns({
        "ts": F.to_timestamp_ntz(F.col("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        "rows_returned": F.expr("try_cast(record_count AS BIGINT)"),
        "duration_ms": F.expr("try_cast(duration AS BIGINT)"),
    })


def access_requests(requests: DataFrame) -> DataFrame:
    """Access requests: the agent asks for the remediation resource before each
    remediation write (purchase events on that resource)."""
    k = F.col("k")
    inc = F.concat(F.lit("INC-"), (F.col("event_id") % 50 + 100).cast("string"))
    reason = F.concat(
        F.lit("Incident "), inc, F.lit(": "),
        F.when(k % 3 != 0, F.lit("run UPDATE public.orders from public.poison_backup for "))
        .otherwise(F.lit("repair ")),
        F.when(k % 4 != 1, F.lit("400")).otherwise(F.lit("the")),
        F.lit(" malformed rows; rollback restores poison_backup values."))
    return (requests.where((F.col("event_type") == "purchase") & (F.col("principal_id") == pol.AGENT)
                           & (F.col("resource_id") == pol.REMEDIATION_RESOURCE))
            .select(F.concat(F.lit("aq-"), F.lpad(F.col("event_id").cast("string"), 6, "0")).alias("request_id"),
                    "event_id", (F.col("ts") - F.make_dt_interval(mins=F.lit(2))).alias("submitted_at"),
                    F.col("principal_id").alias("account"), F.col("resource_id").alias("resource"),
                    F.when(k % 5 == 0, "Pending").when(k % 5 == 1, "Denied").otherwise("Approved").alias("status"),
                    F.when(k % 7 == 0, "30m").otherwise("15m").alias("duration"),
                    inc.alias("incident_id"), reason.alias("reason")))


def policy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text that may carry pasted policy: whole documents and conversation
    turns, tagged with where they came from."""
    docs = load_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), "source", "text")
    turns = load_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"), F.col("role").alias("source"), "text")
    return docs.unionByName(turns)
