"""Record transforms over operational text: alerts, access requests, jobs,
incidents, rule states, grant and tool drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopguard.operators import policy as pol
from shopguard.operators.metrics import fixed

# Fixed values of the alert envelope defaults.
DEFAULT_INCIDENT = "GRAFANA-ALERT"
DEFAULT_SERVICE = "orders-api"
DEFAULT_URGENCY = "high"
DEFAULT_STATUS = "firing"
FLAT_DEFAULTS = {"incident_id": "UNKNOWN", "title": "Untitled alert", "service": "orders-api",
                 "urgency": "high", "details": "", "html_url": "", "created_at": ""}
DETAILS_MAX = 2000


def _vstr(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _truthy_str(s: Column) -> Column:
    return s.isNotNull() & (s != "")


def _nonempty_obj(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return t.startswith("OBJECT") & (t != "OBJECT<>")


def _has_key(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")).isNotNull()


def _or(*cols: Column) -> Column:
    """Python ``a or b or ...`` over strings: the first non-empty value."""
    out = cols[-1]
    for c in reversed(cols[:-1]):
        out = F.when(_truthy_str(c), c).otherwise(out)
    return out


def _get(v: Column, path: str, default: str) -> Column:
    """Python ``d.get(k, default)``: the default only when the key is absent."""
    return F.when(_has_key(v, path), _vstr(v, path)).otherwise(F.lit(default))


def normalise_alerts(df: DataFrame, col: str = "payload") -> DataFrame:
    """T4: alert webhook (or flat payload) -> incident_id, title, service,
    urgency, status, created_at, html_url, details. Only the first alert is used."""
    v = F.try_parse_json(F.col(col))
    alerts_is_list = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.alerts", "variant"))
                                .startswith("ARRAY"), F.lit(False))
    first0 = F.try_variant_get(v, "$.alerts[0]", "variant")
    first = F.when(_nonempty_obj(first0) | (F.schema_of_variant(first0) == "OBJECT<>"), first0) \
        .otherwise(F.parse_json(F.lit("{}")))
    fl, cl = F.try_variant_get(first, "$.labels", "variant"), F.try_variant_get(v, "$.commonLabels", "variant")
    labels = F.when(_nonempty_obj(fl), fl).when(_nonempty_obj(cl), cl).otherwise(F.parse_json(F.lit("{}")))
    fa = F.try_variant_get(first, "$.annotations", "variant")
    ca = F.try_variant_get(v, "$.commonAnnotations", "variant")
    ann = F.when(_nonempty_obj(fa), fa).when(_nonempty_obj(ca), ca).otherwise(F.parse_json(F.lit("{}")))
    env = {
        "incident_id": _or(_vstr(first, "$.fingerprint"), _vstr(labels, "$.alertname"), F.lit(DEFAULT_INCIDENT)),
        "title": _or(_vstr(v, "$.title"), _vstr(ann, "$.summary"), _get(labels, "$.alertname", "")),
        "service": _get(labels, "$.service", DEFAULT_SERVICE),
        "urgency": _get(labels, "$.severity", DEFAULT_URGENCY),
        "status": _get(v, "$.status", DEFAULT_STATUS),
        "created_at": _get(first, "$.startsAt", ""),
        "html_url": _or(_vstr(first, "$.generatorURL"), _get(v, "$.externalURL", "")),
        "details": F.substring(_or(_vstr(v, "$.message"), _get(ann, "$.description", "")), 1, DETAILS_MAX),
    }
    flat = {k: _get(v, f"$.{k}", d) for k, d in FLAT_DEFAULTS.items()}
    flat["status"] = _get(v, "$.status", DEFAULT_STATUS)
    flat["details"] = _get(v, "$.details", "")
    keys = ["incident_id", "title", "service", "urgency", "status", "created_at", "html_url", "details"]
    return df.select(*[c for c in df.columns if c != col],
                     alerts_is_list.alias("from_webhook"),
                     *[F.when(alerts_is_list, env[k]).otherwise(flat[k]).alias(k) for k in keys])


# Fixed values of the access-request rule.
MIN_REASON = 80
REQUIRED_DURATION = "15m"
REASON_NEEDLES = ("UPDATE public.orders", "400", "poison_backup")


def validate_requests(req: DataFrame) -> DataFrame:
    """One flag per rule, the failed rule names, and ``valid``."""
    r = F.col("reason")
    rules = {
        "reason_length": F.length(r) >= MIN_REASON,
        "reason_has_incident": F.contains(r, F.col("incident_id")),
        "duration_15m": F.col("duration") == REQUIRED_DURATION,
        "mentions_update": F.contains(r, F.lit(REASON_NEEDLES[0])),
        "mentions_row_count": F.contains(r, F.lit(REASON_NEEDLES[1])),
        "mentions_backup": F.contains(r, F.lit(REASON_NEEDLES[2])),
    }
    flags = {k: F.coalesce(c, F.lit(False)) for k, c in rules.items()}
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in flags.items()]))
    return req.withColumns(flags).withColumn("failed_rules", failed) \
        .withColumn("valid", F.size("failed_rules") == 0)


# Fixed values of the job runner.
STDOUT_KEEP, STDERR_KEEP = 20000, 8000


def job_states(jobs: DataFrame) -> DataFrame:
    """Exit 0 -> finished, other -> failed, timeout -> timeout with a NULL
    exit code; keep the last 20,000 / 8,000 characters; duration to 0.1 s."""
    timed_out = F.col("timed_out")
    tail = lambda c, n: F.when(F.length(c) > n, F.substring(c, -n, n)).otherwise(F.col(c))
    return jobs.select(
        "job_id", "session", "submitted_at",
        F.when(timed_out, "timeout").when(F.col("exit_code") == 0, "finished").otherwise("failed").alias("state"),
        F.when(timed_out, F.lit(None).cast("int")).otherwise(F.col("exit_code")).alias("exit_code"),
        F.when(timed_out, F.lit("")).otherwise(tail("stdout", STDOUT_KEEP)).alias("stdout"),
        tail("stderr", STDERR_KEEP).alias("stderr"),
        fixed(F.col("duration_raw"), 1).alias("duration_seconds"))  # Python's round(x, 1)


def recent(df: DataFrame, keep: int, show: int, ts: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Newest ``keep`` rows (per group), then the first ``show`` of them."""
    if show > keep:
        raise ValueError("show must not exceed keep")
    if not by:
        return df.orderBy(F.desc(ts), F.desc(key)).limit(min(keep, show))
    w = Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= min(keep, show)).drop("_r")


# Fixed value: what counts as an approval in a request listing.
APPROVED_PATTERN = r"(?i)approved|granted"


def request_state(records: DataFrame) -> DataFrame:
    """Per listing, whether a Pending request blocks a clean start and which
    requests read as approved."""
    status = F.split(F.trim("text"), r"\s+")[1]
    return (records.withColumn("status", status)
            .withColumn("approved", F.col("text").rlike(APPROVED_PATTERN))
            .groupBy("file")
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.bool_or(F.col("status") == "Pending").alias("blocks_clean_start"),
                 F.count_if("approved").alias("approved")))


def open_incidents(incidents: DataFrame, limit: int = 25, col: str = "doc") -> DataFrame:
    """Active incidents newest first, at most ``limit``; the id is the first
    non-null of ``incidentID`` and ``id``."""
    v = F.try_parse_json(F.col(col))
    inc = incidents.select(
        F.coalesce(_vstr(v, "$.incidentID"), _vstr(v, "$.id")).alias("incident_id"),
        _vstr(v, "$.title").alias("title"), _vstr(v, "$.severity").alias("severity"),
        _vstr(v, "$.status").alias("status"),
        F.to_timestamp_ntz(_vstr(v, "$.createdAt"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"))
    return (inc.where(F.col("status") == "active")
            .orderBy(F.desc("created_at"), F.desc("incident_id")).limit(limit))


def rule_state(docs: DataFrame, names: Sequence[str], col: str = "doc") -> DataFrame:
    """For each document and rule name, the state of the first rule with that
    name across groups (group order, then rule order), ``""`` when absent, plus
    an existence flag.

    The lookup stays inside each document: the groups' rule lists are flattened
    in order and the first rule with the name is picked, so there is no shuffle,
    no join, and a document is parsed once.
    """
    v = F.try_parse_json(F.col(col))
    groups = F.try_variant_get(v, "$.data.groups", "array<variant>")
    no_rules = F.array().cast("array<variant>")
    rules = F.flatten(F.transform(groups, lambda g: F.coalesce(
        F.try_variant_get(g, "$.rules", "array<variant>"), no_rules)))

    def lookup(name: str) -> Column:
        hit = F.get(F.filter(rules, lambda r: _vstr(r, "$.name") == F.lit(name)), 0)
        return F.struct(F.lit(name).alias("name"),
                        F.coalesce(_vstr(hit, "$.state"), F.lit("")).alias("state"),
                        hit.isNotNull().alias("exists"))

    return docs.select("doc_id", F.inline(F.array(*[lookup(n) for n in names])))


# The database grants the shop roles should hold (column ``*``: the whole table).
EXPECTED_GRANTS = (
    ("shop_read", "public.customers", "*", "SELECT"), ("shop_read", "public.orders", "*", "SELECT"),
    ("shop_read", "public.order_health", "*", "SELECT"), ("shop_read", "public.poison_backup", "*", "SELECT"),
    ("shop_remediation", "public.orders", "id", "SELECT"), ("shop_remediation", "public.orders", "status", "SELECT"),
    ("shop_remediation", "public.orders", "payload", "SELECT"),
    ("shop_remediation", "public.orders", "status", "UPDATE"), ("shop_remediation", "public.orders", "payload", "UPDATE"),
    ("shop_remediation", "public.orders", "created_at", "UPDATE"),
    ("shop_remediation", "public.poison_backup", "id", "SELECT"),
    ("shop_remediation", "public.poison_backup", "status", "SELECT"),
    ("shop_remediation", "public.poison_backup", "payload", "SELECT"),
    ("shop_remediation", "public.poison_backup", "created_at", "SELECT"),
    ("orders_api", "public.orders", "*", "SELECT"), ("orders_api", "private.customer_pii", "*", "SELECT"),
)
GRANT_COLUMNS = ("id", "status", "payload", "created_at")


def grant_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(role, object, column, privilege) missing from ``actual`` and extra in it."""
    keys = ["role", "object", "column", "privilege"]
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.exceptAll(a).withColumn("finding", F.lit("missing")).unionByName(
        a.exceptAll(e).withColumn("finding", F.lit("extra")))


def repair_privileges(body: Column) -> Column:
    """The (object, column, privilege) an aliased repair statement uses: what it sets of the orders (``o``), and
    what it reads of them and of the backup (``b``)."""
    out = []
    sets = F.regexp_extract(body, " SET (.*?) FROM ", 1)
    for c in GRANT_COLUMNS:
        for text, pattern, obj, privilege in ((sets, rf"(^|, ){c} = ", "public.orders", "UPDATE"),
                                              (body, rf"\bo\.{c}\b", "public.orders", "SELECT"),
                                              (body, rf"\bb\.{c}\b", "public.poison_backup", "SELECT")):
            out.append(F.when(text.rlike(pattern), F.struct(F.lit(obj).alias("object"), F.lit(c).alias("column"),
                                                            F.lit(privilege).alias("privilege"))))
    return F.array_compact(F.array(*out))


# Tools each MCP server must expose.
REQUIRED_TOOLS = (("grafana", "get_incident"), ("grafana", "add_activity_to_incident"),
                  ("grafana", "create_incident"), ("github", "list_pull_requests"),
                  ("github", "issue_write"), ("github", "merge_pull_request"))


def allowlist(spark) -> DataFrame:
    rows = [("grafana", t) for t in pol.GRAFANA_TOOLS] + [("github", t) for t in pol.GITHUB_TOOLS]
    return spark.createDataFrame(rows, "server string, tool string")


def tool_drift(exposed: DataFrame, required: DataFrame, allowed: DataFrame) -> DataFrame:
    """Required-but-missing, exposed-but-not-allow-listed (fails closed) and
    allow-listed-but-not-exposed tools, by three anti joins on (server, tool)."""
    k = ["server", "tool"]
    e, r, a = exposed.select(*k).distinct(), required.select(*k), allowed.select(*k)
    return (r.join(e, k, "left_anti").withColumn("finding", F.lit("required_not_exposed"))
            .unionByName(e.join(F.broadcast(a), k, "left_anti").withColumn("finding", F.lit("exposed_not_allowlisted")))
            .unionByName(a.join(e, k, "left_anti").withColumn("finding", F.lit("allowlisted_not_exposed"))))
