"""Audit forensics: statement and outcome classification, evidence, trails, summaries."""

from __future__ import annotations

import re
import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Whitespace of a POSIX [[:space:]] inside one line, the read
# verbs, and the denial vocabulary.
_SP = r"[ \t\r\f\x0B]"
READ_VERB_PATTERN = rf"(?idm)^{_SP}*(select|with|values|table|show)[ \t\r\f\x0B(]"
DENIAL_PATTERN = (r"(?i)not permitted|not allowed|denied|forbid|policy|unauthori[sz]ed|"
                  r"autonomous agents cannot write")


def classify_statements(df: DataFrame, canonical: str, col: str = "query_body") -> DataFrame:
    """T5: strip trailing ``;`` per line, flag multi-statements, normalise, classify."""
    # UNIX_LINES: only a line feed ends a line, so "; \r" hides no second statement.
    stripped = F.regexp_replace(F.col(col), rf"(?dm);{_SP}*$", "")
    squeezed = F.regexp_replace(F.translate(stripped, "\n\t", "  "), " +", " ")
    normalized = F.regexp_replace(F.regexp_replace(squeezed, "^ ", ""), " $", "")
    return df.withColumns({
        "stripped": stripped,
        "multi_statement": F.contains(stripped, F.lit(";")),
        "normalized": normalized,
        "verb": F.lower(F.regexp_extract(normalized, r"^([A-Za-z]+)", 1)),
        "is_read": F.col(col).isNotNull() & stripped.rlike(READ_VERB_PATTERN),
        "is_canonical_repair": normalized == F.lit(canonical),
    })


def outcome(error: Column) -> Column:
    """Ok / denied / error from the error text."""
    return (F.when(error.isNull(), "ok").when(error.rlike(DENIAL_PATTERN), "denied")
            .otherwise("error"))


def record_text(audit: DataFrame) -> Column:
    """Compact JSON text of an audit record (the text the evidence needles search)."""
    return F.to_json(F.struct(*[F.col(c) for c in audit.columns]))


def matches_decision(text: Column, decision_re: str) -> Column:
    """Whether ``text`` matches the regex, ASCII letters in either case.

    An alternation of plain words is searched word by word in the lower-cased
    text: a regular expression tries every word at every offset, letter by letter.
    """
    words = decision_re.split("|")
    if not all(re.fullmatch(r"[A-Za-z0-9 _]+", w) for w in words):
        return text.rlike(f"(?i)(?:{decision_re})")
    # Only ASCII letters fold, as in the regex: other letters' lower case may be an ASCII letter.
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return reduce(or_, [F.contains(lower, F.lit(w.lower())) for w in words])


def evidence(text: Column, principal: str, needle1: str, needle2: str, decision_re: str) -> Column:
    """P10: record text contains the principal and both needles and matches the
    decision regex case-insensitively."""
    return (F.contains(text, F.lit(principal)) & F.contains(text, F.lit(needle1))
            & F.contains(text, F.lit(needle2)) & matches_decision(text, decision_re))


def evidence_by_run(audit: DataFrame, text: Column, probes: list[tuple[str, str, str, str, str]],
                    account: str = "principal_id", ts: str = "ts") -> DataFrame:
    """A8 per run (an account's day): how often each probe matches, whether at
    least or exactly once, and whether its running count grew by one that day.

    One pass: flags per record, summed per account, day and probe.
    """
    flags = F.array(*[F.struct(F.lit(name).alias("probe"), evidence(F.col("_text"), p, n1, n2, d).alias("hit"))
                      for name, p, n1, n2, d in probes])
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")
    hits = audit.withColumn("_text", text).select(F.col(account).alias("account"), day.alias("run_day"), F.inline(flags))
    runs = hits.groupBy("account", "run_day", "probe").agg(F.count_if("hit").alias("matches"))
    so_far = Window.partitionBy("account", "probe").orderBy("run_day").rowsBetween(Window.unboundedPreceding, 0)
    return (runs.withColumn("after", F.sum("matches").over(so_far))
            .withColumn("before", F.col("after") - F.col("matches"))
            .select("account", "run_day", "probe", "matches", (F.col("matches") >= 1).alias("at_least_one"),
                    (F.col("matches") == 1).alias("exactly_one"), "before", "after",
                    (F.col("after") == F.col("before") + 1).alias("grew_by_one")))


def evidence_counts(audit: DataFrame, probes: list[tuple[str, str, str, str, str]],
                    before_ts: str | None = None, after_ts: str | None = None,
                    ts_col: str = "ts") -> DataFrame:
    """One pass, one row per probe: matches, at_least_one, exactly_one; with
    two points in time also the counts at each and whether it grew by exactly one."""
    # The text and each probe's flag are columns of their own, so each is computed once a row.
    named = audit.withColumn("_ts", F.col(ts_col)) if ts_col in audit.columns else audit.withColumn("_ts", F.lit(None))
    rows = named.select("_ts", record_text(audit.drop(ts_col)).alias("_text"))
    flags = rows.select("_ts", *[evidence(F.col("_text"), p, n1, n2, dec).alias(f"h{i}")
                                 for i, (_, p, n1, n2, dec) in enumerate(probes)])
    aggs = []
    for i in range(len(probes)):
        aggs.append(F.count_if(f"h{i}").alias(f"m{i}"))
        if before_ts and after_ts:
            aggs.append(F.count_if(F.col(f"h{i}") & (F.col("_ts") < F.lit(before_ts).cast("timestamp_ntz"))).alias(f"b{i}"))
            aggs.append(F.count_if(F.col(f"h{i}") & (F.col("_ts") < F.lit(after_ts).cast("timestamp_ntz"))).alias(f"a{i}"))
    wide = flags.agg(*aggs)
    # One row per probe from the single aggregate row. (A union of selects
    # would let column pruning cut a different aggregate per branch, and each
    # would scan the log again.)
    rows = []
    for i, (name, *_rest) in enumerate(probes):
        cols = [F.lit(name).alias("probe"), F.col(f"m{i}").alias("matches"),
                (F.col(f"m{i}") >= 1).alias("at_least_one"), (F.col(f"m{i}") == 1).alias("exactly_one")]
        if before_ts and after_ts:
            cols += [F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after"),
                     (F.col(f"a{i}") - F.col(f"b{i}") == 1).alias("grew_by_one")]
        rows.append(F.struct(*cols))
    return wide.select(F.inline(F.array(*rows)))


def forensic_trail(audit: DataFrame, account_id: str, n: int = 100) -> DataFrame:
    """One account's statements, newest first, at most ``n`` (ties by id)."""
    return (audit.where(F.col("account_id") == account_id)
            .orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
            .select("timestamp", "account_email", "resource_name", "authorization", "error",
                    "query_body"))


def decision_summary(classified: DataFrame) -> DataFrame:
    """Statements by account, resource, verb and outcome, denials first."""
    return (classified.groupBy("account_id", "resource_name", "verb", "outcome")
            .agg(F.count(F.lit(1)).alias("statements"), F.min("ts").alias("first_ts"),
                 F.max("ts").alias("last_ts"))
            .orderBy(F.when(F.col("outcome") == "denied", 0).otherwise(1), F.desc("statements")))


def row_cap_violations(audit: DataFrame, cap: int = 100, table_needle: str = "customers") -> DataFrame:
    """A10: customer reads returning more than ``cap`` rows, per account."""
    rows = F.expr("try_cast(record_count AS BIGINT)")
    return (audit.where(F.contains(F.col("query_body"), F.lit(table_needle)) & (rows > cap))
            .groupBy("account_id").agg(F.count(F.lit(1)).alias("violations"),
                                       F.max(rows).alias("max_rows")))


def new_ids(after: DataFrame, before: DataFrame, col: str = "request_id") -> DataFrame:
    """X1 (``comm -13``): ids present after but not before, duplicates kept."""
    return after.select(col).exceptAll(before.select(col))
