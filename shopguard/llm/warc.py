"""WARC not-modified revisits resolved to the full response they stand for.

A server-not-modified revisit holds only the 304 answer's headers. It is
resolved by an as-of join: among the full responses with the same canonical
URL, the latest one captured earlier. The pair's validators must agree (ETag by
weak comparison, else Last-Modified), and the headers a 304 may update replace
those of the stored response (RFC 9110, 15.4.5).

The join sorts responses and revisits together by URL and time over range
partitions, which cut through the captures of a hot URL. Inside a partition a
window carries the last response forward; a URL cut by a boundary gets the last
response of the partitions before it from a table that has at most one row per
boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopguard.llm.common import written

# The header fields a 304 answer updates, and query parameters that only track.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|gclid|fbclid)(=|$)"
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?"

HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host and path that name the same resource: scheme, ``www.``, default ports, fragment, a
    trailing slash and tracking parameters go, the host is lower-cased, parameters are sorted.

    A URL that isn't absolute stays as it is (trimmed); NULL stays NULL.
    """
    u = F.trim(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, URL, 1)), r"^.*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, URL, 2), "/+$", "")
    params = F.filter(F.split(F.substring(F.regexp_extract(u, URL, 3), 2, 1 << 30), "&"),
                      lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    whole = F.concat(F.regexp_replace(host, r"^www[0-9]*\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query))
                     .otherwise(""))
    return F.when(u.rlike(URL), whole).otherwise(u)


def header(headers: Column, name: str) -> Column:
    """First value of a header field, NULL if it isn't there."""
    return F.trim(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"])


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored response's headers with the permitted ones of the 304 in place of theirs, by name, then value."""
    fresh = F.filter(update, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    rest = F.filter(stored, lambda b: ~F.exists(fresh, lambda h: F.lower(h["name"]) == F.lower(b["name"])))
    return F.array_sort(F.transform(F.concat(rest, fresh), lambda h: F.struct(
        F.lower(h["name"]).alias("name"), h["value"].alias("value"))))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, url_key, ts, state, validator, base_id, base_ts, headers, payload_sha256``.

    ``records`` has ``record_id`` long, ``url`` string, ``ts`` long (seconds),
    ``type`` (``response`` or ``revisit``; other records play no part),
    ``status`` int, ``headers`` (array of name, value) and ``payload_sha256``. A full response has status 200.
    ``state`` is ``resolved``, ``validator_mismatch``, ``no_earlier_response`` or
    ``no_url``; only a resolved row has headers and digest. Earlier means a smaller
    ``ts``; of responses at one time the largest id counts. A revisit
    without a time has no earlier response, a response without one is never earlier.
    ``validator`` says what was compared: ``etag``, ``last_modified`` or
    ``none`` (the revisit or the response has neither in common; the URL and time alone decide).
    NULL headers count as none, repeated rows come back as often as they went in, other columns play no
    part, and an empty table gives an empty result.
    """
    rows = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", (F.col("type") == "response").alias("full"),
        F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"), "payload_sha256", "status")
    usable = rows.where((~F.col("full")) | ((F.col("status") == 200) & F.col("ts").isNotNull() & F.col("url_key").isNotNull()))
    # At one time revisits come first, so that no response at the same time is "earlier".
    order = [F.col("ts").asc_nulls_first(), F.col("full").asc(), F.col("record_id").asc()]
    base = F.when(F.col("full"), F.struct("record_id", "ts", "headers", "payload_sha256"))
    ranged = written(usable.repartitionByRange(F.col("url_key"), *order, F.xxhash64("headers"))
                     .withColumn("part", F.spark_partition_id()).drop("status"), "warc-ranged")
    within = Window.partitionBy("part", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.withColumn("base", F.last(base, ignorenulls=True).over(within)).where("NOT full")

    # A URL in several partitions: one row for each it is cut into, fewer than partitions plus boundaries.
    parts = ranged.groupBy("url_key", "part").agg(F.max(F.when(F.col("full"), F.struct("ts", "record_id"))).alias("top"))
    spans = parts.groupBy("url_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url_key")
    cut = parts.join(spans, "url_key")
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("top", F.max("top").over(before)).where("top IS NOT NULL").select(
        "url_key", F.col("part").alias("to_part"), F.col("top.ts").alias("b_ts"), F.col("top.record_id").alias("b_id"))
    stored = ranged.where("full").select("url_key", F.struct("record_id", "ts", "headers", "payload_sha256").alias("carried"))
    carry = (cut.join(stored, (stored["url_key"] == cut["url_key"]) & (F.col("carried.ts") == F.col("b_ts"))
                      & F.col("carried.record_id").eqNullSafe(F.col("b_id")))
             .groupBy(cut["url_key"].alias("k"), F.col("to_part").alias("p")).agg(F.first("carried").alias("carried")))
    joined = here.join(F.broadcast(carry), (F.col("url_key") == F.col("k")) & (F.col("part") == F.col("p")), "left") \
        .withColumn("base", F.when(F.col("ts").isNotNull(), F.coalesce("base", "carried")))

    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")  # noqa: E731  weak comparison
    old, new = F.col("base.headers"), F.col("headers")
    by_tag = tag(old).isNotNull() & tag(new).isNotNull()
    date_old, date_new = header(old, "last-modified"), header(new, "last-modified")
    by_date = date_old.isNotNull() & date_new.isNotNull()
    agree = F.when(by_tag, tag(old) == tag(new)).when(by_date, date_old == date_new).otherwise(True)
    state = F.when(F.col("url_key").isNull(), "no_url").when(F.col("base").isNull(), "no_earlier_response") \
        .when(agree, "resolved").otherwise("validator_mismatch")
    out = joined.withColumn("state", state)
    done = F.col("state") == "resolved"
    return out.select(
        "record_id", "url_key", "ts", "state",
        F.when(F.col("base").isNotNull(), F.when(by_tag, "etag").when(by_date, "last_modified").otherwise("none")).alias("validator"),
        F.col("base.record_id").alias("base_id"), F.col("base.ts").alias("base_ts"),
        F.when(done, merge_headers(old, new)).alias("headers"),
        F.when(done, F.col("base.payload_sha256")).alias("payload_sha256"))


# --- captures derived from the pages table ------------------------------------------------------------

ROUNDS = 4
WEEK = 7 * 86400
FIRST = 1767225600          # 2026-01-01 00:00:00 UTC


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log over ``pages``: ROUNDS captures of each, whose kind, validators and URL spelling follow
    from a hash of the page id and the round. The content changes before round 2."""
    digit = lambda pos: F.expr(f"instr('0123456789abcdef', substr(h, {pos}, 1)) - 1")
    rows = (pages.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("d"),
                         F.length(F.coalesce("html", F.lit(""))).alias("size"))
            .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))))
            .withColumn("h", F.md5(F.concat_ws(":", F.col("page_id").cast("string"), F.col("r").cast("string"))))
            .withColumn("tagged", F.expr("instr('0123456789abcdef', substr(md5(cast(page_id as string)), 1, 1)) - 1"))
            .withColumn("kind", digit(1)).withColumn("gen", F.floor(F.col("r") / 2).cast("int")))
    full = F.element_at(F.array(F.col("kind") < 14, F.col("kind") >= 12, F.col("kind") < 8, F.lit(False)), F.col("r") + 1)
    spelled = F.when(F.col("r") == 1, F.concat(F.regexp_replace("url", "^https?", "HTTPS"), F.lit("#r1"))) \
        .when(F.col("r") == 3, F.concat(F.regexp_replace("url", "#.*$", ""),
                                        F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=crawl"))) \
        .otherwise(F.col("url"))
    ts = F.lit(FIRST) + F.col("r") * WEEK + F.pmod("page_id", F.lit(86400))
    strong = F.concat(F.lit('"'), F.substring(F.md5(F.concat_ws("g", F.col("page_id").cast("string"),
                                                                F.col("gen").cast("string"))), 1, 12), F.lit('"'))
    tag = F.when(F.col("tagged") < 8, strong).when(F.col("tagged") < 12, F.when(F.col("full"), strong)
                                                   .otherwise(F.concat(F.lit("W/"), strong)))
    changed = F.when(F.col("tagged") < 15, F.concat(F.lit("generation "), F.col("gen").cast("string")))
    fields = [("Content-Type", F.when(F.col("full"), F.lit("text/html"))),
              ("Content-Length", F.when(F.col("full"), F.col("size").cast("string")).otherwise(F.lit("0"))),
              ("Cache-Control", F.concat(F.lit("max-age="), (F.col("r") * 60).cast("string"))),
              ("Date", F.col("ts").cast("string")), ("ETag", tag), ("Last-Modified", changed),
              ("Server", F.when(~F.col("full"), F.lit("edge")))]
    headers = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in fields]),
                       lambda h: h["value"].isNotNull())
    return (rows.withColumn("full", full).withColumn("ts", ts.cast("long"))
            .select((F.col("page_id") * ROUNDS + F.col("r")).alias("record_id"), spelled.alias("url"), "ts",
                    F.when(F.col("full"), "response").otherwise("revisit").alias("type"),
                    F.when(F.col("full"), 200).otherwise(304).alias("status"), headers.alias("headers"),
                    F.when(F.col("full"), F.sha2(F.concat(F.col("d"), F.col("gen").cast("string")), 256))
                    .alias("payload_sha256")))


def digest(resolved: DataFrame) -> DataFrame:
    """``resolve_revisits`` with the merged headers as lines of text."""
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return resolved.withColumn("headers", lines)
