"""Order payload contract: classification, enrichment, health and error taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopguard.functions.json import json_typeof, payload_lines, with_payload_error

# Fixed value: the five statuses the generator seeds.
KNOWN_STATUSES = ("PENDING", "SHIPPED", "DELIVERED", "CANCELLED", "REFUNDED")


def order_health(orders: DataFrame) -> DataFrame:
    """A1 ``order_health``: per status count, oldest, newest and malformed payloads.

    Malformed means ``jsonb_typeof(items) <> 'array'``, so a *missing* items key
    is not counted (NULL comparison) while a JSON null is.
    """
    t = json_typeof("payload", "$.items")
    return (orders.groupBy("status")
            .agg(F.count(F.lit(1)).alias("row_count"),
                 F.min("created_at").alias("oldest"),
                 F.max("created_at").alias("newest"),
                 F.count_if(t != "array").alias("malformed_payloads"))
            .orderBy(F.desc("row_count"), "status"))


def injection_summary(orders: DataFrame, status: str = "PENDING_RECONCILE") -> DataFrame:
    """A2: rows in the poisoned status, by items shape, with the id range."""
    t = json_typeof("payload", "$.items")
    return (orders.where(F.col("status") == status)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(t == "string").alias("shape_a_string_items"),
                 F.count_if(t == "array").alias("shape_b_missing_price"),
                 F.min("id").alias("min_order_id"), F.max("id").alias("max_order_id"))
            .select(F.lit("poisoned").alias("what"), "*"))


def classify_payload(orders: DataFrame, keep_parsed: bool = False) -> DataFrame:
    """Add ``error_type``, ``error_key``, ``items_type`` and ``shape``.

    ``shape`` is A (string items), B (array missing a price), ok, or other.
    """
    # Parse once; every check below reads the staged VARIANT columns.
    return (with_payload_error(orders, "payload", "_err", "_v")
            .withColumn("error_type", F.col("_err.error_type"))
            .withColumn("error_key", F.col("_err.error_key"))
            .withColumn("shape",
                        F.when(F.col("error_type").isNull(), "ok")
                        .when(F.col("items_type") == "string", "A")
                        .when((F.col("items_type") == "array")
                              & (F.col("error_key") == "unit_price_cents"), "B")
                        .otherwise("other"))
            .drop("_err", *([] if keep_parsed else ["_v"])))


def iso_text(ts: F.Column) -> F.Column:
    """A timestamp as Python's ``isoformat`` prints it: microseconds only if there are any."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))


def enrich_orders(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine). Good rows get lines, computed total, totals_match, the
    channel, the shipping object (JSON text) and the creation time as text."""
    classified = classify_payload(orders, keep_parsed=True)
    bad = classified.where(F.col("error_type").isNotNull()).drop("_v")
    v = F.col("_v")
    lines = payload_lines("payload", v)
    good = (classified.where(F.col("error_type").isNull())
            .withColumn("lines", F.transform(lines, lambda x: x.withField(
                "line_total_cents", x["qty"] * x["unit_price_cents"])))
            .withColumn("computed_total_cents",
                        F.aggregate("lines", F.lit(0.0),
                                    lambda acc, x: acc + x["line_total_cents"]))
            .withColumn("totals_match", F.col("computed_total_cents") == F.col("amount_cents"))
            .withColumn("channel", F.try_variant_get(v, "$.channel", "string"))
            .withColumn("shipping", F.to_json(F.try_variant_get(v, "$.shipping", "variant")))
            .withColumn("shipping_method", F.try_variant_get(v, "$.shipping.method", "string"))
            .drop("error_type", "error_key", "items_type", "shape", "_v"))
    if "created_at" in orders.columns:
        good = good.withColumn("created_at_text", iso_text(F.col("created_at")))
    return good, bad


def explode_lines(good: DataFrame) -> DataFrame:
    """One row per order line of enriched orders."""
    return good.select("id", F.posexplode("lines").alias("line_no", "line")) \
        .select("id", "line_no", "line.sku", "line.qty", "line.unit_price_cents",
                "line.line_total_cents")


def error_taxonomy(orders: DataFrame, path: str = "/orders") -> DataFrame:
    """Failing orders by exception type and key, with the newest example."""
    bad = classify_payload(orders).where(F.col("error_type").isNotNull())
    return (bad.groupBy("error_type", "error_key")
            .agg(F.count(F.lit(1)).alias("errors"),
                 F.max_by("id", F.struct("created_at", "id")).alias("newest_id"),
                 F.max("created_at").alias("newest_at"))
            .withColumn("path", F.lit(path)))


def recent_errors(orders: DataFrame, keep: int = 25, limit: int = 10,
                  by: str = "error_type") -> DataFrame:
    """Newest ``keep`` failing rows per group, then the first ``limit`` of them."""
    if not 1 <= limit <= keep:
        raise ValueError(f"limit must be within 1..{keep}")
    bad = classify_payload(orders).where(F.col("error_type").isNotNull())
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id"))
    return (bad.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= limit)
            .select(by, "rank", "id", "error_key", "created_at"))


def page_blast_radius(orders: DataFrame, page_size: int = 25) -> DataFrame:
    """Pages of the newest-first listing that fail because one row is malformed."""
    from shopguard.operators.numbering import global_row_number

    bad = classify_payload(orders).select("id", "created_at",
                                          F.col("error_type").isNotNull().alias("bad"))
    numbered = global_row_number(bad, [("created_at", False), ("id", False)], name="n")
    pages = (numbered.withColumn("page", F.floor((F.col("n") - 1) / page_size).cast("long"))
             .groupBy("page").agg(F.bool_or("bad").alias("fails")))
    return pages.agg(F.count(F.lit(1)).alias("pages"),
                     F.count_if("fails").alias("failing_pages"),
                     F.min(F.when(F.col("fails"), F.col("page"))).alias("first_failing_page"))
