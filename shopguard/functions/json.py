"""JSON column expressions over payload text, built on Spark's VARIANT type.

All functions return ``Column`` objects, so they stay inside whole-stage
codegen and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "BOOLEAN")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def variant_type(v: Column) -> Column:
    """Spark type name of a variant value (``ARRAY<..>``, ``STRING``, ``VOID``...)."""
    return F.schema_of_variant(v)


def pg_type_name(t: Column) -> Column:
    """Map a variant type name to the Postgres ``jsonb_typeof`` vocabulary."""
    return (F.when(t.startswith("ARRAY"), F.lit("array"))
            .when(t.startswith("OBJECT"), F.lit("object"))
            .when(t == "STRING", F.lit("string"))
            .when(t == "VOID", F.lit("null"))
            .when(t == "BOOLEAN", F.lit("boolean"))
            .when(t.isNotNull(), F.lit("number")))


def json_typeof(payload, path: str) -> Column:
    """``jsonb_typeof(payload -> key)``: NULL when the key is missing, 'null' for JSON null."""
    v = F.try_variant_get(F.try_parse_json(_c(payload)), path, "variant")
    return pg_type_name(variant_type(v))


def json_text(payload, path: str) -> Column:
    """``payload ->> key`` for scalar values."""
    return F.get_json_object(_c(payload), path)


def is_number(t: Column) -> Column:
    """Variant types that Python treats as numbers (bool is an int in Python)."""
    return t.isin(*_NUMERIC) | t.startswith("DECIMAL")


def _err(kind: str | None, key: str | None) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("error_type"),
                    F.lit(key).cast("string").alias("error_key"))


def _element_error(x: Column) -> Column:
    """First failing step of the enrichment loop body for one items element."""
    et = F.coalesce(variant_type(x), F.lit("VOID"))
    qt = variant_type(F.try_variant_get(x, "$.qty", "variant"))
    pt = variant_type(F.try_variant_get(x, "$.unit_price_cents", "variant"))
    st = variant_type(F.try_variant_get(x, "$.sku", "variant"))
    return (F.when(~et.startswith("OBJECT"), _err("TypeError", "qty"))
            .when(qt.isNull(), _err("KeyError", "qty"))
            .when(pt.isNull(), _err("KeyError", "unit_price_cents"))
            .when(~is_number(qt), _err("TypeError", "qty"))
            .when(~is_number(pt), _err("TypeError", "unit_price_cents"))
            .when(st.isNull(), _err("KeyError", "sku")))


def payload_error(payload, parsed: Column | None = None) -> Column:
    """T1 as one column expression: the exception the order service raises for
    a payload, or NULLs when ok (``struct<error_type, error_key>``).

    Python truthiness and iteration rules decide: a falsy payload reads as
    ``{}``; a string ``items`` iterates characters; a dict iterates keys; inside
    a list the first failing element decides. ``with_payload_error`` computes
    the same result with shared subexpressions staged as columns (faster).
    """
    p = _c(payload)
    v = F.try_parse_json(p) if parsed is None else parsed
    items = F.try_variant_get(v, "$.items", "variant")
    return _payload_error(p, v, variant_type(v), items, variant_type(items))


def _payload_error(p: Column, v: Column, pt: Column, items: Column, it: Column) -> Column:
    falsy_scalar = ((F.size(F.try_variant_get(v, "$", "array<variant>")) == 0)
                    | ((pt == "STRING") & (F.try_variant_get(v, "$", "string") == ""))
                    | (is_number(pt) & (F.try_variant_get(v, "$", "double") == 0)))
    elements = F.try_variant_get(items, "$", "array<variant>")
    first_bad = F.get(F.filter(F.transform(elements, _element_error), lambda e: e.isNotNull()), 0)
    ok = _err(None, None)
    return (F.when(p.isNotNull() & v.isNull(), _err("ValueError", "payload"))
            .when(p.isNull() | (pt == "VOID") | (pt == "OBJECT<>"), _err("KeyError", "items"))
            .when(~pt.startswith("OBJECT"),
                  F.when(falsy_scalar, _err("KeyError", "items")).otherwise(_err("TypeError", "payload")))
            .when(it.isNull(), _err("KeyError", "items"))
            .when(it == "STRING",
                  F.when(F.try_variant_get(items, "$", "string") == "", ok)
                  .otherwise(_err("TypeError", "qty")))
            .when(it.startswith("OBJECT"),
                  F.when(it == "OBJECT<>", ok).otherwise(_err("TypeError", "qty")))
            .when(~it.startswith("ARRAY"), _err("TypeError", "items"))
            .otherwise(F.coalesce(first_bad, ok)))


def with_payload_error(df, payload: str = "payload", out: str = "_err", parsed: str = "_v"):
    """Add ``parsed`` (the payload as VARIANT) and ``out`` (the T1 struct).

    Each shared subexpression (the parse, the payload's type, ``items`` and its
    type) is its own projected column, so it is computed once per row instead
    of once per reference.
    """
    staged = (df.withColumn(parsed, F.try_parse_json(payload))
              .withColumn("_pt", variant_type(F.col(parsed)))
              .withColumn("_items", F.try_variant_get(F.col(parsed), "$.items", "variant"))
              .withColumn("_it", variant_type(F.col("_items"))))
    from shopguard.operators.common import evaluate_once

    err = _payload_error(F.col(payload), F.col(parsed), F.col("_pt"), F.col("_items"), F.col("_it"))
    done = staged.withColumn(out, err).withColumn("items_type", pg_type_name(F.col("_it"))) \
        .drop("_pt", "_items", "_it")
    return evaluate_once(done, out, "items_type", parsed)


def variant_typeof(v: Column, path: str) -> Column:
    """``jsonb_typeof`` at ``path`` of an already parsed VARIANT column."""
    return pg_type_name(variant_type(F.try_variant_get(v, path, "variant")))


# Python keeps fractions, so quantities and prices are doubles (exact for integers below 2^53).
LINE_TYPE = "array<struct<sku:string,qty:double,unit_price_cents:double>>"


def payload_lines(payload, parsed: Column | None = None) -> Column:
    """Typed order lines of a contract-valid payload; empty for ``""``/``{}``/``[]``."""
    v = F.try_parse_json(_c(payload)) if parsed is None else parsed
    lines = F.try_variant_get(v, "$.items", LINE_TYPE)
    return F.coalesce(lines, F.array().cast(LINE_TYPE))
