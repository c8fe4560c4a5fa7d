"""Typed table scans.

Every read declares its schema, so no file is sampled for inference and
Catalyst can prune columns and push filters into the Parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
TS = T.TimestampNTZType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Driver tables (TPC-H-like star plus events and text tables).
DRIVER_SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                        ("c_acctbal", D), ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                    ("p_size", I), ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                      ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                        ("l_linenumber", I), ("l_quantity", D), ("l_extendedprice", D),
                        ("l_discount", D), ("l_tax", D), ("l_returnflag", S),
                        ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S),
                      ("value", D), ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "labels": _schema(("doc_id", L), ("quality", I), ("toxic", I)),
    "pages": _schema(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _schema(("item_id", L), ("text", S)),
    "embeddings": _schema(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I)),
    "conversations": _schema(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}

# Reference tables (shop database, audit log); see SURVEY section 1.2.
CUSTOMERS_RAW = _schema(("id", L), ("name", S), ("email", S), ("phone", S),
                        ("created_at", TS), ("tier", S))
ORDERS = _schema(("id", L), ("customer_id", L), ("sku", S), ("qty", I), ("amount_cents", L),
                 ("status", S), ("created_at", TS), ("payload", S))
PAYMENTS = _schema(("id", L), ("order_id", L), ("last4", S), ("processor_ref", S),
                   ("amount_cents", L))
POISON_BACKUP = _schema(("id", L), ("status", S), ("payload", S), ("created_at", TS),
                        ("backed_up_at", TS))
AUDIT_COLUMNS = ["id", "timestamp", "account_id", "account_email", "account_first_name",
                 "account_last_name", "resource_id", "resource_name", "resource_type",
                 "remote_identity_username", "query_body", "query_hash", "duration",
                 "record_count", "authorization", "error", "source_ip", "client_ip",
                 "user_agent", "egress_node_id"]
AUDIT = T.StructType([T.StructField(c, S, True) for c in AUDIT_COLUMNS]
                     + [T.StructField("encrypted", T.BooleanType(), True),
                        T.StructField("capture", S, True)])


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str,
               schema: T.StructType | None = None) -> DataFrame:
    """Scan one Parquet table with its declared schema.

    The scan keeps the layout of the files; a caller that needs another
    partitioning repartitions what it reads.
    """
    return spark.read.schema(schema or DRIVER_SCHEMAS[name]).parquet(table_path(sf_dir, name))
