"""Registry of named queries: a Spark builder plus (where SQL can say it) an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from shopguard.plans.sql import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    oracle: str | None
    ops: tuple[str, ...] = field(default_factory=tuple)
    bench: bool = False


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str | tuple[str, ...] = (), oracle: str | None = None,
             bench: bool = False):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    if isinstance(ops, str):
        ops = (ops,)

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, with_views(oracle) if oracle else None, ops, bench)
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules fills REGISTRY.
    from shopguard.plans import alerting, analytics, generation, governance, operations, shop, streams  # noqa: F401
    from shopguard.plans import readiness  # noqa: F401  (reads the others' oracles)


def prepare(spark: SparkSession) -> None:
    """Settings every query relies on, applied to whatever session runs it.

    Event-time work (epoch seconds, watermarks) casts TIMESTAMP_NTZ through the
    session time zone, so the zone is pinned to UTC; reliable checkpoints and
    stream checkpoints need ``spark.checkpoint.dir``.
    """
    from shopguard.session import checkpoint_dir

    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)


def _prepared(build: Builder) -> Builder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return build(spark, sf_dir)

    run.__name__ = getattr(build, "__name__", "query")
    run.__doc__ = build.__doc__
    return run


def queries() -> dict[str, Builder]:
    _load_all()
    return {n: _prepared(q.build) for n, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {n: q.oracle for n, q in REGISTRY.items() if q.oracle}
