"""Versions of several tables switch together; repairs and retention rewrite only the files they touch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from shopguard import RECONCILE_BATCH
from shopguard.operators import lifecycle as lc
from shopguard.operators import orders as od
from shopguard.operators import versions as vs
from shopguard.operators.numbering import Ranges
from shopguard.session import scratch_path
from shopguard.sources import bindings as b


@pytest.fixture
def data(spark):
    return vs.Dataset(spark, scratch_path(spark, "versions"))


def _frame(spark, lo, hi, v="a"):
    return spark.range(lo, hi).withColumn("v", F.lit(v))


def test_a_writer_that_stops_between_tables_changes_nothing(spark, data):
    assert data.version() == 0 and data.manifest() == {}
    one = data.replace({"a": _frame(spark, 0, 5), "b": _frame(spark, 0, 3)})
    data.write("a", _frame(spark, 0, 50))                      # stops before b and the commit
    assert data.version() == one and data.read("a").count() == 5 and data.read("b").count() == 3
    two = data.replace({"a": _frame(spark, 0, 7)})
    assert (data.read("a").count(), data.read("b").count(), data.read("a", one).count()) == (7, 3, 5)
    with pytest.raises(RuntimeError, match="another writer"):
        data.commit(data.manifest(), one)
    assert data.version() == two


def test_restore_switches_all_tables_and_copies_no_file(spark, data):
    tables = {n: _frame(spark, 0, k + 2) for k, n in enumerate(("customers", "orders", "payments"))}
    first = data.replace(tables)
    data.replace({"orders": _frame(spark, 0, 99, "bad"), "poison_backup": _frame(spark, 0, 4)})
    vs.restore_version(data, first)
    assert [data.read(n).count() for n in (*tables, "poison_backup")] == [2, 3, 4, 0]
    assert data.manifest()["orders"] == data.manifest(first)["orders"]
    with pytest.raises(FileNotFoundError):
        vs.restore_version(vs.Dataset(spark, scratch_path(spark, "versions")), 1)


def test_repair_rewrites_only_the_files_of_the_victims(spark, data):
    clean = b.shop_orders(spark, SMALL)
    poisoned, backup = lc.poison_with_backup(clean, n=40)
    data.replace({"orders": poisoned.repartitionByRange(6, "id"), "poison_backup": backup})
    before = data.manifest()["orders"]["files"]
    holding = {r["_file"] for r in data.with_file("orders").where(lc.batch_predicate()).select("_file").distinct().collect()}
    assert 0 < len(holding) < len(before)
    vs.repair_version(data, RECONCILE_BATCH)
    after = data.manifest()["orders"]["files"]
    assert {f for f in before if f.rsplit("/", 1)[1] not in holding} <= set(after)
    assert not [f for f in after if f.rsplit("/", 1)[1] in holding]
    assert lc.multiset_diff(data.read("orders"), clean).first().equal
    version = data.version()
    assert vs.repair_version(data, RECONCILE_BATCH) == version      # nothing left to repair


def test_retention_keeps_later_days_by_reference(spark, data):
    start = dt.datetime(2024, 1, 1)
    rows = [(p, start + dt.timedelta(hours=6 * i)) for i in range(40) for p in ("audit", "results")]
    df = spark.createDataFrame(rows, "prefix string, ts timestamp_ntz").withColumn("day", F.col("ts").cast("date"))
    data.replace({"log": df.repartitionByRange("prefix", "day")}, {"log": ["prefix", "day"]})
    before = set(data.manifest()["log"]["files"])
    cut = {"audit": start + dt.timedelta(days=3, hours=7), "results": start + dt.timedelta(days=8)}
    vs.expire(data, "log", {p: F.lit(c).cast("timestamp_ntz") for p, c in cut.items()})
    got = sorted((r.prefix, r.ts) for r in data.read("log").collect())
    assert got == sorted(r for r in rows if r[1] >= cut[r[0]])
    new = {f for f in data.manifest()["log"]["files"] if f not in before}
    assert new and all("day=2024-01-04" in f or "day=2024-01-09" in f for f in new)


@pytest.fixture
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_a_deep_page_reads_one_range(spark, many_ranges):
    df = spark.range(20_000).select(F.col("id"), F.lit("x").alias("status"),
                                    (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(
                                        secs=F.col("id") % 100)).alias("created_at"))
    want = [r.id for r in df.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    for offset, limit in ((0, 25), (9_990, 200), (19_990, 25), (30_000, 5)):
        assert [r.id for r in od.deep_page(df, limit, offset).collect()] == want[offset:offset + limit]
    with pytest.raises(ValueError):
        od.page(df, 25, od.MAX_OFFSET + 1)
    ranges = Ranges(df, [("id", True)])
    assert len(ranges.counts) > 1
    assert [r.rn for r in ranges.numbered().orderBy("id").select("rn").collect()] == list(range(1, 20_001))


def test_a_silence_of_ten_years_is_one_row_until_the_end(spark):
    from shopguard.operators import metrics as mt

    t0, years = dt.datetime(2014, 1, 1), 10 * 365 * 86400
    df = spark.createDataFrame([("r", t0, 0.9), ("r", t0 + dt.timedelta(seconds=years), 0.9)],
                               "rule string, eval_ts timestamp_ntz, value double")
    out = mt.alert_states(df, 0.05, 3600, 3600)
    got = out.groupBy("state").count().collect()
    assert {r.state: r["count"] for r in got} == {"pending": 2, "inactive": years // 3600 - 1}
    last = out.where("breach").orderBy(F.desc("eval_ts")).first()
    assert last.island == years // 3600 - 1 and last.breach_started == last.eval_ts
