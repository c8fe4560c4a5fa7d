import importlib


def test_entry_smoke(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["status", "row_count", "oldest", "newest", "malformed_payloads"]
    by = {r["status"]: r for r in rows}
    # The fault scenario: 400 poisoned rows, of which the health view counts 300.
    assert by["PENDING_RECONCILE"]["row_count"] == 400
    assert by["PENDING_RECONCILE"]["malformed_payloads"] == 300


def test_contract_functions_agree():
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
