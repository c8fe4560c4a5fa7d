"""Run registered queries against their DuckDB oracles and compare results.

Used by the tests and as a command line check::

    python -m shopguard.plans.verify /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import os
import time

import pandas as pd

# SHOPGUARD_EXACT=1 compares doubles bit for bit instead of rounded to 6 places.
EXACT = os.environ.get("SHOPGUARD_EXACT") == "1"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        return repr(v) if EXACT else f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if isinstance(v, (dt.datetime, dt.date)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_norm(x)) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return str(v)
    return str(v)


def fingerprint(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(str(_norm(r[c])) for c in cols)
                  for r in pdf[cols].astype(object).to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), cols, h


def compare(spark, name: str, sf_dir: str, con=None, show_diff: int = 5) -> dict:
    from shopguard.plans.catalog import REGISTRY, _load_all

    _load_all()
    q = REGISTRY[name]
    t0 = time.time()
    spark_pdf = q.build(spark, sf_dir).toPandas()
    t1 = time.time()
    out = {"name": name, "spark_rows": len(spark_pdf), "spark_sec": round(t1 - t0, 2)}
    if not q.oracle:
        out["status"] = "no-oracle"
        return out
    con = con or duck(sf_dir)
    duck_pdf = con.execute(q.oracle).fetchdf()
    n1, c1, h1 = fingerprint(spark_pdf)
    n2, c2, h2 = fingerprint(duck_pdf)
    out.update(duck_rows=n2, cols_match=c1 == c2, hash_match=h1 == h2)
    out["status"] = "ok" if (n1 == n2 and c1 == c2 and h1 == h2) else "MISMATCH"
    if out["status"] != "ok":
        out["spark_cols"], out["duck_cols"] = c1, c2
        if c1 == c2:
            a = {"|".join(str(_norm(r[c])) for c in c1) for r in spark_pdf[c1].astype(object).to_dict("records")}
            b = {"|".join(str(_norm(r[c])) for c in c2) for r in duck_pdf[c2].astype(object).to_dict("records")}
            out["only_spark"] = sorted(a - b)[:show_diff]
            out["only_duck"] = sorted(b - a)[:show_diff]
    return out


def main(argv: list[str]) -> int:
    from shopguard.plans.catalog import REGISTRY, _load_all
    from shopguard.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    _load_all()
    names = argv[1:] or list(REGISTRY)
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue with the next query
            r = {"name": n, "status": "ERROR", "error": str(e).splitlines()[0][:300]}
        bad += r["status"] not in ("ok", "no-oracle")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
