"""Revisit resolution against a plain loop over each revisit."""

import random

from pyspark.sql import functions as F

from shopguard.llm import warc

SCHEMA = ("record_id long, url string, ts long, type string, status int, headers array<struct<name:string,value:string>>, "
          "payload_sha256 string, part int, base string")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA)


def brute(rows, key):
    def get(headers, name):
        return next((v for n, v in headers or [] if n.lower() == name), None)

    out = []
    for rid, url, ts, kind, _, headers, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and r[4] == 200 and key[url] is not None and key[r[1]] == key[url]
                  and r[2] is not None and ts is not None and r[2] < ts]
        if key[url] is None or not before:
            out.append((rid, "no_url" if key[url] is None else "no_earlier_response", None, None, None, None))
            continue
        base = max(before, key=lambda r: (r[2], r[0]))
        tags = [(get(h, "etag") or "").removeprefix("W/") if get(h, "etag") is not None else None for h in (base[5], headers)]
        dates = [get(h, "last-modified") for h in (base[5], headers)]
        kind = "etag" if None not in tags else "last_modified" if None not in dates else "none"
        ok = tags[0] == tags[1] if kind == "etag" else dates[0] == dates[1] if kind == "last_modified" else True
        fresh = [(n, v) for n, v in headers or [] if n.lower() in warc.PERMITTED]
        merged = sorted((n.lower(), v) for n, v in [*[(n, v) for n, v in base[5] or []
                                                      if n.lower() not in {m.lower() for m, _ in fresh}], *fresh])
        out.append((rid, "resolved" if ok else "validator_mismatch", kind, base[0], merged if ok else None,
                    base[6] if ok else None))
    return sorted(out, key=repr)


def check(spark, rows):
    df = frame(spark, rows)
    key = {r.url: r.k for r in df.select("url", warc.canonical_url(F.col("url")).alias("k")).collect()}
    got = sorted(((r.record_id, r.state, r.validator, r.base_id,
                   None if r.headers is None else [tuple(h) for h in r.headers], r.payload_sha256)
                  for r in warc.resolve_revisits(df).collect()), key=repr)
    assert got == brute(rows, key)


def test_canonical_url(spark):
    alike = ["http://www.a.example/x/?b=1&a=2", "HTTPS://A.example:443/x?a=2&utm_source=q&b=1#top", " http://u@a.example/x/?a=2&&b=1 "]
    other = ["http://a.example/X?a=2&b=1", "http://a.example:81/x?a=2&b=1", "mailto:x", "", None]
    df = spark.createDataFrame([(u,) for u in alike + other], "url string")
    keys = [r.k for r in df.select(warc.canonical_url(F.col("url")).alias("k")).collect()]
    assert set(keys[:3]) == {"a.example/x?a=2&b=1"} and len(set(keys[2:])) == 6
    assert keys[-3:] == ["mailto:x", "", None]


def test_random_logs_and_a_hot_url(spark):
    rng = random.Random(1)
    rows = []
    for i in range(2500):
        hot = i % 3 == 0
        url = "http://hot.example/" if hot else f"https://h{rng.randint(0, 40)}.example/p{rng.randint(0, 5)}"
        full = rng.random() < (0.02 if hot else 0.3)
        headers = [("ETag", rng.choice(['"a"', 'W/"a"', '"b"']))] if rng.random() < 0.6 else []
        headers += [("Last-Modified", rng.choice(["x", "y"]))] if rng.random() < 0.6 else []
        headers += [("X-Own", "1"), ("cache-control", str(i)), ("Content-Length", "0")]
        rows.append((i, url, rng.randint(0, 600), "response" if full else "revisit", 200 if rng.random() < 0.9 else 500,
                     headers, f"d{i}" if full else None))
    check(spark, rows)


def test_edge_rows(spark):
    h = [("ETag", '"1"')]
    rows = [(1, None, 5, "revisit", 304, h, None), (2, "http://a/", None, "revisit", 304, h, None),
            (3, "http://a/", None, "response", 200, h, "p"), (4, "http://a/", 10, "response", 200, None, "q"),
            (5, "http://a/", 10, "revisit", 304, h, None), (6, "http://a", 11, "revisit", 304, None, None),
            (6, "http://a", 11, "revisit", 304, None, None), (7, "http://a/", 10, "response", 200, h, "r" * 100000),
            (8, "http://a/", 12, "request", 200, h, None), (9, None, 1, "response", 200, h, "s"),
            (None, "http://a/", 13, "revisit", None, [("Vary", "v"), ("vary", "w"), ("X", None)], None)]
    check(spark, rows)
    assert warc.resolve_revisits(frame(spark, rows).limit(0)).count() == 0


def test_page_captures_have_every_state(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    states = {r.state for r in warc.resolve_revisits(warc.captures_of_pages(pages)).collect()}
    assert states == {"resolved", "validator_mismatch", "no_earlier_response"}
