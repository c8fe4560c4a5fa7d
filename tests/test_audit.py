"""Audit evidence: the decision words against a regular expression."""

import re

from pyspark.sql import functions as F

from shopguard.operators import audit

TEXTS = ["", None, "ALLOWED", "deNied by policy", "Not Permitted", "not  permitted", "DENİED", "KDENYÉ", "x" * 5000 + "Forbid"]


def test_decision_words_match_like_the_regex(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for pattern in ("denied|deny|forbid|not permitted", "allow|permit|success", "den(ied|y)", "k|i"):
        got = [r.m for r in df.select(F.coalesce(audit.matches_decision(F.col("t"), pattern), F.lit(False)).alias("m")).collect()]
        assert got == [bool(t) and re.search(pattern, t, re.IGNORECASE | re.ASCII) is not None for t in TEXTS], pattern
