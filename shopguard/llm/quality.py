"""Quality classifier with hierarchical empirical Bayes site evidence.

A logistic model of text features gives each document's own evidence. Hosts
and the paths below them get posterior means of their documents' quality: a
path is shrunk toward its host and a host toward the global prior, with
strengths estimated from how much the sites really differ (method of moments
over grouped aggregates), so a sparse site says little. A document's evidence
is combined with the posterior of its path from which the document itself is
left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import join_weighted, written

# Labelled documents the classifier is fitted on at most: those with the smallest id hashes.
TRAINING_ROWS = 20_000
FEATURES = ("log_words", "distinct_words", "repeated_next", "top_word", "symbols", "upper", "digits",
            "bare_symbols", "symbol_ends", "distinct_lines", "word_length")
_SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0x80, 0x100)])
_SYMBOL_END = re.compile(rb"[!-/:-@\[-`{-~]{2,}(?=[\x09-\x0d\x20]|$)")
_BARE_SYMBOL = re.compile(rb"(?<![!-~\x80-\xff])[!-/:-@\[-`{-~]+(?![!-~\x80-\xff])")


def features(raw: bytes) -> list[float]:
    """The features of one whole text (UTF-8); an empty text has zeros and full distinctness."""
    words = raw.split()
    n = len(words)
    if n == 0:
        return [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    size = sum(map(len, words))
    letters = size - len(raw.translate(None, _LETTERS)) + (len(raw) - size)
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / size

    # Distinctness falls with length in any prose; it is measured against the length's square root.
    return [float(np.log1p(n)), min(1.0, len(counts) / (4.0 * n ** 0.75 + 1e-9) if n > 256 else len(counts) / n),
            sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, share(_SYMBOLS),
            (len(raw) - len(raw.translate(None, _UPPER))) / max(1, letters), share(_DIGITS),
            len(_BARE_SYMBOL.findall(raw)) / n, len(_SYMBOL_END.findall(raw)) / n,
            len(set(lines)) / max(1, len(lines)), size / n / 10.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps: weights of the raw features, then the intercept.

    With no rows, or one class only, the weights are zero and the intercept
    is the smoothed log-odds of the labels.
    """
    n, d = x.shape
    prior = np.log((y.sum() + 1.0) / (n - y.sum() + 1.0)) if n else 0.0
    if n == 0 or y.min() == y.max():
        return np.append(np.zeros(d), prior)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / sd, np.ones(n)])
    w = np.append(np.zeros(d), prior)
    penalty = np.append(np.full(d, ridge), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty),
                               z.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / sd
    return np.append(raw, w[-1] - (raw * mean).sum())


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _strength(groups: DataFrame, n: str, mean: str, about: Column) -> float:
    """Prior sample size of a Beta prior, by the method of moments over groups.

    ``about`` is the mean a group is shrunk toward. What the group means vary
    beyond their sampling variance is the variance of the prior; if that is
    nothing, the groups are alike and the strength is large.
    """
    v = about * (1 - about)
    row = groups.agg(F.sum(n).alias("n"),
                     F.sum(F.col(n) * (F.col(mean) - about) ** 2).alias("ss"),
                     F.sum(v).alias("noise"), F.sum(F.col(n) * v).alias("v")).first()
    if not row.n:
        return 1.0
    between = max((row.ss - row.noise) / row.n, 1e-9)
    return float(min(max(row.v / row.n / between - 1.0, 1.0), 1e6))


def _evidence(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str,
              path_col: str, training_rows: int) -> DataFrame:
    """Written table of one narrow row per document with its own evidence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t or b"") for t in b.column(4).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)),
                                              pa.array(found, pa.list_(pa.float64()))],
                                             names=["doc_id", "text_hash", "host", "path", "f"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       _key(F.col(host_col)).alias("host"), _key(F.col(path_col)).alias("path"),
                       F.col(text_col).alias("t"))
    table = written(rows.mapInArrow(run, "doc_id long, text_hash long, host string, path string, f array<double>"),
                    "quality-features")
    # A bounded sample of the labels (a few thousand rows at most) is joined and fitted on the driver.
    sample = (labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("doc_id")).agg(F.min("quality").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows))
    # An id that repeats in the table counts once, so the sample bounds what reaches the driver.
    train = (table.join(F.broadcast(sample), "doc_id").groupBy("doc_id")
             .agg(F.min("f").alias("f"), F.min("y").alias("y")).orderBy("doc_id").collect())
    x = np.array([r.f for r in train], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in train], dtype=float)
    w = fit_logistic(x, y)
    logit = F.lit(float(w[-1]))
    for i, wi in enumerate(w[:-1]):
        logit = logit + F.lit(float(wi)) * F.col("f")[i]
    base = float(np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0)))
    return table.select("doc_id", "text_hash", "host", "path", F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))
                        .alias("logit")) \
        .select("doc_id", "text_hash", "host", "path", (F.col("logit") - F.lit(base)).alias("evidence"),
                (1 / (1 + F.exp(-F.col("logit")))).alias("p_text"))


def site_posteriors(rows: DataFrame, p: str = "p_text") -> tuple[DataFrame, dict[str, float]]:
    """Per path ``(host, path, n, s, host_n, host_s)`` and the hyperparameters of the hierarchy.

    ``n`` documents with summed probability ``s``. All sums are grouped
    aggregates over every document; only the prior and the two strengths come
    to the driver.
    """
    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")),
                    "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"),
                                              F.count(F.lit(1)).alias("n_paths")), "quality-hosts")
    n, s, n_paths = hosts.agg(F.sum("host_n"), F.sum("host_s"), F.sum("n_paths")).first()
    prior = (s + 1.0) / (n + 2.0) if n else 0.5
    host_k = _strength(hosts.withColumn("m", F.col("host_s") / F.col("host_n")), "host_n", "m", F.lit(prior))
    # One host may hold most paths: weighted by its number of paths.
    both = join_weighted(paths, hosts, ["host"], "n_paths", max(n_paths or 0, 1), "inner")
    shrunk = (F.col("host_s") + host_k * prior) / (F.col("host_n") + host_k)
    path_k = _strength(both.withColumn("m", F.col("s") / F.col("n")), "n", "m", shrunk)
    return both, {"prior": float(prior), "host_k": host_k, "path_k": path_k}


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", path_col: str = "lang", threshold: float = 0.5,
          training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: ``doc_id, text_hash, p_text, p_host, p_path, p_quality, kept``.

    ``p_text`` is the classifier alone, ``p_host`` and ``p_path`` the shrunk
    posteriors without the document itself, ``p_quality`` all of them
    combined; ``kept`` is ``p_quality >= threshold``. A NULL text counts as
    empty, a NULL host or path is a site of its own, repeated rows come back as
    often as they went in, other columns play no part and an empty table gives
    an empty result. Labels other than 0 and 1 are ignored; without usable
    labels the text says nothing and all documents score the prior.
    """
    rows = _evidence(docs, labels, id_col, text_col, host_col, path_col, training_rows)
    sites, k = site_posteriors(rows)
    total = rows.count()
    joined = join_weighted(rows, sites.withColumn("_weight", F.col("n")), ["host", "path"], "_weight",
                           max(total, 1), "inner")
    p_host = (F.col("host_s") - F.col("p_text") + k["host_k"] * k["prior"]) / (F.col("host_n") - 1 + k["host_k"])
    p_path = (F.col("s") - F.col("p_text") + k["path_k"] * F.col("p_host")) / (F.col("n") - 1 + k["path_k"])
    return (joined.withColumn("p_host", p_host).withColumn("p_path", p_path)
            .withColumn("p_quality", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("p_path"))))))
            .select("doc_id", "text_hash", *[F.round(c, 9).alias(c) for c in ("p_text", "p_host", "p_path", "p_quality")],
                    (F.col("p_quality") >= F.lit(threshold)).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    bad = (score(docs, labels, id_col, text_col, host_col, path_col, threshold).where("NOT kept")
           .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id"))
                     & (F.xxhash64(F.col(text_col)) == F.col("__hash")), "left_anti")
