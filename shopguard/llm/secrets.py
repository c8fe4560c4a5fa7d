"""Secret scan: fixed patterns plus a battery of randomness tests, all in Spark SQL functions.

The patterns give the base spans. Every other long token is tested for
randomness in the alphabet of the encoding it appears to be in (a run of symbols
that no encoding's alphabet fits is tested in parts, see ``_parts``): chi-squared
uniformity of its symbols, a runs test about the middle of the alphabet, and
lag-1 serial correlation. The smallest of the three p-values, adjusted for
taking the smallest of three, is the token's: uniform for a random string,
near zero for words. Short tokens give the tests little power, so the
cut-off is set per encoding and length class to hold the share of false
discoveries at ``fdr``: random tokens are spread evenly over [0, 1], so their
number is read off the upper half, and whatever exceeds that share below is
taken for words.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import written

# The kinds in their order and the patterns of the base spans.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# A maximal run that is long enough: the same as matching the run and dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
# Runs of one encoding, and what parts of other runs are made of: first what ``=`` parts (one at the end
# is padding), then, where that holds both '+' or '/' and '-' or '_', the runs of either alphabet and of both.
FITS = r"^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"
BETWEEN_EQUALS = r"[A-Za-z0-9+/_-]+(?:=+$)?"
NARROWER = (r"[A-Za-z0-9_-]+(?:=+$)?", r"[A-Za-z0-9+/]+(?:=+$)?", r"[A-Za-z0-9]+(?:=+$)?")
TOKEN_LENGTH = 20
FDR = 0.1
LEAST_P = 0.01              # a token that its own battery rejects at this level is never a secret
BINS = 20
FEW = 20                    # distinct tokens under which a stratum is too thin for a cut-off of its own
RANDOM = "random"

# Encodings in order of inference: name, what a token of it looks like, its alphabet.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", string.digits),
    ("hex", r"^[0-9a-f]+$", string.digits + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", string.digits + "ABCDEF"),
    ("lower", r"^[a-z]+$", string.ascii_lowercase),
    ("base32", r"^[A-Z2-7]+=*$", string.ascii_uppercase + "234567"),
    ("base36", r"^[a-z0-9]+$", string.ascii_lowercase + string.digits),
    ("base62", r"^[A-Za-z0-9]+$", string.ascii_letters + string.digits),
    ("base64", r"^[A-Za-z0-9+/]+=*$", string.ascii_letters + string.digits + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", string.ascii_letters + string.digits + "_-"),
)

_POSITIONS = "array<struct<start:int,end:int,hit:string>>"
_FAR = 2 ** 31 - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each element of an integer array, ``op`` over all elements before it (``zero`` for the first).

    An array grows by copying it, so results are gathered in blocks of about the square root of the length:
    a text of n matches costs n times that root, not n squared.
    """
    empty = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def gather(arr: Column) -> Column:
        return F.aggregate(arr, F.struct(F.lit(zero).alias("at"), empty.alias("out")), step)

    def blocked(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        within = F.transform(F.sequence(F.lit(1), F.size(v), width), lambda i: gather(F.slice(v, i, width)))
        return _let(within, lambda w: F.flatten(F.zip_with(
            w, gather(F.transform(w, lambda x: x["at"]))["out"],
            lambda x, before: F.transform(x["out"], lambda o: op(before, o)))))

    return _let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(empty))


def match_positions(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``start, end`` (code points, end exclusive) and ``hit``.

    The pieces between the matches give the offsets. A text without a match costs one search.
    """
    def place(found: Column) -> Column:
        sizes = F.transform(found, lambda m: m["gap"] + F.length(m["hit"]))
        return F.zip_with(found, running(sizes, lambda x, y: x + y, 0), lambda m, at: F.struct(
            (at + m["gap"]).alias("start"), (at + m["gap"] + F.length(m["hit"])).alias("end"), m["hit"].alias("hit")))

    pieces = F.split(text, pattern, -1)
    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.zip_with(
        F.slice(pieces, 1, F.size(hits)), hits, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("hit"))))
    return F.when(text.rlike(pattern), _let(found, place)).otherwise(F.array().cast(_POSITIONS))


def apart_from(tokens: Column, base: Column) -> Column:
    """The tokens that overlap none of the base spans: in the order of starts, no base span before a token reaches
    into it and the next one starts behind it."""
    def mark(m: Column, is_token: bool) -> Column:
        hit = m["hit"] if is_token else F.lit(None).cast("string")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), hit.alias("hit"))

    def pick(both: Column) -> Column:
        reach = running(F.transform(both, lambda m: F.when(m["hit"].isNull(), m["end"]).otherwise(0)), F.greatest, 0)
        ahead = F.reverse(running(F.transform(F.reverse(both), lambda m: F.when(m["hit"].isNull(), m["start"])
                                              .otherwise(_FAR)), F.least, _FAR))
        seen = F.zip_with(both, F.zip_with(reach, ahead, lambda x, y: F.struct(x.alias("reach"), y.alias("ahead"))),
                          lambda m, o: F.struct(m.alias("m"), o["reach"].alias("reach"), o["ahead"].alias("ahead")))
        free = F.filter(seen, lambda x: x["m"]["hit"].isNotNull() & (x["reach"] <= x["m"]["start"])
                        & (x["ahead"] >= x["m"]["end"]))
        return F.transform(free, lambda x: x["m"])

    both = F.array_sort(F.concat(F.transform(tokens, lambda m: mark(m, True)), F.transform(base, lambda m: mark(m, False))))
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(_let(both, pick))


def outermost(hits: Column) -> Column:
    """The hits (no two alike) that lie in no other one: by start, longest first, none before reaches as far."""
    def pick(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda m: m["end"]), F.greatest, 0)
        seen = F.zip_with(ordered, reach, lambda m, o: F.struct(m.alias("m"), o.alias("reach")))
        return F.transform(F.filter(seen, lambda x: x["reach"] < x["m"]["end"]), lambda x: F.struct(
            x["m"]["start"].alias("start"), x["m"]["end"].alias("end")))

    spans = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m["end"].alias("end")))
    return _let(F.array_sort(spans), pick)


def _spans(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                                                 m["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """The pattern matches that pass their length checks, by start, then kind."""
    assign = F.filter(match_positions(text, ASSIGN),
                      lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= ASSIGN_VALUE)
    parts = [assign, match_positions(text, ACCESS), match_positions(text, HEX)]
    return F.array_sort(F.concat(*[_spans(c, i, k) for i, (c, k) in enumerate(zip(parts, KINDS))]))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (Abramowitz and Stegun 7.1.26, error below 1e-7)."""
    x = F.abs(z) / F.lit(2 ** 0.5)
    t = 1 / (1 + 0.3275911 * x)
    # The polynomial of the cited approximation.
    poly = reduce(lambda acc, c: (acc + c) * t, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592),
                  F.lit(0.0))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _encoding(token: Column, of: int) -> Column:
    """Name (0) or alphabet (2) of the first encoding the token looks like, NULL for none."""
    out = F.lit(None).cast("string")
    for e in reversed(ENCODINGS):
        out = F.when(token.rlike(e[1]), F.lit(e[of])).otherwise(out)
    return out


def battery(token: Column, alphabet: Column) -> Column:
    """Adjusted smallest p-value of the three tests under the hypothesis of independent uniform symbols."""
    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)

    def symbols(t: Column) -> Column:
        body, a = t["body"], F.length(t["alphabet"]).cast("double")
        counts = F.transform(F.split(t["alphabet"], ""), lambda c: F.pow(
            (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)))
        x = F.transform(F.split(body, ""), lambda c: (F.position(c, t["alphabet"]) - 1).cast("double"))
        return F.struct(x.alias("x"), total(counts).alias("squares"), F.length(body).cast("double").alias("n"), a.alias("a"))

    def sums(s: Column) -> Column:
        x = s["x"]
        return F.struct(
            F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1)).alias("pairs"),
            total(F.transform(x, lambda v: (v * 2 >= s["a"]).cast("double"))).alias("n1"),
            (total(x) / s["n"]).alias("mean"), total(F.transform(x, lambda v: v * v)).alias("second"),
            s["squares"].alias("squares"), s["n"].alias("n"), s["a"].alias("a"))

    def statistics(s: Column) -> Column:
        n, a, n1, mean = s["n"], s["a"], s["n1"], s["mean"]
        runs = 1 + total(F.transform(s["pairs"], lambda q: ((q["0"] * 2 >= a) != (q["1"] * 2 >= a)).cast("double")))
        cross = total(F.transform(s["pairs"], lambda q: (q["0"] - mean) * (q["1"] - mean)))
        return F.struct((a / n * s["squares"] - n).alias("chi2"), runs.alias("runs"), cross.alias("cross"),
                        (s["second"] - n * mean * mean).alias("square"),
                        (2 * n1 * (n - n1) / n + 1).alias("expected"), n.alias("n"), a.alias("a"))

    def least(s: Column) -> Column:
        n, a, expected = s["n"], s["a"], s["expected"]
        p_uniform = upper_tail((s["chi2"] - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n))
        spread = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * upper_tail(F.abs(s["runs"] - expected) / F.sqrt(spread))).otherwise(0.0)
        p_serial = F.when(s["square"] > 1e-9,
                          2 * upper_tail(F.abs(s["cross"] / s["square"] + 1 / n) * F.sqrt(n))).otherwise(0.0)
        return F.least(p_uniform, p_runs, p_serial, F.lit(1.0))

    # Each step is computed once and named by the next: a token's cost is in proportion to its length.
    p = F.struct(F.rtrim(token, F.lit("=")).alias("body"), alphabet.alias("alphabet"))
    for step in (symbols, sums, statistics, least):
        p = _let(p, step)
    return F.round(F.least(F.greatest(1 - F.pow(1 - p, F.lit(3.0)), F.lit(0.0)), F.lit(1.0)), 9)


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _within(run: Column, pattern: str) -> Column:
    """The long matches in ``run`` (a ``start, end, hit``), with offsets of the text."""
    found = F.filter(match_positions(run["hit"], pattern), lambda m: F.length(m["hit"]) >= TOKEN_LENGTH)
    return F.transform(found, lambda m: F.struct((run["start"] + m["start"]).alias("start"),
                                                 (run["start"] + m["end"]).alias("end"), m["hit"].alias("hit")))


def _parts(runs: Column) -> Column:
    """The tokens to test: runs that fit an encoding whole, and of others their long parts. Parts may overlap:
    which of ``/+`` and ``_-`` are separators and which are symbols of a key can't be told beforehand."""
    def narrower(part: Column) -> Column:
        # Equal parts stand side by side once sorted.
        return _let(F.array_sort(F.concat(*[_within(part, p) for p in NARROWER])), lambda found: F.filter(
            found, lambda m, i: (i == 0) | (m != F.get(found, i - 1))))

    def split(run: Column) -> Column:
        parts = F.transform(_within(run, BETWEEN_EQUALS),
                            lambda m: F.when(m["hit"].rlike(FITS), F.array(m)).otherwise(narrower(m)))
        return F.when(run["hit"].rlike(FITS), F.array(run)).otherwise(F.flatten(parts))

    return F.flatten(F.transform(runs, split))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table: id, base spans, and the tested tokens that overlap none of them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", base_spans(F.col("t")).alias("base"),
                       _parts(match_positions(F.col("t"), TOKEN)).alias("tokens"))
    rows = rows.select("doc_id", "base", apart_from(F.col("tokens"), F.col("base")).alias("free"))
    named = F.transform("free", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit"),
                                                 _encoding(m["hit"], 0).alias("encoding"),
                                                 _encoding(m["hit"], 2).alias("alphabet")))
    tested = F.transform(named, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        F.concat_ws(":", m["encoding"], _length_class(F.length(m["hit"])).cast("string")).alias("stratum"),
        F.xxhash64(m["hit"]).alias("token"), battery(m["hit"], m["alphabet"]).alias("p")))
    return written(rows.select("doc_id", "base", tested.alias("tested")), "secrets-scan")


def _cuts(bins: DataFrame, keys: list[str], fdr: float) -> DataFrame:
    """``keys``, the number of tokens and the cut-off (NULL for none) of each group of histogram rows."""
    per = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("tokens"),
        F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).alias("upper"))
    random = F.col("upper") * 2.0
    grid = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.struct(b.alias("bin"), F.aggregate(
        F.sequence(b, F.lit(BINS - 1)), F.lit(0).cast("long"),
        lambda s, x: s + F.coalesce(F.element_at("h", x), F.lit(0).cast("long"))).alias("kept")))
    good = F.filter(grid, lambda g: (g["kept"] > 0) & (
        g["kept"] - random * (1 - g["bin"] / float(BINS)) <= fdr * g["kept"]))
    cut = F.when(F.size(good) > 0, F.greatest(good[0]["bin"] / float(BINS), F.lit(LEAST_P)))
    return per.select(*keys, "tokens", cut.alias("cut"))


def cut_offs(scanned: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """Per stratum, the smallest p from which its tokens are secrets at this rate; strata without one are left out.

    One grouped histogram over the distinct tokens (copies of one token aren't
    independent draws, and a large group of them would move its stratum's
    cut-off); a stratum has BINS rows at most, and there are as many strata as
    encodings times length classes.

    A stratum of fewer than FEW tokens may have none in the upper half by
    chance. It takes the smaller of its own cut-off and a pooled one: that of
    its encoding's strata together, or of all strata where the encoding has few
    tokens or no cut-off. Where that has none either, its own is all there is.
    """
    tokens = scanned.select(F.explode("tested").alias("m")).select("m.stratum", "m.token", "m.p").distinct()
    bins = written(tokens.groupBy("stratum", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
                   .agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("encoding", F.substring_index("stratum", ":", 1)), "secrets-histogram")
    own = {r.stratum: r for r in _cuts(bins, ["stratum"], fdr).collect()}
    of = {r.encoding: r for r in _cuts(bins, ["encoding"], fdr).collect()}
    pooled = next((r.cut for r in _cuts(bins.withColumn("all", F.lit(0)), ["all"], fdr).collect()), None)
    out = {}
    for stratum, r in own.items():
        cuts = [r.cut]
        if r.tokens < FEW:
            e = of[stratum.split(":")[0]]
            cuts.append(e.cut if e.tokens >= FEW and e.cut is not None else pooled)
        cuts = [c for c in cuts if c is not None]
        if cuts:
            out[stratum] = min(cuts)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: its id, ``base`` and ``added`` arrays of ``start, rank, end, kind``.

    Offsets are code points, ends exclusive. NULL text counts as empty;
    repeated rows come back as often as they went in; other columns play no
    part; an empty table gives an empty result.
    """
    scanned = scan(docs, id_col, text_col)
    # A value per stratum: encodings times length classes, at most a few dozen whatever the input.
    cuts = F.map_from_entries(F.array(*[F.struct(F.lit(s), F.lit(c)) for s, c in sorted(cut_offs(scanned, fdr).items())])
                              .cast("array<struct<stratum:string,cut:double>>"))
    hits = F.filter("tested", lambda m: F.coalesce(m["p"] >= F.element_at(cuts, m["stratum"]), F.lit(False)))
    # A part inside another one that is reported adds nothing.
    widest = F.when(F.size(hits) > 1, outermost(hits)).otherwise(
        F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    return scanned.select("doc_id", "base", _spans(widest, len(KINDS), RANDOM).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind and digests of ``find_secrets``'s spans."""
    def joined(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
                        F.size("added").cast("long").alias("n_random"))
