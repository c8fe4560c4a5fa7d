"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The semi-Markov CRF scores whole candidate
segments (up to MAX_TOKENS tokens) by features of the span as a whole and of
its neighbours, and a dynamic program over segment ends and types picks the
best segmentation of each region, so boundaries and types are chosen together.
It is fitted here, on a bounded sample of regions from all documents, drawn per
kind, in which the base spans are the labels, with variants of them that the
patterns miss (a phone without its plus, a card in dotted groups, a spaced-out
address). Spans it finds beside the base ones are added. A kind with no base
span in any document has nothing to learn from and adds no span.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopguard.llm.common import written

# The kinds in their order, and the patterns of the base spans. Look-behinds and
# possessive quantifiers only keep the search linear; they change no match.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_TOKENS = 16
# Distinct regions the model is fitted on at most (those with the smallest hashes): with an entity of a
# kind, for each kind, and without any. A longer region is cut into pieces of so many characters.
KIND_REGIONS, EMPTY_REGIONS, REGION_CHARS = 200, 250, 300
# Tokens whose candidates are scored at a time; the dynamic program runs on over the whole region.
BLOCK_TOKENS = 400

Span = tuple[int, int, int]          # kind number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The pattern matches that pass their checks, by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_SIGNAL = re.compile(r"[0-9@]\S*+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold personal data: space-separated chunks with a digit or an ``@``, joined
    where single spaces part them; next to a bare ``@`` the neighbouring word belongs to it."""
    found: list[list[int]] = []
    floor = 0
    for m in _SIGNAL.finditer(text):
        a, b = m.start(), m.end()
        while a > floor and not text[a - 1].isspace():
            a -= 1
        if text[a] == "@" and a > floor and text[a - 1] == " ":
            a -= 1
            while a > floor and not text[a - 1].isspace():
                a -= 1
        if text[b - 1] == "@" and text[b:b + 1] == " ":
            b += 1
            while b < len(text) and not text[b].isspace():
                b += 1
        if found and (a <= found[-1][1] or (a == found[-1][1] + 1 and text[a - 1] == " ")):
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b])
        floor = found[-1][1]
    return [(a, b) for a, b in found]


N_FEATURES = 24


def span_features(text: str, start: int, end: int) -> list[float]:
    """Features of one whole candidate span."""
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    n, size = len(digits), end - start
    letters = sum(c.isalpha() for c in s)
    blanks = s.count(" ")
    left, right = text[start - 1:start], text[end:end + 1]
    parts = s.split(".")
    quad = len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    user, _, host = s.partition("@")
    labels = host.strip(" ").split(".")
    address = (s.count("@") == 1 and user.strip(" ") != "" and len(labels) > 1
               and all(x and x.isascii() and x.replace("-", "").isalnum() for x in labels)
               and all(c in LOCAL for c in user.rstrip(" ")))
    groups = re.split(r"[ .-]", s)
    even = len(groups) > 1 and all(len(g) == 4 and g.isdecimal() for g in groups)
    numeric = n > 0 and letters == 0 and all(c in "0123456789 ().+-" for c in s)
    return [1.0, float(address), float(address and labels[-1].isalpha()), float("@" in s), float(quad),
            float(13 <= n <= 19 and letters == 0 and luhn(digits)), float(13 <= n <= 19), float(9 <= n <= 12),
            float(n < 7), float(n > 19), float(s[0] == "+"), float(s[0] in "(0123456789+"), float(s[-1] in "0123456789"),
            float(numeric), float(numeric and 9 <= n <= 15 and ("(" in s or s[0] == "+") and s.count("(") == s.count(")")),
            float(even), float(blanks > 0), float(blanks > 4), float(letters > 0),
            float(left.isalnum() or left in ("+", "-", "@", "(") if left else 0), float(right.isalnum() if right else 0),
            float(right in ("-", "@", ")") if right else 0), float(s[0] in " .-@)" or s[-1] in " .-@(+"),
            min(size, 40) / 40.0]


class SemiCrf:
    """Weights of span features per kind and of a kind following a segment's kind (0: no entity)."""

    def __init__(self, weights: np.ndarray, follow: np.ndarray):
        self.weights, self.follow = weights, follow

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, list[float]]]]:
        """For each end token, the (first token, features) of spans that hold a digit or an ``@``
        and neither begin nor end with a blank."""
        out: list[list[tuple[int, list[float]]]] = []
        signal = np.cumsum([0, *[text[a] in "0123456789@" for a, _ in tokens]])
        for j, (_, end) in enumerate(tokens):
            mine = []
            if not text[end - 1].isspace():
                for i in range(max(0, j + 1 - MAX_TOKENS), j + 1):
                    start = tokens[i][0]
                    if signal[j + 1] > signal[i] and not text[start].isspace() and end - start <= 256:
                        mine.append((i, span_features(text, start, end)))
            out.append(mine)
        return out

    def _scores(self, cands):
        return [np.array([f for _, f in c]) @ self.weights.T if c else None for c in cands]

    def decode(self, text: str, tokens: Iterable[tuple[int, int]]) -> list[Span]:
        """The best segmentation's entities.

        Scores are held for the last MAX_TOKENS ends only; of every token its
        offsets and, per kind of the segment that ends there, one byte stay:
        the segment's length and the kind before it.
        """
        k, tokens = len(KINDS), iter(tokens)
        starts, ends, back = array("i"), array("i"), bytearray()
        best = deque([np.array([0.0, *[-np.inf] * k])], MAX_TOKENS)   # by end and last segment's kind
        recent: list[tuple[int, int]] = []
        while block := list(islice(tokens, BLOCK_TOKENS)):
            starts.extend(a for a, _ in block)
            ends.extend(b for _, b in block)
            have, recent = len(recent), recent + block
            cands = self.candidates(text, recent)
            scores = self._scores(cands)
            for j in range(have, len(recent)):
                come = best[-1]
                here, links = np.full(k + 1, -np.inf), bytearray(k + 1)
                here[0], links[0] = come.max(), 1 << 3 | int(come.argmax())
                for (i, _), s in zip(cands[j], scores[j] if cands[j] else ()):
                    into = best[i - j - 1][:, None] + self.follow
                    total = into.max(axis=0) + s
                    for y in np.flatnonzero(total > here[1:]):
                        here[1 + y] = total[y]
                        links[1 + y] = (j + 1 - i) << 3 | int(into[:, y].argmax())
                best.append(here)
                back += links
            recent = recent[1 - MAX_TOKENS:]
        at, y = len(starts), int(best[-1].argmax())
        out = []
        while at:
            link = back[(at - 1) * (k + 1) + y]
            i = at - (link >> 3)
            if y:
                out.append((y - 1, starts[i], ends[at - 1]))
            at, y = i, link & 7
        return out[::-1]

    def gradient(self, cands, gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Gold minus expected feature counts, by forward-backward over segments."""
        n, k, scores = len(cands), len(KINDS), self._scores(cands)
        fwd = np.full((n + 1, k + 1), -np.inf)
        fwd[0, 0] = 0.0
        lse = np.logaddexp.reduce
        for j, c in enumerate(cands):
            fwd[j + 1, 0] = lse(fwd[j])
            for (i, _), s in zip(c, scores[j] if c else ()):
                fwd[j + 1, 1:] = np.logaddexp(fwd[j + 1, 1:], lse(fwd[i][:, None] + self.follow, axis=0) + s)
        bwd = np.full((n + 1, k + 1), -np.inf)
        bwd[n] = 0.0
        for j in range(n - 1, -1, -1):
            bwd[j] = np.logaddexp(bwd[j], bwd[j + 1, 0])
            # Every segment that ends at j + 1 has its score of what follows by now.
            for (i, _), s in zip(cands[j], scores[j] if cands[j] else ()):
                bwd[i] = np.logaddexp(bwd[i], lse(self.follow + (s + bwd[j + 1, 1:]), axis=1))
        z = lse(fwd[n])
        dw, df = np.zeros_like(self.weights), np.zeros_like(self.follow)
        for j, c in enumerate(cands):
            for (i, f), s in zip(c, scores[j] if c else ()):
                p = np.exp(fwd[i][:, None] + self.follow + s + bwd[j + 1, 1:] - z)
                dw -= p.sum(axis=0)[:, None] * np.array(f)
                df -= p
        before = {0: 0}
        at = 0
        for i, j, y in sorted(gold):
            f = next(f for a, f in cands[j] if a == i)
            dw[y] += f
            df[before.get(at, 0) if i == at else 0, y] += 1
            at, before = j + 1, {j + 1: y + 1}
        return dw, df


def _variants(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The region, and the region with its first entity written as the patterns miss it."""
    yield text, spans
    if not spans:
        return
    kind, a, b = spans[0]
    s = text[a:b]
    if kind == 3 and " " in s:
        new = s.split(" ", 1)[1]
    elif kind == 2 and len(s) == 16 and s.isdigit():
        new = ".".join(s[i:i + 4] for i in range(0, 16, 4))
    elif kind == 0:
        new = s.replace("@", " @ ")
    else:
        return
    shift = len(new) - len(s)
    yield text[:a] + new + text[b:], [(kind, a, a + len(new)), *[(k, x + shift, y + shift) for k, x, y in spans[1:]]]


Example = tuple[int, str, list[Span]]          # hash, text, entities in it


def _cut(text: str, a: int, b: int, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """The region in pieces of about REGION_CHARS, cut behind blanks (anywhere where there is none) outside its spans."""
    while b - a > REGION_CHARS:
        end = text.rfind(" ", a, a + REGION_CHARS) + 1 or a + REGION_CHARS
        for _, x, y in sorted(spans, key=lambda s: s[1]):
            if x < end < y:
                end = y
        yield a, min(end, b)
        a = min(end, b)
    if a < b:
        yield a, b


def examples(text: str) -> Iterator[Example]:
    """Every region of the text with the base spans in it and a character on each side. Left out are pieces
    whose spans overlap or that hold a span no candidate can be, as the model has no segmentation for them."""
    base = sorted(base_spans(text), key=lambda s: s[1])
    k = 0
    for a, b in regions(text):
        while k < len(base) and base[k][2] <= a:
            k += 1
        inside = []
        for s in base[k:]:
            if s[1] >= b:
                break
            inside.append(s)
        for x, y in _cut(text, a, b, inside):
            mine = [s for s in inside if s[1] < y and x < s[2]]
            if all(x <= s[1] and s[2] <= y and s[2] - s[1] <= 256
                   and sum(1 for _ in _TOKEN.finditer(text, s[1], s[2])) <= MAX_TOKENS for s in mine) \
                    and all(p[2] <= q[1] for p, q in zip(mine, mine[1:])):
                lo, hi = max(0, x - 1), min(len(text), y + 1)
                t, spans = text[lo:hi], [(n, c - lo, d - lo) for n, c, d in mine]
                h = hashlib.blake2b(f"{t}\0{spans}".encode("utf-8", "replace"), digest_size=8).digest()
                yield int.from_bytes(h, "big", signed=True), t, spans


class Sample:
    """The distinct examples with the smallest hashes, per kind (the last class: without an entity)."""

    def __init__(self) -> None:
        self.kept: list[dict[int, Example]] = [{} for _ in range(len(KINDS) + 1)]
        self.limit = [KIND_REGIONS] * len(KINDS) + [EMPTY_REGIONS]
        self.bound = [1 << 63] * (len(KINDS) + 1)

    def add(self, example: Example) -> None:
        for c in {k for k, _, _ in example[2]} or {len(KINDS)}:
            if example[0] < self.bound[c]:
                kept = self.kept[c]
                kept[example[0]] = example
                if len(kept) >= 2 * self.limit[c]:
                    self._shrink(c)

    def _shrink(self, c: int) -> None:
        low = sorted(self.kept[c])[:self.limit[c]]
        self.kept[c] = {h: self.kept[c][h] for h in low}
        if len(low) == self.limit[c]:
            self.bound[c] = low[-1]

    def per_class(self) -> Iterator[tuple[int, Example]]:
        for c in range(len(self.kept)):
            self._shrink(c)
            yield from ((c, e) for e in self.kept[c].values())


def fit(texts: list[str], epochs: int = 6, ridge: float = 0.02) -> SemiCrf:
    """Fit on a sample of the regions of ``texts``."""
    sample = Sample()
    for t in texts:
        for e in examples(t):
            sample.add(e)
    return fit_examples([e for _, e in sample.per_class()], epochs, ridge)


def fit_examples(chosen: list[Example], epochs: int = 6, ridge: float = 0.02) -> SemiCrf:
    """Fit on the examples, whatever their order. A kind that none of them holds is never predicted."""
    distinct = [(t, spans) for _, t, spans in sorted({e[0]: e for e in chosen}.values(), key=lambda e: e[0])]
    positive, negative = [e for e in distinct if e[1]], [e for e in distinct if not e[1]]
    model = SemiCrf(np.zeros((len(KINDS), N_FEATURES)), np.zeros((len(KINDS) + 1, len(KINDS))))
    data = []
    for t, spans in [v for e in positive for v in _variants(*e)] + negative:
        tokens = [m.span() for m in _TOKEN.finditer(t)]
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
        cands = model.candidates(t, tokens)
        gold = {(first.get(a, -1), last.get(b, -1), k) for k, a, b in spans}
        if all(i >= 0 and j >= 0 and any(x == i for x, _ in cands[j]) for i, j, _ in gold):
            data.append((cands, gold))
    seen_w, seen_f = np.full_like(model.weights, 1e-6), np.full_like(model.follow, 1e-6)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for n in order.permutation(len(data)):
            dw, df = model.gradient(*data[n])
            dw -= ridge * model.weights / len(data)
            seen_w += dw ** 2
            seen_f += df ** 2
            model.weights += 0.5 * dw / np.sqrt(seen_w)
            model.follow += 0.5 * df / np.sqrt(seen_f)
    for k in set(range(len(KINDS))) - {k for _, gold in data for _, _, k in gold}:
        model.weights[k] = 0.0
        model.weights[k, 0] = -1e9
    return model


def find(text: str, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """(base spans, spans the model adds): an added span overlaps no base span."""
    base = base_spans(text)
    taken = _union(base)
    added = []
    k = 0
    for a, b in regions(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] <= a and b <= taken[k][1]:
            continue
        j = k
        for s in model.decode(text, (m.span() for m in _TOKEN.finditer(text, a, b))):
            while j < len(taken) and taken[j][1] <= s[1]:
                j += 1
            if j == len(taken) or taken[j][0] >= s[2]:
                added.append(s)
    return base, sorted(added)


def _union(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches the spans cover, in order and apart; spans that only touch stay two."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _format(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def training_examples(docs: DataFrame, text_col: str) -> list[Example]:
    """The bounded sample the model is fitted on, from all regions of all documents.

    A task hands on at most KIND_REGIONS of each kind and EMPTY_REGIONS without
    any; of those, the ones with the smallest hashes over all tasks are taken.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sample()
        for b in batches:
            for t in b.column(0).to_pylist():
                for e in examples(t):
                    sample.add(e)
        rows = [(c, h, t, [x for s in spans for x in s]) for c, (h, t, spans) in sample.per_class()]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(
            zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())))],
            names=["c", "h", "t", "s"])

    few = written(docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("t"))
                  .mapInArrow(run, "c int, h long, t string, s array<int>"), "pii-examples")
    distinct = few.groupBy("c", "h").agg(F.min(F.struct("t", "s")).alias("e")).select("c", "h", "e.t", "e.s")
    out = []
    for c, limit in enumerate(Sample().limit):
        out += [(r.h, r.t, list(zip(r.s[::3], r.s[1::3], r.s[2::3])))
                for r in distinct.where(F.col("c") == c).orderBy("h").limit(limit).collect()]
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       model: SemiCrf | None = None) -> DataFrame:
    """One row per document: its id, ``base`` and ``added`` arrays of ``kind, start, end`` (code points).

    NULL text counts as empty; repeated rows come back as often as they went
    in; other columns play no part; an empty table gives an empty result.
    """
    crf = model or fit_examples(training_examples(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [find(t or "", crf) for t in b.column(1).to_pylist()]
            cols = [pa.array([[{"kind": KINDS[k], "start": x, "end": y} for k, x, y in sorted(f[i])] for f in found], spans)
                    for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "added"])

    span = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")) \
        .mapInArrow(run, f"doc_id long, base {span}, added {span}")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind and digests of ``find_personal_data``'s spans."""
    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(ordered).alias("spans"), F.size("added").cast("long").alias("n_added"))
