"""Personal data: base spans against the patterns as written, decoding against brute force, held-out variants."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from small_documents import documents  # noqa: F401

from shopguard.llm import pii

SCHEMA = "doc_id long, text string, base string, added int"


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def sentence(rng, kind):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        s = f"joe.{d(2)}@mail{d(1)}.example.com"
    elif kind == 1:
        s = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == 2:
        s = next(x for x in iter(lambda: d(16), None) if pii.luhn(x))
    elif kind == 3:
        s = f"+1 ({d(3)}) 555-{d(4)}"
    else:
        s = rng.choice([next(x for x in iter(lambda: d(16), None) if not pii.luhn(x)), d(3), f"{d(1)}.{d(2)}",
                        f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"v{d(1)}.{d(1)}.{d(2)}"])
    return f"some words {s} and more", s


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return pii.fit([sentence(rng, i % 6)[0] for i in range(360)], epochs=4)


def test_base_spans(documents):
    rng = random.Random(1)
    for r in documents:
        assert pii.base_spans(r.text) == brute(r.text)
    for _ in range(8000):
        t = "".join(rng.choice("12345 67890.-+()@ab%.- +1@x.y") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(t) == brute(t), t


def test_decoding_is_the_best_segmentation(model):
    """The dynamic program against every segmentation of short texts."""
    for text in ("+1 5.2", "a@b.c", "1.2.3.4", "55 (12"):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        cands = model.candidates(text, tokens)
        table = {(i, j): np.array(f) @ model.weights.T for j, c in enumerate(cands) for i, f in c}

        def best(at, prev):
            if at == len(tokens):
                return 0.0, ()
            options = [best(at + 1, 0)]
            for j in range(at, len(tokens)):
                for y in range(len(pii.KINDS)) if (at, j) in table else ():
                    s, rest = best(j + 1, y + 1)
                    options.append((s + table[at, j][y] + model.follow[prev, y],
                                    ((y, tokens[at][0], tokens[j][1]), *rest)))
            return max(options, key=lambda o: o[0])

        assert tuple(model.decode(text, tokens)) == best(0, 0)[1]


def test_gradient(model):
    """Forward-backward expectations against finite differences of the log-likelihood."""
    text = "x 1.2.3.4 y"
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    gold = {(2, 8, 1)}
    rng = np.random.default_rng(0)
    crf = pii.SemiCrf(rng.normal(size=(4, pii.N_FEATURES)) * 0.2, rng.normal(size=(5, 4)) * 0.2)
    cands = crf.candidates(text, tokens)

    def loglik():
        fwd = np.full((len(cands) + 1, 5), -np.inf)
        fwd[0, 0] = 0
        for j, c in enumerate(cands):
            fwd[j + 1, 0] = np.logaddexp.reduce(fwd[j])
            for i, f in c:
                for y in range(4):
                    s = np.logaddexp.reduce(fwd[i] + crf.follow[:, y]) + np.array(f) @ crf.weights[y]
                    fwd[j + 1, y + 1] = np.logaddexp(fwd[j + 1, y + 1], s)
        feats = next(f for i, f in cands[8] if i == 2)
        return np.array(feats) @ crf.weights[1] + crf.follow[0, 1] - np.logaddexp.reduce(fwd[-1])

    dw, df = crf.gradient(cands, gold)
    for y, k in itertools.product((0, 1, 3), (0, 4, 13)):
        crf.weights[y, k] += 1e-5
        up = loglik()
        crf.weights[y, k] -= 2e-5
        down = loglik()
        crf.weights[y, k] += 1e-5
        assert abs((up - down) / 2e-5 - dw[y, k]) < 1e-4


def test_held_out_variants(model):
    rng = random.Random(9)
    found = {2: 0, 3: 0}
    wrong = 0
    for i in range(60):
        text, s = sentence(rng, 3)
        plain = text.replace("+1 ", "")
        found[3] += (3, 11, 11 + len(s) - 3) in pii.find(plain, model)[1]
        text, s = sentence(rng, 2)
        dotted = ".".join(s[j:j + 4] for j in range(0, 16, 4))
        found[2] += any(k == 2 and a == 11 for k, a, _ in pii.find(text.replace(s, dotted), model)[1])
        wrong += len(pii.find(sentence(rng, 5)[0], model)[1])
    assert min(found.values()) >= 54 and wrong <= 6


def test_frames(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "1 " * 5000),
            (10**6 + 3, "x" * 20000 + "@"), (None, "+1 (443) 555-5793"), (None, "+1 (443) 555-5793")]
    df = spark.createDataFrame([(d, t, "b", 1) for d, t in rows], SCHEMA)
    out = pii.digest(pii.find_personal_data(df)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for d, t in rows:
        want = sorted(brute(t or ""))
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert by[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [by[d][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == i for w in want) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(by[d].spans.split(","))
    assert pii.digest(pii.find_personal_data(df.limit(0))).count() == 0


def test_rare_kinds_are_learned(spark):
    """One kind per document, the rare ones in few of many documents, late in long ones or in a long region."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, 4)[0] + " " + sentence(rng, 0)[0]) for i in range(1500)]
    late = " ".join(sentence(rng, 5)[0] for _ in range(40))
    rows += [(5000 + i, f"{late} {sentence(rng, 3)[0]}") for i in range(30)]
    dates = " ".join(f"20{i:02}" for i in range(99))
    cards = [sentence(rng, 2)[1] for _ in range(40)]
    rows += [(6000 + i, f"{dates} words {'7' * 12}.5 {dates} or {s}") for i, s in enumerate(cards[:20])]
    rows += [(7000 + i, f"{'x1 ' * 150}y {s} z1{' x1' * 150}") for i, s in enumerate(cards[20:])]
    df = spark.createDataFrame([(d, t, "b", 1) for d, t in rows], SCHEMA).repartition(7)
    chosen = pii.training_examples(df, "text")
    held = [{k for k, _, _ in spans} for _, _, spans in chosen]
    assert sum(3 in h for h in held) == 30 and sum(2 in h for h in held) == 40
    assert sum(0 in h for h in held) == pii.KIND_REGIONS and held.count(set()) <= pii.EMPTY_REGIONS
    again = pii.training_examples(df.repartition(2), "text")
    assert sorted(again) == sorted(chosen)
    crf = pii.fit_examples(chosen)
    found = 0
    for _ in range(20):
        text, s = sentence(rng, 3)
        found += (3, 11, 11 + len(s) - 3) in pii.find(text.replace("+1 ", ""), crf)[1]
    assert found >= 16


def test_a_kind_without_examples_adds_nothing():
    rng = random.Random(6)
    crf = pii.fit([sentence(rng, 3 * (i % 2))[0] for i in range(80)], epochs=3)
    assert not any(k in (1, 2) for i in range(40) for k, _, _ in pii.find(sentence(rng, i % 6)[0], crf)[1])


def test_long_regions_are_decoded_whole(model, monkeypatch):
    """An entity anywhere in a long region is chosen whole, and the block size plays no part."""
    rng = random.Random(12)
    for n in (3, *range(129, 135), 265):
        text = "x1 " * n + "(443) 555-5793" + " x1" * 20
        assert (3, 3 * n, 3 * n + 14) in pii.find(text, model)[1], n
    for _ in range(20):
        text = "".join(rng.choice("12345 67890.-+()@ab%.- +1@x.y") for _ in range(120))
        monkeypatch.setattr(pii, "BLOCK_TOKENS", 16)
        small = pii.find(text, model)
        monkeypatch.setattr(pii, "BLOCK_TOKENS", 10**6)
        assert small == pii.find(text, model)


def test_overlaps_match_brute_force(model):
    rng = random.Random(14)
    for _ in range(200):
        text = "".join(rng.choice(["a@b.co", " ", "1.2.3.4", "x", "+1 (443) 555-5793", "4111 1111 1111 1111", "@", "7", ". "])
                       for _ in range(rng.randint(1, 25)))
        base, added = pii.find(text, model)
        want = []
        for a, b in pii.regions(text):
            if not any(x <= a and b <= y for _, x, y in base):
                want += [s for s in model.decode(text, [m.span() for m in pii._TOKEN.finditer(text, a, b)])
                         if not any(x < s[2] and s[1] < y for _, x, y in base)]
        assert added == sorted(want)


def test_a_text_of_many_addresses_takes_linear_time(model):
    text = "\n".join(f"user{i}@mail{i}.example.com" for i in range(200000))
    start = time.perf_counter()
    base, added = pii.find(text, model)
    assert time.perf_counter() - start < 60
    assert len(base) == 200000 and not added
