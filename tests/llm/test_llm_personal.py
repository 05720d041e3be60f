"""Personal data: patterns against plain regular expressions, the model against all segmentations, rewritten forms held out."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from lexloom.llm.personal import (
    CARD, EMAIL, IP, KINDS, N_FEATURES, PHONE, base_spans, candidates, features, find_personal, luhn, masked, spans_of, train, windows,
)
from lexloom.llm.semi_crf import SemiCrf, best_path, log_likelihood, marginals

PLAIN = {
    EMAIL: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    IP: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    CARD: r"[0-9]([\x20-]?[0-9])+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                EMAIL: True,
                IP: all(int(p) <= 255 for p in m[0].split(".")) if kind == IP else True,
                CARD: 13 <= len(digits) <= 19 and luhn(digits),
                PHONE: 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return out


def test_patterns_against_regular_expressions():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "x@y.z", "1", "255", "256", ".", "1.2.3.4", "+", "+1 (2) 345-67890", "4111 1111 1111 1111", "-", " ", "é", "００", "%", "(", ")", "\n", "0000", "7.8"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == brute_base(text), text


def test_patterns_are_linear():
    for text in ("1" * 60_000, "1." * 30_000, "a@" * 30_000, "+1 " * 20_000, "a." * 30_000 + "@", "1 " * 30_000, "@" * 60_000, "[at]" * 15_000):
        assert len(candidates(text, base_spans(text))) <= 60 * len(text)


def all_paths(found):
    for n in range(len(found) + 1):
        for chosen in itertools.combinations(range(len(found)), n):
            spans = sorted(found[i] for i in chosen)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                yield chosen


def test_sums_and_best_path_against_all_segmentations():
    rng = random.Random(2)
    for _ in range(60):
        found = list({(a := rng.randint(0, 8), a + rng.randint(1, 4), rng.randint(0, 2)) for _ in range(rng.randint(0, 8))})
        scores = [rng.uniform(-3, 3) for _ in found]
        weigh = {p: sum(scores[i] for i in p) for p in all_paths(found)}
        total = sum(map(math.exp, weigh.values()))
        log_total, chance = marginals(found, scores)
        assert log_total == pytest.approx(math.log(total))
        for i in range(len(found)):
            assert chance[i] == pytest.approx(sum(math.exp(w) for p, w in weigh.items() if i in p) / total)
        assert sum(scores[i] for i in best_path(found, scores)) == pytest.approx(max(weigh.values()))


def test_gradient():
    rng = np.random.default_rng(1)
    lattices = [([(0, 2, 0), (1, 3, 1), (2, 4, 0)], [0, 2]), ([(0, 1, 1)], [])]
    rows, kinds = rng.normal(size=(4, 3)), np.array([0, 1, 0, 1])
    weights = rng.normal(size=(2, 3))
    value, gradient = log_likelihood(weights, lattices, rows, kinds, 0.3)
    for place in np.ndindex(weights.shape):
        moved = weights.copy()
        moved[place] += 1e-6
        assert (log_likelihood(moved, lattices, rows, kinds, 0.3)[0] - value) / 1e-6 == pytest.approx(gradient[place], abs=1e-3)


def card(rng):
    head = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def plain_text(rng):
    words = lambda n: " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    inside = [
        f"{words(1)}.{rng.randint(10, 99)}@mail{rng.randint(1, 5)}.example.com",
        ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        card(rng),
        f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
        f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}",
        f"{rng.randint(1950, 2020)}",
    ]
    return " ".join(f"{words(6)} {x}" for x in rng.sample(inside, 4)) + " " + words(3)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    return train([w for _ in range(120) for w in windows(plain_text(rng))])


def test_held_out_forms(model):
    rng, found, made = random.Random(11), 0, 0
    for _ in range(150):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        number = card(rng)
        for text, spans in [
            (f"call ({a}) {b}-{c} soon", [(5, 19, "phone")]),
            (f"call {a}-{b}-{c} soon", [(5, 17, "phone")]),
            (f"paid {number} {number} then", [(5, 21, "card"), (22, 38, "card")]),
            (f"paid {number[:4]}.{number[4:8]}.{number[8:12]}.{number[12:]} then", [(5, 24, "card")]),
            (f"ask jo.{a} [at] post.example.org now", [(4, 32, "email")]),
        ]:
            got = [(s, e, KINDS[k]) for s, e, k, base in spans_of(text, model, 0.8) if not base]
            made += len(spans)
            found += len(set(got) & set(spans))
    assert found >= 0.9 * made, (found, made)


def test_plain_numbers_are_left_alone(model):
    rng = random.Random(13)
    for _ in range(150):
        number = card(rng)
        wrong = number[:-1] + str((int(number[-1]) + 3) % 10)
        a = rng.randint(1, 28)
        for text in (f"card {wrong} no", f"on 2024-05-{a:02d} we", f"on {a}.05.2024 we", f"sum 1,{a + 100},567.89 due", f"v{a}.2.3 and 1.{a}.7", f"years 19{a + 50}-20{a + 10}", f"hex {a}ab{number}cd"):
            assert [s for s in spans_of(text, model, 0.8) if not s[3]] == [], text


def test_features_have_their_width(model):
    text = "a@b.c +1 (22) 333-4444 1.2.3.4 x [at] y dot z"
    found = candidates(text)
    assert features(text, found).shape == (len(found), N_FEATURES) and features("", []).shape == (0, N_FEATURES)
    assert isinstance(model, SemiCrf) and model.decode([], features("", []), 0.5) == []


def test_table(spark, model):
    rng = random.Random(17)
    texts = [plain_text(rng) for _ in range(60)] + [None, "", "no numbers", "é" * 9 + " (743) 555-3824 " + "é" * 70_000 + " a@b.co", "x (743) 555-3824, 1.2.3.4"]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(3, texts[3], None, None), (None, "mail c@d.ef", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, `start` int").repartition(5)
    got = find_personal(docs, least=0.8).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "spans", "start"}
    for r in got:
        assert [(s.start, s.end, KINDS.index(s.kind)) for s in r.spans if s.base] == brute_base(r.text or "")
        order = [(KINDS.index(s.kind), s.start) for s in r.spans]
        assert order == sorted(order)
    long = next(r for r in got if r.text and len(r.text) > 60_000)
    assert [(s.start, s.end, s.kind) for s in long.spans] == [(70_026, 70_032, "email"), (10, 24, "phone")]
    assert masked(long.text, [(s.start, s.end, s.kind) for s in long.spans]).startswith("é" * 9 + " [phone] é")


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "call (743) 555-3824"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.spans for r in find_personal(docs).collect()} == {1: [], 2: []}
    assert find_personal(docs.limit(0)).collect() == []
