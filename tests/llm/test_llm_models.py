"""Toxicity, n-gram scores and quality against held-out labels and plain Python."""

import collections
import math
import pathlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm.common import learns_from
from lexloom.llm.elias_fano import EliasFano, encode, successor
from lexloom.llm.ngram_trie import score_held_out, score_texts, train_model
from lexloom.llm.robust import chi2_quantile, judge_quality, text_counts
from lexloom.llm.subword import drop_toxic, labelled_sample, passages, score_toxicity, subwords, train

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = pathlib.Path("/root/testdata/sf0.1")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("top", [10, 300, 70_000, 2**40, 2**64 - 1])
def test_elias_fano(top):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, top, 700, dtype=np.uint64, endpoint=True))
    coded = EliasFano(encode(values))
    assert (coded.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    place = {int(v): i for i, v in enumerate(values)}
    assert coded.find(asked).tolist() == [place.get(int(a), -1) for a in asked]
    repeated = np.sort(rng.integers(0, min(top, 50), 200, dtype=np.uint64))
    assert (EliasFano(encode(repeated)).access(np.arange(200)) == repeated).all()
    assert EliasFano(encode(np.empty(0, np.uint64))).find(asked[:3]).tolist() == [-1, -1, -1]


def test_successor_stays_in_its_range():
    values = np.array([1, 5, 9, 2, 5, 7], np.uint32)
    found = successor(values, np.array([0, 3, 0, 3, 2]), np.array([3, 6, 3, 6, 2]), np.array([5, 5, 2, 9, 9], np.uint64))
    assert found.tolist() == [1, 4, -1, -1, -1]


def brute_scores(rows, order, least=2, discount=0.75):
    end, learnt = ("</s>",), [collections.Counter() for _ in range(order + 1)]
    texts = [words((t or "").translate(LOW)) for _, t in rows]
    for (doc_id, _), w in zip(rows, texts):
        if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2:
            s = [end, *w, end]
            learnt[1].update((x,) for x in s[1:])
            for n in range(2, order + 1):
                learnt[n].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    tokens, different = sum(learnt[1].values()), len(learnt[1])
    kept = [None, learnt[1]] + [{g: c for g, c in learnt[n].items() if c >= least} for n in range(2, order + 1)]
    mass = collections.Counter()
    for n in range(2, order + 1):
        for g, c in kept[n].items():
            mass[g[:-1]] += (c - discount) / kept[n - 1][g[:-1]]
    out = []
    for (doc_id, _), w in zip(rows, texts):
        s, base, score = [end, *w, end], 0.0, 0.0
        for i in range(1, len(s)):
            p = (learnt[1][(s[i],)] + 1) / (tokens + different + 1)
            base += math.log10(p)
            for n in range(2, min(order, i + 1) + 1):
                h = tuple(s[i - n + 1 : i])
                if h in mass:
                    g = (*h, s[i])
                    p = ((kept[n][g] - discount) / kept[n - 1][h] if g in kept[n] else 0.0) + (1 - mass[h]) * p
            score += math.log10(p)
        out.append((doc_id, len(w) + 1, sum(learnt[1][(x,)] > 0 for x in s[1:]), tokens, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_brute_force(spark, order):
    some = ["a b a b c", "the cat sat", "The CAT sat on the mat", None, "", "é a b b", "x " * 400, "the cat ran far"]
    rows = [(i, some[i % len(some)]) for i in range(40)] + [(None, "the cat"), (3, "a b a b"), (3, "a b a b")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double")
    got = score_held_out(df, order=order).collect()
    want = brute_scores(rows, order)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.score)), sorted(want, key=lambda r: (str(r[0]), r[1], r[5]))):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert g.base_score == pytest.approx(w[4], abs=1e-6) and g.score == pytest.approx(w[5], abs=2e-3 * g.n_tokens)


@pytest.mark.parametrize("least", [1, 2])
def test_scores_do_not_depend_on_the_number_of_shards(spark, least):
    rows = [(i, "x " * 700 + f"y{i % 5} x x z{i} the cat z{i}") for i in range(20)] + [(40 + i, "the cat sat") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    learns = learns_from(F.col("doc_id"), 7, 2)
    found = {}
    for shard_bytes in (1 << 30, 900):
        model = train_model(df.where(learns), least=least, shard_bytes=shard_bytes)
        assert (model.shards == 1) == (shard_bytes > 1000)
        # The pair of one word repeated is a large context of the third level.
        assert len(model.hot) == 2 and len(model.hot[1][0]) >= 1
        found[shard_bytes] = {r.doc_id: r.score for r in score_texts(df, model).collect()}
    assert found[1 << 30] == found[900]
    for doc_id, n, _, _, _, score in brute_scores(rows, 3, least):
        assert found[900][doc_id] == pytest.approx(score, abs=2e-3 * n)


def test_large_contexts_are_spread(spark):
    rows = [(i, " ".join(f"hot w{(i * 7 + k) % 90}" for k in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = train_model(df.where("doc_id % 2 = 0"), order=2)
    assert len(model.hot[0][0]) >= 1
    got = {r.doc_id: r.score for r in score_held_out(df, order=2).collect()}
    for doc_id, _, _, _, _, score in brute_scores(rows, 2):
        assert got[doc_id] == pytest.approx(score, abs=0.2)


def test_scores_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert score_held_out(empty).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    row = score_texts(one, train_model(empty)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def brute_counts(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, had = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in had
            had.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(marked)


def test_counts_edge_cases(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "a a a a", "x\nx\n\n\nx ", "#*$%&|<> # é", "a b c d", "a b c d " * 3000, "ab c a bc ab c"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    for r in judge_like(df):
        assert r[1:] == brute_counts(texts[r[0]])
    assert text_counts(df.limit(0).drop("n_words")).collect() == []


def judge_like(df):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return [tuple(r[n] for n in names) for r in text_counts(df.drop("n_words")).collect()]


def test_chi2_quantiles():
    assert chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert chi2_quantile(0.5, 1) == pytest.approx(0.45494, abs=1e-4)


def test_outliers_go_and_plain_texts_stay(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        n = int(rng.integers(60, 400))
        text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
        bad = i % 10 == 0
        rows.append((i, text.replace(" ", "### $%& ") if bad else text, ["en", None][i % 2], f"s{i % 3}", "x"))
    rows += [(900, "too short", "en", "s1", "x"), (901, None, None, None, None), (902, "a b c " * 50, "fr", "s9", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept string")
    got = {r.doc_id: r for r in judge_quality(df).collect()}
    assert len(got) == 403 and all(got[i].kept == (i % 10 != 0) for i in range(400))
    assert not any(got[i].kept for i in (900, 901, 902)) and got[902].base_failed and got[900].distance is None
    assert judge_quality(df.limit(0)).collect() == []


def numpy_estimate(x, share):
    """Least determinant over the same starts, with the closest rows taken by the same bins of the distance."""
    unit, floors = 1024, np.array([0.5, 0.4, 0.5, 0.5, 0.12])

    def moments(rows):
        mean = rows.mean(axis=0)
        return mean, (rows.T @ rows) / len(rows) - np.outer(mean, mean) + np.diag(floors**2)

    def closest(mean, cov, part, widest=False):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T) ** 2
        bins = np.floor(np.log((y.max(axis=0) if widest else y.sum(axis=0)) + 1e-6) * 64)
        order = np.sort(bins)
        below = np.searchsorted(order, order, "left")
        return x[bins <= order[below < len(x) * part].max()]

    q = np.quantile(x * unit, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf") / unit
    middle = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2 + floors**2)
    found = []
    for mean, cov in (middle, moments(x), moments(closest(*middle, 0.5, widest=True))):
        best = np.inf if mean is middle[0] else np.linalg.slogdet(cov)[1]
        for _ in range(20):
            new = moments(closest(mean, cov, share))
            det = np.linalg.slogdet(new[1])[1]
            if det >= best - 1e-3:
                break
            (mean, cov), best = new, det
        found.append((best, mean, cov))
    return min(found, key=lambda e: e[0])


def test_estimates_and_verdicts_against_numpy(spark):
    rng = np.random.default_rng(11)
    rows, groups = [], {}
    for i in range(420):
        source = ["a", "b", "c"][i % 3] if i < 400 else "few"
        n = int(rng.lognormal(5, 0.5)) + 60
        long = 3 if source == "a" else 6
        text = " ".join("w" * int(k) + str(j) for j, k in enumerate(rng.integers(2, 2 + 2 * long, n)))
        if i % 25 == 0:
            text = text.replace(" ", " ### ")
        if i % 40 == 1:
            text = "\n".join(["same line again"] * 60) + "\n" + text
        rows.append((i, text, "en", source, 5, 6, 7))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, g int, f0 int, m_0 int")
    got = judge_quality(df).collect()
    assert len(got) == len(rows) and {"g", "f0", "m_0"} <= set(got[0].asDict())
    cut, shrunk = chi2_quantile(1 - 1e-7, 5), None
    for r in got:
        assert (r.g, r.f0, r.m_0) == (5, 6, 7)
        per = max(r.n_words, 1)
        values = [math.log(1 + r.n_words), r.word_chars / per, math.log(1 + 1000 * r.n_symbols / max(r.word_chars, 1)), math.log(1 + r.n_dup_lines), math.sqrt(r.n_repeat_words / per)]
        if not r.base_failed:
            groups.setdefault(r.source, []).append((np.round(np.array(values) * 1024) / 1024, r))
    assert 15 < len(groups["few"]) < 30
    for source, held in groups.items():
        # The only group that is too small is judged by itself, as the rest of its language.
        x = np.array([v for v, _ in held])
        _, mean, cov = numpy_estimate(x, 0.75)
        d = (np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T) ** 2).sum(axis=0)
        scale = np.array([r.distance for _, r in held]) / d
        shrunk = shrunk or float(np.median(scale))
        assert np.allclose(scale, shrunk, rtol=1e-6), source
        assert [r.kept for _, r in held] == (d * shrunk <= cut).tolist()
    assert 0.4 < shrunk < 1 and any(not r.kept for _, r in groups["a"])


def test_subwords_are_shared_by_misspellings():
    grams, ends = subwords(["idiot", "idiiot", "é", "zebra"], 17)
    bags = [set(x.tolist()) for x in np.split(grams, ends[:-1])]
    assert len(bags[0] & bags[1]) >= 5 and not bags[0] & bags[3] and len(bags[2]) >= 2
    first, owner = passages(np.array([0, 1, 9, 4]), 4)
    assert first.tolist() == [0, 1, 4, 7, 10] and owner.tolist() == [1, 2, 2, 2, 3]


def test_toxicity_of_unseen_misspellings():
    rng = np.random.default_rng(2)
    plain = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    bad = ["horrible", "dreadful", "disgusting"]
    texts, labels = [], []
    for i in range(600):
        w = [str(x) for x in rng.choice(plain, 60)]
        if i % 4 == 0:
            for k in rng.integers(0, 60, 3):
                w[k] = bad[int(rng.integers(3))]
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = train(pa.array(texts), np.array(labels))
    some = " ".join(plain[:50])
    asked = [some, some + " horribble dreadfull", "", None, some * 40, "disgustin"]
    got = model.scores(pa.array(asked, pa.string()))
    assert got[1] > 0.7 > got[0] and got[4] < 0.7 and (0 <= got).all() and (got <= 1).all() and got[2] == got[3]
    one_sided = train(pa.array(texts[:3]), np.zeros(3))
    assert one_sided.scores(pa.array(["a", None])) == pytest.approx([0.125, 0.125])


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0), (1, None, 5.0), (None, "", 5.0)], "doc_id bigint, text string, toxic_score double")
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, 0, None)], "doc_id bigint, quality int, toxic int")
    got = score_toxicity(docs, labels)
    assert got.columns == ["doc_id", "text", "toxic_score"] and got.count() == 3
    assert score_toxicity(docs.limit(0), labels).collect() == []
    assert {r.toxic_score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert drop_toxic(docs, labels.limit(0)).count() == 3


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")
def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{n}.parquet")) for n in ("documents", "labels"))
    scored = score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"), labels).toPandas()
    held = scored.merge(labels.toPandas(), on="doc_id")
    held = held[[zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]]
    caught = held.toxic_score >= 0.7
    # About a fifth of the toxic labels of this small table are on texts without any such word.
    assert caught[held.toxic == 1].mean() > 0.55 and caught[held.toxic == 0].mean() < 0.02


def test_sample_passes_over_long_texts_and_copies(spark):
    ids = spark.range(300).select("id", F.xxhash64("id").alias("h"), learns_from(F.col("id"), 3, 1).alias("learns"))
    order = [r.id for r in ids.where("learns").orderBy("h").collect()]
    text = {i: f"plain words {i} " + ("horrible" if i % 3 == 0 else "lovely") for i in order}
    text[order[0]] = "long text " * 3000
    text[order[1]] = "rather long text " * 500
    text[order[3]] = None
    rows = [(i, t) for i, t in text.items()]
    rows += [(order[2], text[order[2]])] * 40 + [(order[4], f"other {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(-500, 300)], "doc_id bigint, quality int, toxic int")
    def sample(some, most_docs, most_chars):
        found = labelled_sample(some, labels, most_docs, most_chars, 3, 1)
        assert found.rdd.getNumPartitions() == 1
        return [tuple(r) for r in found.collect()]

    got, known = zip(*sample(docs, 4000, 12_000))
    want = {t or "" for t in text.values()} | {f"other {k}" for k in range(40)}
    assert sorted(got) == sorted(want - {text[order[0]]} - ({text[order[1]]} - set(got)))
    assert sum(map(len, got)) <= 12_000 and set(known) == {0, 1} and "" in got
    few = [t for t, _ in sample(docs, 20, 12_000)]
    assert len(few) == 20 and len(set(few) & {text[i] or "" for i in order}) >= 19
    assert [t for t, _ in sample(docs.where(F.length("text") > 8000), 20, 9000)] == [text[order[1]]]
