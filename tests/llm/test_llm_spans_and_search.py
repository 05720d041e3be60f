"""Repeated spans, source mixing, top products and the pipeline against plain Python."""

import hashlib
import itertools
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm.pfair import in_mixed_order, mix_sources, schedule, whole_parts
from lexloom.llm.repeats import remove_repeats
from lexloom.llm.topk import top_products

SCHEMA = "doc_id bigint, text string, kept string"


def brute_repeats(rows, size):
    least = {}
    order = [2**63 if d is None else d for d, _ in rows]
    data = [(t or "").encode() for _, t in rows]
    for d, b in zip(order, data):
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            least[s] = min(least.get(s, d), d)
    out = []
    for (doc_id, _), d, b in zip(rows, order, data):
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if least[b[p : p + size]] < d:
                gone[p : p + size] = b"\1" * size
        spans = sum(k for k, _ in itertools.groupby(gone))
        out.append((doc_id, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [50, 7])
def test_repeats_against_brute_force(spark, size):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(160))
    texts = [None, "", "x" * size, "x" * (size + 9), "y" * (size - 1), "ab" * 90, "ba" * 90]
    for _ in range(60):
        a, b = sorted(rng.sample(range(160), 2))
        texts.append("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90))) + passage[a:b] + rng.choice("qé") + passage[:b])
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[20]), (9, texts[9]), (None, passage), (None, passage + "!")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(7)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, size).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, size)


def test_repeats_of_an_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_schedule(parts):
    period, done, slots = sum(parts), [0] * len(parts), []
    for t in range(period):
        ready = [(-(-(d + 1) * period // q), i) for i, (d, q) in enumerate(zip(done, parts)) if d < q and d * period // q <= t]
        _, i = min(ready)
        done[i] += 1
        slots.append(i)
    return slots


@pytest.mark.parametrize("parts", [[1], [3, 5], [1, 2, 5, 8], [7, 7, 7, 7, 4], [60, 1, 1, 1, 1]])
def test_schedule_against_brute_force(spark, parts):
    rows = [(f"k{i}", q, sum(parts)) for i, q in enumerate(parts)]
    got = schedule(spark.createDataFrame(rows, "key string, parts bigint, period bigint")).collect()
    assert [int(r.key[1:]) for r in sorted(got, key=lambda r: r["at"])] == brute_schedule(parts)
    period = sum(parts)
    for i, q in enumerate(parts):
        taken = 0
        for t, j in enumerate(brute_schedule(parts)):
            taken += j == i
            assert abs(taken - (t + 1) * q / period) < 1


def test_parts_add_up(spark):
    weights = spark.createDataFrame([("a", 0), ("b", None), ("c", 5), ("d", 5), ("e", 10**12)], "key string, weight bigint")
    got = {r.key: (r.parts, r.period) for r in whole_parts(weights).collect()}
    assert sum(p for p, _ in got.values()) == 512 and {q for _, q in got.values()} == {512}
    assert got["a"][0] == got["b"][0] == 1 and got["e"][0] == 508
    nothing = whole_parts(spark.createDataFrame([("a", 0), ("b", 0)], "key string, weight bigint")).collect()
    assert sorted(r.parts for r in nothing) == [64, 64]


def test_mix_keeps_windows_and_all_rows(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else None) for i in range(600)] + [(i, f"t{i}", "small") for i in range(600, 640)]
    rows += [(7, "same", "big")] * 3 + [(None, None, "small")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, slot int")
    targets = spark.createDataFrame([("big", 0.5), (None, 0.3), ("small", 0.2)], "source string, weight double")
    got = mix_sources(docs, targets, block_docs=4).collect()
    assert len(got) == len(rows) - 2
    assert all(r.release <= r.slot < r.deadline for r in got)
    at = {}
    for r in got:
        assert at.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    mixed = in_mixed_order(docs, targets=targets, block_docs=4)
    assert mixed.columns == docs.columns
    assert sorted(mixed.collect(), key=str) == sorted(docs.collect(), key=str)
    start = [r.source for r in mixed.limit(80).collect()]
    assert 30 <= start.count("big") <= 50 and 8 <= start.count("small") <= 24


def test_mix_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mix_sources(empty).collect() == [] and in_mixed_order(empty).collect() == []


def brute_products(rows, every, k):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, tuple(int(np.floor(256 * float(x))) for x in v)))
    out = []
    for q, qv in dict.fromkeys(kept):
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(qv, cv)), c) for c, cv in kept if c != q and len(cv) == len(qv)]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_products_against_brute_force(spark, spread):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * np.exp(rng.normal() * spread)).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(10, rows[10][1])]
    rows += [(500, None), (510, [1.0, None]), (520, [float("nan")] * 6), (530, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(540, [0.0] * 6), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (560, []), (570, [1e7] * 6)]
    rows += [(571, [3.0] * 6)] * 3 + [(7, rows[7][1])] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    for limits in ({}, {"seeds": 8, "group_rows": 50, "query_rows": 7}):
        got = top_products(df, F.col("vec_id") % 10 == 0, k=5, **limits).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_products(rows, 10, 5)


def test_products_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_products(empty, F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="driver tables are absent")
def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, folder)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before), name
        assert len(after) > 0.8 * len(before), name
        if name == "mixing sources to target weights":
            assert after == before
    last = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in last} == set(after)
    assert all(len(r.token_ids) == r.n_tokens for r in last)


def brute_mix(counts, block, parts_each=64):
    """Source of every row of the mix, by earliest deadline first over square-root weights."""
    names = sorted(counts)
    period = 1 << (len(names) * parts_each - 1).bit_length()
    w = {s: round(counts[s] ** 0.5 * 1_000_000) for s in names}
    fair = {s: w[s] * (period - len(names)) for s in names}
    total = sum(w.values())
    parts = {s: 1 + fair[s] // total for s in names}
    for s in sorted(names, key=lambda s: (-(fair[s] % total), s))[: period - sum(parts.values())]:
        parts[s] += 1
    done, left, out, slot = dict.fromkeys(names, 0), dict(counts), [], 0
    while any(left.values()):
        due = [(-(-(done[s] + 1) * period // parts[s]), s) for s in names if done[s] * period // parts[s] <= slot]
        pick = min(due)[1]
        done[pick] += 1
        rows = min(block, left[pick])
        left[pick] -= rows
        out += [(slot, pick)] * rows
        slot += 1
    return out


def test_pipeline_result_is_mixed(spark, tmp_path):
    counts = {"a": 1500, "b": 900, "c": 400}
    rng = random.Random(5)
    rows = [(s, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))) for s, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.where("doc_id % 5 = 0").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("doc_id % 5 > 0").coalesce(2).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r.slot, r.source) for r in got] == brute_mix(counts, 128)
    assert all(a.in_block < b.in_block for a, b in zip(got, got[1:]) if a.slot == b.slot)


def test_last_stage_decodes_what_it_encodes(spark):
    texts = ["plain text", "é漢字 😀\n\ttabs", "", None, "a" * 5000]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in corpus_pipeline.byte_bpe(spark, docs, "").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_last_stage_shows_what_does_not_decode_to_its_text(spark, monkeypatch):
    # On a split of the text that loses spaces the ids do not give the text again.
    monkeypatch.setattr(corpus_pipeline.public_tokenizers, "PATTERN", "[^ ]+")
    docs = spark.createDataFrame([(1, "two words", "en", "s", 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    row = corpus_pipeline.byte_bpe(spark, docs, "").first()
    assert row.decoded_sha256 == hashlib.sha256(b"twowords").hexdigest() != row.text_sha256


def test_mix_without_texts(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}") for i in range(50)], "doc_id bigint, source string, text string")
    assert in_mixed_order(docs, text=None, block_docs=4).count() == 50
