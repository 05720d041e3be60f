"""Fill-in-middle over frames, and hard negatives, against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.llm.frames import (
    FramedText, Packer, fill_in_middle, find_markers, pack, restored, store_frames, stream, with_digests, with_text,
)
from lexloom.llm.hard_negatives import hard_negatives, open_windows, pack_key, unpack_key, window_of

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_text(rng):
    return "".join(rng.choice(["a", "é", "漢", "👩", " ", "\n", "\t", " ", "word ", "<P", ">", "\x00"]) for _ in range(rng.randint(0, 120)))


@pytest.mark.parametrize("most", [7, 64, 1 << 15])
def test_places_and_ranges_in_frames(most):
    rng, packer = random.Random(most), Packer(most)
    for _ in range(200):
        text = odd_text(rng)
        units = UNIT.findall(text)
        frames, counts, chars = pack(text.encode(), packer)
        assert b"".join(stream(frames)) == text.encode()
        assert (counts[-1] if counts else 0) == len(units) and (chars[-1] if chars else 0) == len(text)
        held = FramedText(frames, counts, chars)
        a, b = sorted((rng.randint(0, len(units)), rng.randint(0, len(units))))
        assert held.place(a)[2] == len("".join(units[:a]))
        assert held.between(a, b).decode() == "".join(units[a:b])
        low, high = sorted((rng.randint(0, len(text.encode())), rng.randint(0, len(text.encode()))))
        assert b"".join(stream(frames, low, high)) == text.encode()[low:high]


def test_only_cut_frames_are_unpacked():
    text = "word " * 20_000
    frames, units, chars = pack(text.encode(), packer := Packer(1000))
    held = FramedText(frames, units, chars)
    low, high = held.place(7_001), held.place(15_003)
    for ends in (((0, 0), low[:2]), (low[:2], high[:2]), (high[:2], (len(frames), 0))):
        held.copy(*ends, packer)
    assert b"".join(stream(packer.done())).decode() == text
    assert len(frames) > 90 and len(set(held.opened)) == 2


def test_markers_across_frames():
    frames = []
    for piece in (b"ab<", b"S", b">cd<P>", b"<M", b">"):
        packer = Packer(100)
        packer.raw(piece)
        frames += packer.done()
    assert find_markers(frames, (b"<P>", b"<S>", b"<M>", b"<X>")) == [7, 2, 10, -1]
    assert b"".join(restored(frames, "plain")) == b"ab<S>cd<P><M>"


@pytest.mark.parametrize("most", [16, 1 << 15])
def test_fill_in_middle_of_a_table(spark, most):
    rng = random.Random(9)
    texts = [None, "", " ", "\n\n", "x", "has <P> inside", "long " * 30_000, "w" * 50_000, *(odd_text(rng) for _ in range(150))]
    rows = [(i, t, "clash", "kept") for i, t in enumerate(texts)] + [(4, "again", "a", "b"), (4, "again", "a", "b"), (None, "no id here", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, framed string, n string").repartition(6)
    stored = store_frames(docs, frame_bytes=most)
    assert stored.columns == ["doc_id", "n", "framed"]
    moved = fill_in_middle(stored, frame_bytes=most)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in with_text(moved).collect()), key=str)
    assert got == sorted(((d, *brute_middle(d, t)) for d, t, *_ in rows), key=str)
    hashed = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in with_digests(moved).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert hashed == {(d, sha(brute_middle(d, t)[-1]), sha(t)) for d, t, *_ in rows}
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert with_digests(fill_in_middle(store_frames(docs))).collect() == []


def brute_negatives(rows, every, label_of, n_positives=5, n_negatives=3, low=50, high=95):
    usable = [(i, label_of(i, lab), [int((256 * x) // 1) for x in v]) for i, v, lab in rows
              if i is not None and lab is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = []
    for own, label, v in usable:
        if own % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, lab) for i, lab, w in usable if i != own and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(own, p, k, i, -s, -t) for k, (t, i, _) in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 5)])
def test_negatives_against_brute_force(spark, blocks):
    rng = random.Random(4)
    def vector():
        return [rng.choice([-0.5, -0.25, 0.0, 0.1, 0.25, 0.5]) for _ in range(4)]

    rows = [(i, vector(), rng.choice([0, 0, 0, 0, 1, 2, 9])) for i in range(-20, 150)]
    rows += [(5, rows[30][1], 0), (5, rows[30][1], 0), (10, vector(), 1), (10, rows[30][1], 0), (10, rows[30][1], 0)]
    rows += [(301, None, 1), (302, [1.0, None, 0.0, 0.0], 1), (303, [float("nan"), 0.0, 0.0, 0.0], 0), (304, [float("inf")] * 4, 0), (305, vector(), None), (None, vector(), 1)]
    rows += [(310 + i, [0.5, 0.25 * i], i % 2) for i in range(12)] + [(400 + i, [], i % 2) for i in range(4)] + [(420, [0.0] * 4, 0)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "vec_id bigint, embedding array<double>, label int, score string, part int").repartition(5)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(df, F.col("vec_id") % 5 == 0, moved, anchor_rows=blocks[0], block_rows=blocks[1])
    got = sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = brute_negatives(rows, 5, lambda i, lab: (lab + 1) % 10 if i % 7 == 0 else lab)
    assert got == want and len(want) > 100


def test_negatives_without_partners(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        assert hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, F.col("label")).collect() == []


def test_keys_sort_as_pairs_do():
    rng = random.Random(8)
    values = [0, 1, -1, 5, -7, 2**63 - 1, -(2**63), 10**12]
    pairs = [tuple(rng.choice(values) for _ in range(4)) for _ in range(300)]
    assert [unpack_key(k) for k in sorted(pack_key(*p) for p in pairs)] == sorted(pairs, key=lambda p: (p[0], p[1], -p[2], p[3]))


def test_windows_hold_little():
    assert window_of(101, 50, 95) == (51, 95) and window_of(0, 50, 95) == (0, 0) and window_of(-10, 50, 95)[0] > window_of(-10, 50, 95)[1]
    keys = ((pack_key(1, 0, 10**6 - i, i), i % 1000 == 0, 1) for i in range(10**5))
    assert len(list(open_windows(keys, 5, 3, 50, 95))) == 15


def test_dealt_by_anchor_in_order(spark):
    df = spark.range(4000).selectExpr("id as vec_id", "array(cast(id % 13 as double), cast(id % 7 as double)) as embedding", "cast(id % 3 as int) as label")
    found = hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label"), partitions=6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort [key#" in plan.replace("(", "") and "hashpartitioning(substring(key" in plan
