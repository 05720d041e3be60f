"""Line dedup, near copies and components against plain Python."""

import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import near_texts
from lexloom.llm.components import components
from lexloom.llm.line_runs import LineRuns, drop_common_lines
from lexloom.llm.near_texts import drop_similar, similar_groups
from lexloom.llm.simhash import drop_near_copies, links, near_copies

SCHEMA = "doc_id bigint, text string, source string, n_lines string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def rows_of(texts):
    return [(i, t, None, "x") for i, t in enumerate(texts)]


def brute_lines(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    having = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            having.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(having[key(x)]) >= least)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def lines_of(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_lines_edge_cases(spark):
    rows = rows_of(
        [None, "", "A\nb\n", " a \nÄ\nä", "\ta\x0b\nä\n\n", "a", "A\r\nlong " * 500, "ä\nA", "b"]
    ) + [(7, "ä\nA", None, "x"), (7, "other\nb", None, "x"), (None, "a\nq", "s", None), (None, "b\nq", "s", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for batches in (1, 3, 5):
        got = lines_of(drop_common_lines(df, min_docs=3, batches=batches, fanout=2))
        assert got == brute_lines(rows, 3)
    kept = drop_common_lines(df, min_docs=3)
    assert kept.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]


def test_lines_of_an_empty_table(spark):
    assert drop_common_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_are_compacted_and_keep_their_counts(spark):
    runs = LineRuns(spark, enough=100, fanout=2)
    for i in range(5):
        runs.add(spark.range(20).selectExpr("id as h1", "id % 7 as h2", f"{i + 1} as n"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.n for r in runs.counts().collect()} == {15}


def test_common_keys_are_not_added_again(spark):
    runs = LineRuns(spark, enough=2, fanout=9)
    for _ in range(3):
        runs.add(spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "h1 bigint, h2 bigint, n bigint"))
    assert {(r.h1, r.n) for r in runs.counts().collect()} == {(1, 2), (2, 2)}


def brute_fingerprint(text, width):
    w = words(text)
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("distance", [0, 3, 7])
def test_near_copies_against_brute_force(spark, distance):
    base = " ".join(f"w{i % 37}x{i}" for i in range(400))
    texts = [None, "", " \t", "one", "One", "two words", base, base.upper(), base + " tail", "pre " + base]
    texts += [base.replace(f"x{i} ", f"y{i} ") for i in (5, 50, 200)] + ["é è ê " * 30, " a b c d"]
    rows = rows_of(texts) + [(6, base, None, "x"), (3, "two words", None, "x"), (None, "alone here now", None, "x")]
    got = near_copies(spark.createDataFrame(rows, SCHEMA), width=3, distance=distance).collect()
    prints = [brute_fingerprint(t, 3) for _, t, *_ in rows]
    groups = brute_groups(prints, distance)
    want = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if groups[j] == groups[i] and rows[j][0] is not None]
        want.append((doc_id, prints[i], min(ids, default=None)))
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("distance,segments", [(3, None), (5, 3), (7, 4), (4, 2), (1, 1)])
def test_every_link_is_found(spark, distance, segments):
    seeds = [xxhash.xxh64_intdigest(str(i)) for i in range(12)]
    prints = {s ^ sum(1 << (7 * k + i) % 64 for k in range(n)) for i, s in enumerate(seeds) for n in range(9)}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    got = {(r.u % 2**64, r.v % 2**64) for r in links(spark.createDataFrame(signed, "fp bigint"), distance, segments).collect()}
    want = {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= distance}
    assert {frozenset(x) for x in got} == want and len(got) == len(want)


def test_one_of_each_group_stays(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = rows_of([base + " end", base, base, "quite another text of its own", None, ""]) + [(None, base, None, "x")]
    kept = drop_similar(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == SCHEMA.replace("bigint", "").replace("string", "").replace(" ", "").split(",")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]
    assert drop_similar(spark.createDataFrame([], SCHEMA)).collect() == []


def changed(rng, words_, edits):
    out = list(words_)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def five_shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = five_shingles(a), five_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_planted_near_copies_are_found(spark):
    rng = random.Random(21)
    texts, pairs = [], []
    for i in range(150):
        own = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(own))
        other = changed(rng, own, rng.randint(1, max(1, len(own) // 40)))
        if similarity(texts[-1], other) >= 0.8:
            pairs.append((len(texts) - 1, len(texts)))
        texts.append(other)
    groups = {r.doc_id: r.root for r in similar_groups(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    found = sum(groups[a] == groups[b] for a, b in pairs)
    assert len(pairs) > 80 and found >= 0.95 * len(pairs), (found, len(pairs))
    # Nothing else is joined.
    assert all(similarity(texts[a], texts[b]) >= 0.8 for a in range(0, 300, 2) for b in [a + 1] if groups[a] == groups[b])
    assert len(set(groups.values())) == 300 - found - sum(groups[a] == groups[a + 1] for a in range(0, 300, 2) if (a, a + 1) not in pairs)


def test_dissimilar_texts_do_not_link(spark):
    texts = ["a b c d e f g h", "a b c d e f g i", "z y x w v u t s", "A B C D E F G H", " \t", None]
    groups = {r.doc_id: r.root for r in similar_groups(spark.createDataFrame(rows_of(texts), SCHEMA), width=1).collect()}
    assert groups[0] == groups[3] and groups[4] == groups[5] and len(set(groups.values())) == 4


def test_a_large_group_is_not_listed_in_pairs(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(220)]
    texts = [changed(rng, base, 1) for _ in range(400)] + [changed(rng, [f"v{i}" for i in range(200)], 1) for _ in range(40)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    nodes = spark.createDataFrame(
        [(i, [int(x) for x in row]) for i, row in enumerate(near_texts.fingerprints(pa.array(texts), 3, 3).view("<i8"))], "node bigint, prints array<bigint>"
    )
    stars = near_texts.star_pairs(nodes, 3)
    assert stars.count() <= 9 * len(texts)
    groups = {r.doc_id: r.root for r in similar_groups(docs).collect()}
    assert len({groups[i] for i in range(400)}) == 1 and len(set(groups.values())) == 2
    rooted = nodes.withColumn("root", F.when(F.col("node") < 400, 0).otherwise(400))
    assert near_texts.cross_pairs(rooted.select("node", "root", "prints"), 3).count() == 0


def test_tallies_end_chance_meetings_and_lose_no_link(spark):
    rng = random.Random(8)
    texts = ["", " ", "one", "two words", "a b c d e f", "a b c d e g"]
    for _ in range(60):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(6, 500))]
        texts += [" ".join(own), changed(rng, own, rng.randint(0, max(1, len(own) // 30)))]
    tallied = [(i, [int(n) for n in row]) for i, row in enumerate(near_texts.tallies(pa.array(texts), 5))]
    assert [sum(t) for _, t in tallied] == [len(five_shingles(t)) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    left = near_texts.possible_pairs(
        spark.createDataFrame(pairs, "u bigint, v bigint"), spark.createDataFrame(tallied, "node bigint, tally array<int>"), 0.8
    )
    kept = {(r.u, r.v) for r in left.collect()}
    links = {(i, j) for i, j in pairs if similarity(texts[i], texts[j]) >= 0.8}
    assert len(links) > 20 and links <= kept and len(kept) < len(pairs) / 20


def test_near_copies_of_an_empty_table(spark):
    assert near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {found[i] for i in range(61)} == {0}
    assert {found[i] for i in range(100, 140)} == {100}
    assert {found[i] for i in (200, 201, 202)} == {200} and 300 not in found
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_hashes_of_rows_differ_by_id_and_text(spark):
    rows = spark.createDataFrame([(1, "a", None, "x"), (1, "b", None, "x")], SCHEMA)
    kept = drop_near_copies(rows, width=3, distance=0)
    assert kept.select(F.count("*")).first()[0] == 2
