"""English matching over stems, and exact vector search from cells."""

import random

import pytest

from lexloom.errors import InvalidRequest
from lexloom.operators import cells, english, ranking
from lexloom.operators.documents import vector_leg


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "term string")
    return {r.term: r.s for r in df.select("term", english.stem(df.term).alias("s")).collect()}


def test_forms_of_a_word_have_one_stem(spark):
    families = [
        ["indemnity", "indemnities"], ["license", "licenses", "licensed", "licensing"], ["party", "parties"],
        ["terminate", "terminated", "terminating", "termination"], ["plan", "planned", "planning", "plans"],
        ["agree", "agrees", "agreement", "agreements"], ["match", "matches", "matched"], ["arbitrator", "arbitration", "arbitrate"],
    ]
    found = stems(spark, [w for family in families for w in family])
    for family in families:
        assert len({found[w] for w in family}) == 1, {w: found[w] for w in family}
    assert len({found[family[0]] for family in families}) == len(families)
    own = ["the", "bus", "s302", "über", "1881", "sing", "being", "this"]
    assert all(k == v for k, v in stems(spark, own[:6]).items())


def stored(spark, rows, folder, **options):
    df = spark.createDataFrame(rows, "id bigint, text string")
    ranking.write_index(english.english_index(df, "id", ["text"], **options), folder, shares=2)
    return ranking.read_index(spark, folder)


def test_matching(spark, tmp_path):
    rows = [
        (1, "The indemnity of the parties"), (2, "Indemnities and a party"), (3, "party party"), (4, None), (5, ""),
        (6, "indemnity " * 3 + "party"), (7, "the of the"),
    ]
    index = stored(spark, rows, str(tmp_path / "ix"), buckets=4)
    find = lambda q, k=10: [(r.key, round(r.score, 6)) for r in english.english_matches(index, q, k).collect()]
    assert find("indemnities, PARTIES")[:2] == [(6, 1.0), (2, 0.5)] and [k for k, _ in find("indemnities party")] == [6, 2, 1]
    assert find("the of") == find("") == find("unheard indemnity") == []
    assert find("parties", 1) == [(3, 1.0)]
    plan = english.english_matches(index, "party", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_vocabulary_has_each_word_once(spark):
    words = spark.createDataFrame([("parties",), ("parties",), ("the",), ("party",)], "term string")
    assert sorted(tuple(r) for r in english.vocabulary(words).collect()) == [("parties", "parti"), ("party", "parti")]


def vectors(rng, n, dim, groups=6):
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i, [m + rng.gauss(0, 0.15) for m in middles[i % groups]]) for i in range(n)]


@pytest.mark.parametrize("n_cells", [1, 8])
def test_cells_find_what_a_scan_finds(spark, tmp_path, n_cells):
    rng = random.Random(n_cells)
    rows = vectors(rng, 600, 12) + [(1000 + i, v) for i, (_, v) in enumerate(vectors(rng, 30, 5))]
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [1.0] + [None] * 11), (2003, [float("nan")] * 12), (7, rows[7][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, cell string").drop("cell").repartition(4)
    cells.write_cells(df, "vec_id", "embedding", str(tmp_path / "c"), cells=n_cells)
    held = cells.read_cells(spark, str(tmp_path / "c"))
    usable = df.where("vec_id is null or vec_id not in (2000, 2001, 2002, 2003)")
    shares = []
    for k in (1, 10, 700):
        for _, query in rng.sample(rows[:600], 3) + [rows[610]]:
            mine = usable.where(f"size(embedding) = {len(query)}")
            want = [(r.vec_id, round(r.score, 6)) for r in vector_leg(mine, "vec_id", "embedding", query, k).collect()]
            found = cells.nearest_in_cells(held, "vec_id", "embedding", query, k)
            assert [(r.vec_id, round(r.score, 6)) for r in found.hits.collect()] == want
            shares.append((k, found.cells_read, found.cells_held))
    if n_cells > 1:
        assert min(read / all_ for k, read, all_ in shares if k == 10) < 0.5


def test_cells_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    cells.write_cells(df, "vec_id", "embedding", str(tmp_path / "c"))
    held = cells.read_cells(spark, str(tmp_path / "c"))
    assert cells.nearest_in_cells(held, "vec_id", "embedding", [1.0], 3).hits.count() == 0
    with pytest.raises(InvalidRequest):
        cells.nearest_in_cells(held, "vec_id", "embedding", [1.0], 0)


def test_steps_of_stems_leave_out_no_rule(spark):
    import itertools

    from pyspark.sql import functions as F

    from lexloom.rules.english import STEM_RULES, STEM_STEPS

    assert sum(n for n, _ in STEM_STEPS) == len(STEM_RULES)
    ends = ["", "s", "es", "ies", "ied", "sses", "xes", "ches", "zzes", "ing", "ingly", "ed", "edly", "ly", "ational", "ation", "ator", "ative", "ate", "at",
            "ment", "ness", "able", "ible", "ance", "ence", "ity", "ful", "ive", "ion", "al", "e", "y", "bb", "nn", "tted", "rring", "us", "is", "ias"]
    heads = ["pa", "plan", "agr", "stry", "bee", "mm", "xy", "oxa", "indemn", "ss"]
    words = sorted({h + "".join(e) for h in heads for e in itertools.product(ends, ends)})
    df = spark.createDataFrame([(w,) for w in words], "word string").where("word rlike '^[a-z]{4,}$'")
    plain = F.col("word")
    for pattern, left in STEM_RULES:
        plain = F.regexp_replace(plain, pattern, left)
    assert df.count() > 10_000
    assert df.where(english.stem(F.col("word")) != plain).count() == 0


def test_rows_under_one_key_add_up(spark, tmp_path):
    rows = [(1, "party the"), (1, "parties party x"), (None, "party"), (None, "indemnity"), (2, None), (3, "the"), (4, "party zz zz")]
    index = stored(spark, rows, str(tmp_path / "ix"), buckets=4)
    got = sorted(((r.key, r.term, r.tf) for r in index.postings.collect()), key=str)
    assert got == sorted([(1, "parti", 3), (1, "x", 1), (None, "parti", 1), (None, "indemn", 1), (4, "parti", 1), (4, "zz", 2)], key=str)
    assert sorted(map(tuple, index.terms.select("term", "df").collect())) == [("indemn", 1), ("parti", 3), ("x", 1), ("zz", 1)]
    stats = index.stats.first()
    assert (stats.n, round(stats.mean_length, 6), stats.buckets) == (7, round(11 / 7, 6), 4)
    assert [(r.key, r.score) for r in english.english_matches(index, "party", 1).collect()] == [(None, 1.0)]


def test_postings_of_an_english_index_are_moved_packed(spark):
    """Of a document, a row per bucket goes to where its bucket is written, not one per word."""
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300))
    df = spark.createDataFrame([(i, text) for i in range(20)], "id bigint, text string")
    index = english.english_index(df, "id", ["text"], buckets=4)
    assert index.packed.count() == 20 * 4 and index.loose.count() == 0 and index.postings.count() == 20 * 300
    assert sorted(map(tuple, ranking.unpacked(index.packed).collect())) == sorted(map(tuple, index.postings.collect()))
