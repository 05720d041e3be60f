import os
from datetime import date

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.errors import CorpusNotSynced, InvalidRequest, SourceUnavailable
from lexloom.operators import corpus as corpora
from lexloom.operators import ranking, search
from lexloom.operators.courts import court_code, resolve_scope
from lexloom.operators.related import related_proceedings
from lexloom.operators.terms import match_all_terms
from lexloom.plans import research
from lexloom.sources import schemas
from lexloom.sources.lake import CaseLawLake, write_historical, write_recent

SC = [
    ("ANIL RAO versus THE STATE OF GOA", "Appeal on sections 302/34 IPC.", "ASHA M. KULKARNI",
     "[2024] 10 S.C.R. 108", "SC1", "25-09-2024", "Allowed", "2024INSC735", "2024_10_108_125"),
    ("MEERA SEN versus THE STATE OF GOA", "Bail and territorial jurisdiction.", "RAVI DAS",
     "[2024] 5 S.C.R. 629", "SC2", "12-05-2024", "Dismissed", "2024INSC448", "2024_5_629_729"),
]
SC_COLUMNS = ["title", "description", "judge", "citation", "cnr", "decision_date", "disposal_nature", "nc_display", "path"]
HC = [("MCA/130/2024 of CLARA DIAS Vs OM NAIK", "Substituted service.", "REGISTRAR",
       "court/orders/HCBM01_1_2024-04-25.pdf", "HC1", "2024-04-25", "Allowed", True)]
HC_COLUMNS = ["title", "description", "judge", "pdf_link", "cnr", "decision_date", "disposal_nature", "pdf_exists"]


def write_file(folder, rows, columns):
    os.makedirs(folder)
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)})
    pq.write_table(table, f"{folder}/metadata.parquet")


def harvested(spark, rows):
    return spark.createDataFrame(rows, schemas.HARVESTED)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    write_file(f"{root}/sc/metadata/year=2024", SC, SC_COLUMNS)
    write_file(f"{root}/hc/metadata/year=2024/court=27_1/bench=hcbgoa", HC, HC_COLUMNS)
    write_historical(
        harvested(spark, [("27_1", 1866, "bhcr", "Reg. v. Bapu", None, None, None, "1866-01-01", "p/old.pdf", None)]),
        root, "bhcr",
    )
    write_recent(
        harvested(
            spark,
            [
                ("27_1", 2026, "bombay", "Uma v. Dev", "Uma v. Dev", "J", "WP/1/2026 (X1)", "2026-02-01", "recent/x1.pdf", "http://x/1"),
                ("SC", 2026, "", "Goa v. Union", "Goa v. Union", "", "", "2026-03-01", "recent/sc1.pdf", "http://x/2"),
            ],
        ),
        root,
    )
    return CaseLawLake(spark, root)


def titles(df):
    return [r.title for r in df.collect()]


def test_uniform_columns_and_null_rules(lake):
    rows = {r.title: r for r in lake.corpus().collect()}
    assert len(rows) == 6
    sc, hc, hist = rows[SC[0][0]], rows[HC[0][0]], rows["Reg. v. Bapu"]
    assert (sc.court_code, sc.decision_date, sc.bench, sc.neutral_citation) == ("SC", "2024-09-25", None, "2024INSC735")
    assert (hc.citation, hc.bench, hc.year) == (None, "hcbgoa", "2024")
    assert (hist.citation, hist.description, hist.src) == ("", "", "hist")


def test_search(lake):
    assert titles(lake.search("anil rao")) == [SC[0][0]]
    assert titles(lake.search("Anil Kerala")) == []
    assert titles(lake.search("territorial jurisdiction")) == [SC[1][0]]
    assert titles(lake.search("goa", court="Supreme Court")) == ["Goa v. Union", SC[0][0], SC[1][0]]
    assert titles(lake.search("goa", court="Bombay High Court")) == []
    assert titles(lake.search("DIAS", court="Bombay High Court")) == [HC[0][0]]
    assert titles(lake.search("goa", judge="kulkarni")) == [SC[0][0]]
    assert titles(lake.search("state goa", from_date="2024-06-01")) == [SC[0][0]]
    assert titles(lake.search("state goa", to_date="2024-06-01")) == [SC[1][0]]
    assert titles(lake.search("O'Brien")) == []
    assert titles(lake.search("100%")) == []
    with pytest.raises(InvalidRequest):
        lake.search("goa", from_date="01-06-2024")


def test_recent_rows_of_other_courts_stay_out_of_a_court_scope(lake):
    codes = {r.court_code for r in lake.corpus("Supreme Court").collect()}
    assert codes == {"SC"}
    assert {r.court_code for r in lake.corpus("Bombay").collect()} == {"27_1"}


def test_scope_prunes_partitions_and_branches(lake):
    plan = lake.corpus("27_1")._jdf.queryExecution().executedPlan().toString()
    assert "sc/metadata" not in plan
    assert "PartitionFilters" in plan and "27_1" in plan


def test_missing_corpus_is_an_error(spark, tmp_path):
    empty = CaseLawLake(spark, str(tmp_path))
    with pytest.raises(CorpusNotSynced):
        empty.corpus()
    with pytest.raises(CorpusNotSynced):
        empty.find_by_citation("2024INSC735")


@pytest.mark.parametrize(
    "text, n",
    [("[2024] 10 S.C.R. 108", 1), ("(2024) 10 SCR 108", 1), ("2024 10 SCR 108", 1), ("2024INSC735", 1),
     ("[2024] 99 S.C.R. 9999", 0), ("2024INSC999999", 0)],
)
def test_find_by_citation(lake, text, n):
    assert lake.find_by_citation(text).count() == n


def test_ids_and_urls(lake):
    rows = lake.corpus().select(
        corpora.doc_id().alias("id"), corpora.public_url("/a").alias("url"), "title"
    )
    got = {r.title: (r.id, r.url) for r in rows.collect()}
    assert got[SC[0][0]][0] == "sc:2024:2024_10_108_125"
    assert got[SC[0][0]][1].endswith("/data/pdf/year=2024/english/2024_10_108_125_EN.pdf")
    assert got[HC[0][0]][0] == "hc:27_1:hcbgoa:2024:HCBM01_1_2024-04-25.pdf"
    assert got["Reg. v. Bapu"] == ("hist:27_1:bhcr:1866:old.pdf", "/a/historical/bhcr/pdfs")
    assert got["Uma v. Dev"] == ("rc:27_1:bombay:2026:x1.pdf", "http://x/1")
    ids = rows.select(F.col("id").alias("doc_id"))
    back = corpora.find_by_doc_id(lake.corpus(), ids)
    assert {(r.doc_id, r.title) for r in back.collect()} == {(v[0], k) for k, v in got.items()}


def test_malformed_id_fails(spark):
    with pytest.raises(Exception, match="malformed document id"):
        spark.range(1).select(corpora.parse_doc_id(F.lit("sc:1")).alias("p")).collect()


def test_inventory(lake):
    assert {r.court_code: r.years for r in lake.inventory().collect()} == {
        "SC": ["2024", "2026"], "27_1": ["1866", "2024", "2026"],
    }
    assert {r.court_code for r in lake.harvested_courts("historical").collect()} == {"27_1"}


def test_status_names_a_stale_index(lake, spark, tmp_path):
    index = ranking.build_index(lake.corpus().withColumn("id", corpora.doc_id()), "id", ["title", "description", "judge"])
    ranking.write_index(index, str(tmp_path / "ix"), shares=2)
    rows = {r.court_code: r for r in lake.status(str(tmp_path / "ix")).collect()}
    assert rows["SC"].judgments == 3 and rows["27_1"].first_year == "1866"
    assert rows["SC"].index_is_stale is False
    assert lake.status().first().index_is_stale is None


def paged(spark, n):
    rows = [
        (f"PAGING MATTER {i} versus THE STATE", f"number {i}", "J", f"[2024] 1 S.C.R. {i}", f"C{i}",
         f"{i:02d}-01-2024", "Allowed", f"2024INSC10{i:02d}", f"2024_1_{i}_{i}", "2024")
        for i in range(1, n + 1)
    ]
    return corpora.uniform_view({"sc": spark.createDataFrame(rows, SC_COLUMNS + ["year"])})


def test_pages_tile(spark):
    rows = paged(spark, 5)
    pages = [
        [r.id for r in search.search(rows, "paging matter", 2, p).select(corpora.doc_id().alias("id")).collect()]
        for p in range(4)
    ]
    assert pages[0] == ["sc:2024:2024_1_5_5", "sc:2024:2024_1_4_4"]
    assert [len(p) for p in pages] == [2, 2, 1, 0] and len(set(sum(pages, []))) == 5
    first = search.search(rows, "paging matter", 2, -3).select(corpora.doc_id().alias("id"))
    assert [r.id for r in first.collect()] == pages[0]
    keyed, after = [], None
    while True:
        got = search.search_after(rows, "paging matter", 2, after).select(
            search.iso_date(F.col("decision_date")).alias("d"), corpora.doc_id().alias("id")
        ).collect()
        if not got:
            break
        keyed += [r.id for r in got]
        after = (str(got[-1].d), got[-1].id)
    assert keyed == sum(pages, [])


def test_ranked_search_matches_the_same_rows(spark):
    rows = paged(spark, 5)
    ranked = research.ranked_search(rows, "paging matter", 10)
    assert {r.locator for r in ranked.collect()} == {r.locator for r in search.search(rows, "paging matter", 10).collect()}
    # A part of a word matches too; it just scores zero.
    assert research.ranked_search(rows, "pagi", 10).count() == 5


def brute_bm25(docs, terms):
    import math
    import re

    tok = {k: [t for t in re.split(r"[^\w]+", v.lower()) if t] for k, v in docs.items()}
    n, mean = len(tok), sum(map(len, tok.values())) / len(tok)
    out = {}
    for k, ts in tok.items():
        s = 0
        for t in terms:
            df = sum(t in x for x in tok.values())
            tf = ts.count(t)
            if tf:
                s += math.log((n - df + .5) / (df + .5) + 1) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(ts) / mean))
        if s:
            out[k] = s
    return out


def test_bm25_scan_and_index_agree_with_brute_force(spark, tmp_path):
    docs = {1: "bail bail appeal", 2: "appeal against conviction", 3: "lease deed", 4: "bail", 5: ""}
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    want = brute_bm25(docs, ["bail", "appeal"])
    scan = {r.id: r.score for r in ranking.rank_query(df, "bail appeal", ["text"]).collect()}
    ranking.write_index(ranking.build_index(df, "id", ["text"]), str(tmp_path / "ix"))
    index = ranking.read_index(spark, str(tmp_path / "ix"))
    stored = {r.key: r.score for r in ranking.rank_index(index, "bail appeal").collect()}
    assert scan == pytest.approx(want) and stored == pytest.approx(want)


def test_stale_index(spark, tmp_path):
    import os
    import time

    df = spark.createDataFrame([(1, "a")], "id long, text string")
    df.write.parquet(str(tmp_path / "src"))
    ranking.write_index(ranking.build_index(df, "id", ["text"]), str(tmp_path / "ix"))
    source = spark.read.parquet(str(tmp_path / "src"))
    stats = spark.read.parquet(str(tmp_path / "ix/stats"))
    assert ranking.index_is_stale(source, stats).first().stale is False
    for f in (tmp_path / "src").glob("*.parquet"):
        os.utime(f, (time.time() + 60, time.time() + 60))
    source = spark.read.parquet(str(tmp_path / "src"))
    assert ranking.index_is_stale(source, stats).first().stale is True


def test_court_names(spark):
    names = ["Bombay High Court at Goa", "27_1", "supreme court", "Kolkata", "nowhere", "SC"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.c for r in df.select("n", court_code(F.col("n")).alias("c")).collect()}
    assert got == {"Bombay High Court at Goa": "27_1", "27_1": "27_1", "supreme court": "SC",
                   "Kolkata": "19_16", "nowhere": None, "SC": "SC"}
    assert resolve_scope(None) == "all" and resolve_scope("Bombay High Court at Goa") == "27_1"
    with pytest.raises(SourceUnavailable):
        resolve_scope("nowhere")


def test_match_all_terms_is_exact(spark):
    texts = {1: "Customer Annapurna versus Bihari Lal", 2: "ANNA Bihar", 3: "annabihar co", 4: "Bihar"}
    queries = {"a": ["anna", "bihar"], "b": ["bihar"], "c": ["zzzz", "bihar"], "d": []}
    t = spark.createDataFrame(list(texts.items()), "k int, body string")
    q = spark.createDataFrame(list(queries.items()), "query_id string, terms array<string>")
    got = {(r.query_id, r.k) for r in match_all_terms(q, t, "k", "body").collect()}
    want = {
        (qid, k) for qid, ts in queries.items() for k, body in texts.items()
        if ts and all(x in body.lower() for x in ts)
    }
    assert got == want


def test_related_proceedings_against_brute_force(spark):
    from lexloom.functions.text import party_terms

    names = ["Alpha Mills", "Bravo Steel", "Charlie Works"]
    rows = [
        (f"d{i:02d}", f"WP/{i}/2020 of {names[i % 3]} Vs {names[(i // 3) % 3]}", date(2020, 1, 1 + i % 28) if i % 7 else None)
        for i in range(60)
    ]
    texts = spark.createDataFrame(rows, "doc_id string, title string, decided date").withColumn("body", F.col("title"))
    seeds = texts.select(F.col("doc_id").alias("seed_id"), "title")
    got = {(r.seed_id, r.doc_id, r["rank"]) for r in related_proceedings(seeds, texts, 4).collect()}
    terms = {r.doc_id: sorted({t.lower() for t in r.t}) for r in texts.select("doc_id", party_terms(F.col("title")).alias("t")).collect()}
    want = set()
    for seed, _, _ in rows:
        others = [(d is None, -(d.toordinal() if d else 0), k) for k, title, d in rows
                  if k != seed and all(t in title.lower() for t in terms[seed])]
        want |= {(seed, k, i + 1) for i, (_, _, k) in enumerate(sorted(others)[:4])}
    assert got == want


def test_research_memo(lake):
    rows = research.research_memo(lake.corpus(), ["bail", "goa"], 3).collect()
    assert [(r.query_no, r.title) for r in rows] == [(0, SC[1][0]), (1, "Goa v. Union"), (1, SC[0][0])]
    status = {r.query: (r.matches, r.status) for r in research.memo_status(lake.corpus(), ["goa", "zzz"]).collect()}
    assert status == {"goa": (3, "success"), "zzz": (0, "not_found")}
