"""The lake on disk: partitions, plain folders, replaced partitions, inventories."""

import pathlib

import pytest
from pyspark.sql import functions as F

from lexloom.errors import CorpusNotSynced, InvalidRequest
from lexloom.operators import corpus as corpora
from lexloom.operators import ranking
from lexloom.plans import research
from lexloom.sources import schemas
from lexloom.sources.lake import CaseLawLake, write_historical, write_layout, write_recent


def recent(spark, rows):
    full = [(c, y, "b", t, t, "J", "WP", f"{y}-01-01", f"p/{t}.pdf", None) for c, y, t in rows]
    return spark.createDataFrame(full, schemas.HARVESTED)


def high(spark, rows):
    full = [(t, "about it", "J", f"p/{t}.pdf", t, None, f"{y}-01-01", "Allowed", True, y, c, b) for y, c, b, t in rows]
    return spark.createDataFrame(full, schemas.HIGH_COURT)


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(root).rglob("*.parquet")}


def test_only_touched_partitions_are_replaced(spark, tmp_path):
    root = str(tmp_path)
    write_recent(recent(spark, [("27_1", 2024, "a"), ("27_1", 2025, "b"), ("SC", 2024, "c")]), root)
    before = files(root)
    write_recent(recent(spark, [("27_1", 2025, "b2"), ("33_1", 2024, "d")]), root)
    after = files(root)
    kept = {p for p in before if "year=2025" not in p}
    assert kept and all(after[p] == before[p] for p in kept)
    rows = {(r.court, r.year, r.title) for r in CaseLawLake(spark, root).source("recent").collect()}
    assert rows == {("27_1", 2024, "a"), ("27_1", 2025, "b2"), ("SC", 2024, "c"), ("33_1", 2024, "d")}


def test_scope_opens_its_own_folders(spark, tmp_path):
    root = str(tmp_path)
    write_layout(high(spark, [("2020", "27_1", "g", "x"), ("2020", "33_1", "m", "y"), ("2021", "27_1", None, "z")]), root, "hc")
    write_recent(recent(spark, [("27_1", 2024, "a"), ("33_1", 2024, "b")]), root)
    write_historical(recent(spark, [("27_1", 1900, "old"), ("33_1", 1900, "older")]), root, "bhcr")
    lake = CaseLawLake(spark, root)
    scoped = lake.corpus("27_1")
    assert {r.title for r in scoped.collect()} == {"x", "z", "a", "old"}
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert len(filters) == 3 and all("27_1" in f for f in filters)
    # What the scans of the scope open.
    opened = scoped.select(F.input_file_name().alias("f")).distinct().collect()
    assert opened and all("court=27_1" in r.f for r in opened)


def test_plain_folders_beside_partitions(spark, tmp_path):
    root = str(tmp_path)
    write_recent(recent(spark, [("27_1", 2025, "new")]), root)
    for court in ("27_1", "SC"):
        recent(spark, [(court, 2024, f"plain {court}")]).coalesce(1).write.parquet(f"{root}/recent/{court}")
    recent(spark, [("27_1", 1866, "found")]).write.parquet(f"{root}/historical/bhcr")
    lake = CaseLawLake(spark, root)
    assert {r.title for r in lake.corpus().collect()} == {"new", "plain 27_1", "plain SC", "found"}
    assert {r.title for r in lake.corpus("SC").collect()} == {"plain SC"}
    assert all("recent/SC" in r.f for r in lake.source("recent", "SC").where("court = 'SC'").select(F.input_file_name().alias("f")).collect())
    held = {r.court_code: r.years for r in lake.inventory().collect()}
    assert held == {"27_1": ["1866", "2024", "2025"], "SC": ["2024"]}


def test_inventory_opens_no_file(spark, tmp_path):
    root = str(tmp_path)
    write_layout(high(spark, [("2020", "27_1", "g h/ü:x", "x"), ("2021", None, "", "y")]), root, "hc")
    write_recent(recent(spark, [("27_1", 2024, "a")]), root)
    lake = CaseLawLake(spark, root)
    values = sorted(lake.partitions("hc"), key=str)
    assert values == [{"year": "2020", "court": "27_1", "bench": "g h/ü:x"}, {"year": "2021", "court": None, "bench": None}]
    # Folder names alone: what the files hold does not matter.
    for path in pathlib.Path(root).rglob("*.parquet"):
        if path.is_file():
            path.write_bytes(b"broken")
    assert {r.court_code: r.years for r in lake.inventory().collect()} == {"27_1": ["2020", "2024"], None: ["2021"]}
    assert {r.court_code for r in lake.harvested_courts("recent").collect()} == {"27_1"}


def test_status_counts_from_footers(spark, tmp_path):
    root = str(tmp_path)
    write_layout(high(spark, [("2020", "27_1", "g", "x"), ("2021", "27_1", "g", "y")]), root, "hc")
    status = CaseLawLake(spark, root).status()
    assert [(r.court_code, r.judgments, r.first_year, r.last_year) for r in status.collect()] == [("27_1", 2, "2020", "2021")]
    assert "ReadSchema: struct<>" in status._jdf.queryExecution().executedPlan().toString()


def test_index_and_scan_give_one_order_within_a_scope(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = [("2020", c, "g", f"{w} matter {i}") for i in range(40) for c, w in (("27_1", "land" if i % 3 else "land lease"), ("33_1", "lease"))]
    write_layout(high(spark, rows), root, "hc")
    lake, path = CaseLawLake(spark, root), str(tmp_path / "ix")
    ranking.write_index(ranking.build_index(lake.corpus().withColumn("id", corpora.doc_id()), "id", research.TEXT), path)
    page = lambda index: [(r.title, round(r.score, 6)) for r in lake.ranked_search("land lease", index, "27_1", limit=30).collect()]
    assert page(path) == page(None) and len(page(None)) == 14


def test_empty_lake_and_unknown_layout(spark, tmp_path):
    lake = CaseLawLake(spark, str(tmp_path))
    for broken in (lake.inventory, lake.corpus, lambda: lake.harvested_courts("recent")):
        with pytest.raises(CorpusNotSynced):
            broken()
    with pytest.raises(InvalidRequest):
        write_layout(recent(spark, []), str(tmp_path), "later")
