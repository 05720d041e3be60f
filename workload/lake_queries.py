"""The lake on disk: layouts written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.operators import corpus, ranking
from lexloom.plans import research
from lexloom.session import shared_folder
from lexloom.sources.lake import CaseLawLake, write_historical, write_layout, write_recent
from workload.corpus_queries import EXTRA as CORPUS_EXTRA
from workload.corpus_queries import has_terms
from workload.tables import Tables, with_tables

#: The court of the scoped queries.
SCOPE = "27_1"


#: Lakes written so far, by application and data folder: a lake is written once and read often.
_LAKES: dict[tuple[str, str], str] = {}


def _root(spark):
    return f"{shared_folder(spark).rstrip('/')}/lake-{uuid.uuid4().hex}"


def _lake(spark, folder):
    """All four layouts, written to the shared folder at the first call for a data folder."""
    known = (spark.sparkContext.applicationId, folder)
    if known in _LAKES:
        return CaseLawLake(spark, _LAKES[known])
    root = _LAKES[known] = _root(spark)
    sources = Tables(spark, folder).corpus_sources()
    write_layout(sources["sc"], root, "sc")
    write_layout(sources["hc"], root, "hc")
    write_historical(sources["historical"], root, "bhcr")
    write_recent(sources["recent"], root)
    return CaseLawLake(spark, root)


def lake_union(spark, folder):
    """The uniform corpus, from the layouts on disk."""
    return _lake(spark, folder).corpus()


def lake_scope(spark, folder):
    """The rows of one court; folders of others are not opened."""
    return _lake(spark, folder).corpus(SCOPE)


def lake_status(spark, folder):
    """Judgments and years of every court."""
    return _lake(spark, folder).status().drop("index_is_stale")


def lake_inventory(spark, folder):
    """Years held per court, from folder names."""
    years = _lake(spark, folder).inventory()
    return years.select("court_code", F.array_join("years", ",").alias("years"))


def lake_refresh(spark, folder):
    """The recent rows after a second write that has rows for even years only."""
    rows, root = Tables(spark, folder)["recent_raw"], _root(spark)
    write_recent(rows, root)
    again = rows.where("year % 2 = 0").withColumn("title", F.concat(F.lit("Corrected: "), "title"))
    write_recent(again.where("description not like '%bail%'"), root)
    return CaseLawLake(spark, root).source("recent").select("court", "year", "title", "pdf_link")


def lake_ranked_scope(spark, folder):
    """A ranked page of one court; scores by the stored index and by a scan must agree."""
    lake = _lake(spark, folder)
    path = f"{_root(spark)}-index"
    keyed = lake.corpus().withColumn("id", corpus.doc_id())
    ranking.write_index(ranking.build_index(keyed, "id", research.TEXT, buckets=8), path, shares=2)
    page = lambda index: lake.ranked_search("land state", index, SCOPE, limit=40).select(
        corpus.doc_id().alias("doc_id"), F.round("score", 6).alias("score")
    )
    return page(path).withColumn("by", F.lit("index")).union(page(None).withColumn("by", F.lit("scan")))


QUERIES = {
    f.__name__: f for f in (lake_union, lake_scope, lake_status, lake_inventory, lake_refresh, lake_ranked_scope)
}

_PAGE = f"""
SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM {{named}} LEFT JOIN {{land_scores}} USING (doc_id)
WHERE court_code = '{SCOPE}' AND {has_terms('land', 'state')} ORDER BY score DESC, decided DESC NULLS LAST, doc_id LIMIT 40"""

_SQL = {
    "lake_union": "SELECT * FROM {corpus}",
    "lake_scope": f"SELECT * FROM {{corpus}} WHERE court_code = '{SCOPE}'",
    "lake_status": "SELECT court_code, count(*) AS judgments, min(year) AS first_year, max(year) AS last_year FROM {corpus} GROUP BY court_code",
    "lake_inventory": "SELECT court_code, string_agg(DISTINCT year, ',' ORDER BY year) AS years FROM {corpus} GROUP BY court_code",
    # A court and year with any corrected row has lost its other rows.
    "lake_refresh": """
SELECT r.court, r.year, CASE WHEN c.court IS NULL THEN title ELSE 'Corrected: ' || title END AS title, pdf_link
FROM {recent_raw} r LEFT JOIN (SELECT DISTINCT court, year FROM {recent_raw} WHERE year % 2 = 0 AND NOT contains(description, 'bail')) c
  ON c.court = r.court AND c.year = r.year
WHERE c.court IS NULL OR NOT contains(r.description, 'bail')""",
    "lake_ranked_scope": f"SELECT *, 'index' AS by FROM ({_PAGE}) UNION ALL SELECT *, 'scan' AS by FROM ({_PAGE})",
}
EXTRA = {**CORPUS_EXTRA, "land_scores": CORPUS_EXTRA["corpus_scores"].replace("'bail', 'landbc', 'priority'", "'land', 'state'")}
ORACLE = {name: with_tables(sql, EXTRA) for name, sql in _SQL.items()}
