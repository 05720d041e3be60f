"""Searches from stored structures: stems, and cells of vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.operators import cells, english, ranking
from lexloom.operators.documents import fuse
from lexloom.rules.english import STEM_RULES, STOP_WORDS
from lexloom.session import shared_folder
from workload.case_queries import EXTRA as CASE_EXTRA
from workload.case_queries import Records, query_vector
from workload.tables import wide, with_tables

#: None of these forms need occur as it is written.
QUESTION = "The licenses under versions"


def _stored(spark, kind):
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _english(spark, folder):
    """A stem index of the own documents, written and read back."""
    path = _stored(spark, "english")
    rows = wide(Records(spark, folder)["chunks"]).select("id", "content")
    ranking.write_index(english.english_index(rows, "id", ["content"], buckets=8), path, shares=2)
    return ranking.read_index(spark, path)


def english_vocabulary(spark, folder):
    """Every different word of the documents but stop words, and its stem."""
    words = ranking.build_index(wide(Records(spark, folder)["documents"]), "doc_id", ["text"])
    return english.vocabulary(words.terms)


def english_matches(spark, folder):
    """Documents that have every word of a question in some form, best first."""
    found = english.english_matches(_english(spark, folder), QUESTION, 200)
    return found.select(F.col("key").alias("id"), F.round("score", 9).alias("score"))


def english_stop_words(spark, folder):
    """How many documents a question of stop words alone finds, and one with a word that no document has."""
    index = _english(spark, folder)
    found = lambda q: english.english_matches(index, q, 10).agg(F.count("*").alias("n")).withColumn("question", F.lit(q))
    return found("the of").union(found("licensed zzyzzy"))


def _cells(spark, folder):
    """The vectors by cell, written and read back."""
    path = _stored(spark, "cells")
    cells.write_cells(Records(spark, folder)["embeddings"], "vec_id", "embedding", path, cells=32)
    return cells.read_cells(spark, path)


def stored_vector_matches(spark, folder):
    """Best vectors by cosine similarity, from the cells that can hold them."""
    found = cells.nearest_in_cells(_cells(spark, folder), "vec_id", "embedding", query_vector(), 60)
    return found.hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def stored_hybrid_search(spark, folder):
    """Stems and cells fused: no text is split and no vector measured but those that can be found."""
    left = english.english_matches(_english(spark, folder), QUESTION, 75).withColumnRenamed("key", "id")
    t = Records(spark, folder)
    near = cells.nearest_in_cells(_cells(spark, folder), "vec_id", "embedding", query_vector(), 75).hits
    best = fuse(left, near.select((F.col("vec_id") + 1).alias("id"), "score"), "id", 25)
    return best.join(t["own_documents"].select("id", "title"), "id").select(
        "id", "title", "relevance", F.array_join("matched_by", "+").alias("matched_by"), "search_mode"
    )


QUERIES = {
    f.__name__: f
    for f in (english_vocabulary, english_matches, english_stop_words, stored_vector_matches, stored_hybrid_search)
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _stem(word):
    out = word
    for pattern, left in STEM_RULES:
        for i in range(9, 0, -1):
            left = left.replace(f"${i}", f"\\{i}")
        out = f"regexp_replace({out}, '{pattern}', '{left}')"
    return f"CASE WHEN regexp_full_match({word}, '[a-z]{{4,}}') THEN {out} ELSE {word} END"


#: Stems of the question, found by hand from the rules.
_STEMS = "'licens', 'vers'"

EXTRA = {
    **CASE_EXTRA,
    "words_of": """
SELECT doc_id, len(t) AS l, unnest(t) AS term FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM {documents})""",
    "stems": f"SELECT term, {_stem('term')} AS stem FROM (SELECT DISTINCT term FROM {{words_of}} WHERE term NOT IN ({_STOP}))",
    "stem_scores": f"""
SELECT doc_id + 1 AS id, CAST(count(*) AS DOUBLE) / any_value(l) AS score FROM {{words_of}} JOIN {{stems}} USING (term)
WHERE stem IN ({_STEMS}) GROUP BY doc_id HAVING count(DISTINCT stem) = 2""",
    "stem_ranks": "SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM {stem_scores} QUALIFY r <= 75",
    "cell_ranks": "SELECT vec_id + 1 AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM {vector_scores} QUALIFY r <= 75",
}
_SQL = {
    "english_vocabulary": "SELECT term, stem FROM {stems}",
    "english_matches": "SELECT id, round(score, 9) AS score FROM {stem_scores} ORDER BY round(score, 9) DESC, id LIMIT 200",
    "english_stop_words": "SELECT 0 AS n, 'the of' AS question UNION ALL SELECT 0, 'licensed zzyzzy'",
    "stored_vector_matches": "SELECT vec_id, label, score FROM {vector_scores} ORDER BY score DESC, vec_id LIMIT 60",
    "stored_hybrid_search": """
SELECT {docs}.id, title, round_even(rrf, 5) AS relevance, matched_by, 'hybrid' AS search_mode FROM (
  SELECT coalesce(t.id, v.id) AS id, coalesce(1.0 / (60 + t.r), 0) + coalesce(1.0 / (60 + v.r), 0) AS rrf, t.r AS tr, v.r AS vr,
    array_to_string(list_filter([CASE WHEN t.id IS NOT NULL THEN 'fulltext' END, CASE WHEN v.id IS NOT NULL THEN 'semantic' END], lambda x: x IS NOT NULL), '+') AS matched_by
  FROM {stem_ranks} t FULL JOIN {cell_ranks} v ON v.id = t.id
  ORDER BY rrf DESC, tr NULLS LAST, vr NULLS LAST LIMIT 25) f JOIN {docs} ON {docs}.id = f.id""",
}
ORACLE = {name: with_tables(sql, EXTRA) for name, sql in _SQL.items()}
