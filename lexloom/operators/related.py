"""Proceedings that share the parties of a judgment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import party_terms
from lexloom.operators.ordering import top_per_group
from lexloom.operators.terms import match_all_terms
from lexloom.session import durable


def related_proceedings(seeds: DataFrame, texts: DataFrame, limit: int = 20) -> DataFrame:
    """(seed_id, doc_id, rank): newest ``limit`` others with all party terms of a seed.

    ``seeds`` has ``seed_id`` and ``title``; ``texts`` has ``doc_id``, ``body`` and
    ``decided`` (a date). Seeds with equal terms share one lookup. Its best
    ``limit + 1`` rows are enough for each of them, since a seed leaves out itself only.
    """
    named = seeds.select(
        "seed_id",
        F.array_sort(
            F.array_distinct(F.transform(party_terms(F.col("title")), F.lower))
        ).alias("terms"),
    ).withColumn("query_id", F.array_join("terms", " "))
    sets = durable(named.select("query_id", "terms").distinct())
    dated = match_all_terms(sets, texts.select("doc_id", "body", "decided"), "doc_id", "body")
    order = [F.col("decided").desc_nulls_last(), F.col("doc_id")]
    best = top_per_group(
        dated.select("query_id", "doc_id", "decided"), ["query_id"], order, limit + 1, "place"
    )
    # At most limit + 1 places per set; each seed takes them without its own.
    places = best.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "doc_id"))).alias("places")
    )
    met = named.select("seed_id", "query_id").join(places, "query_id")
    others = F.filter("places", lambda p: p["doc_id"] != F.col("seed_id"))
    return met.select(
        "seed_id", F.posexplode(F.slice(others, 1, limit)).alias("i", "p")
    ).select("seed_id", F.col("p.doc_id").alias("doc_id"), (F.col("i") + 1).alias("rank"))
