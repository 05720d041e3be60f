"""Many multi-term queries against many texts, without comparing every pair.

A text matches a query when each of its terms occurs in it as a substring. Terms
are runs of ASCII letters, so an occurrence lies inside one letter run ("word") of the
text. The distinct words of the corpus are matched to terms through the terms' first four
letters; each query is then looked up by its two rarest terms together, against the pairs that the
terms of one text form, and the other terms are checked on the rows found. So
two common names in many queries read only the texts that have both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import durable

GRAM = 4


def _letter_runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def match_all_terms(
    queries: DataFrame, texts: DataFrame, text_key: str, text: str
) -> DataFrame:
    """``query_id`` and the columns of ``texts`` where every term occurs in the text.

    ``queries`` has ``query_id`` and ``terms`` (array of ASCII-letter words of at
    least four letters). Callers should pass distinct term sets. Queries without
    terms match nothing.
    """
    asked = queries.where(F.size("terms") > 0).select(
        "query_id", F.transform("terms", lambda t: F.lower(t)).alias("terms")
    )
    postings = texts.select(
        F.col(text_key).alias("__key"), F.explode(_letter_runs(F.col(text))).alias("word")
    )
    vocabulary = postings.groupBy("word").agg(F.count("*").alias("df"))

    grams = vocabulary.withColumn(
        "gram",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length("word") - (GRAM - 1)),
                    lambda i: F.substring(F.col("word"), i, F.lit(GRAM)),
                )
            )
        ),
    )
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    # Terms with the words that contain them: small, and needed twice.
    inside = durable(
        terms.withColumn("gram", F.substring("term", 1, GRAM))
        .join(grams, "gram")
        .where(F.contains("word", "term"))
        .select("term", "word", "df")
    )
    weights = inside.groupBy("term").agg(F.sum("df").alias("weight"))

    # A term found in no word gives weight 0: its query matches nothing.
    per_term = (
        asked.select("query_id", "terms", F.explode("terms").alias("term"))
        .join(weights, "term", "left")
        .withColumn("weight", F.coalesce("weight", F.lit(0)))
    )
    ordered = per_term.groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.struct("weight", "term"))).alias("by_weight"), F.first("terms").alias("terms")
    )
    # The two rarest; a single term stands for both.
    second = F.least(F.size("by_weight"), F.lit(2))
    pair = F.array_sort(F.array(F.col("by_weight")[0]["term"], F.element_at("by_weight", second)["term"]))
    seeds = durable(
        ordered.where(F.col("by_weight")[0]["weight"] > 0).select(
            "query_id", "terms", pair[0].alias("a"), pair[1].alias("b")
        )
    )
    # Words that hold a term of some seed; then per text those terms, and the pairs they form.
    used = seeds.select(F.explode(F.array("a", "b")).alias("term")).distinct()
    words = inside.join(used, "term", "left_semi").groupBy("word").agg(F.collect_set("term").alias("of"))
    held = postings.join(words, "word").groupBy("__key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("of")
    )
    pairs = held.select("__key", "of", F.explode("of").alias("a")).select(
        "__key", "a", F.explode(F.filter("of", lambda b: b >= F.col("a"))).alias("b")
    )
    found = pairs.join(seeds, ["a", "b"]).select("query_id", "terms", "__key")
    return (
        found.withColumnRenamed("__key", text_key)
        .join(texts, text_key)
        .where(F.forall("terms", lambda t: F.contains(F.lower(F.col(text)), t)))
        .select("query_id", *texts.columns)
    )
