"""English text search: stop words left out, word forms brought together by their stems.

Stems are worked out once per different word of a document, within its row, and counted there, so that no posting of a word
is moved; a query's words go through the same rules. The vocabulary of a collection is a table of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ranking import (
    TERM_BUCKETS, PostingsIndex, bucket_of, documents, index_stats, query_terms, runs, unpacked, with_packs,
)
from lexloom.rules.english import STEM_RULES, STEM_STEPS, STOP_WORDS
from lexloom.session import durable


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words of up to three letters, and those with other characters than a to z, are their own."""

    def step(rules, endings):
        def ruled(x):
            out = x
            for pattern, left in rules:
                out = F.regexp_replace(out, pattern, left)
            return F.when(F.substring(x, -2, 2).isin(*endings), out).otherwise(x)

        return ruled

    out, done = word, 0
    for n, endings in STEM_STEPS:
        # The word so far is an argument of an inner function, so it is worked out once.
        out = F.transform(F.array(out), step(STEM_RULES[done : done + n], endings))[0]
        done += n
    ends = sorted({e for _, endings in STEM_STEPS for e in endings})
    return F.when(F.substring(word, -2, 2).isin(*ends) & word.rlike("^[a-z]{4,}$"), out).otherwise(word)


def vocabulary(words: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of every different word that is no stop word."""
    different = words.where(~F.col(term).isin(*STOP_WORDS)).select(F.col(term).alias("term")).distinct()
    return different.withColumn("stem", stem(F.col("term")))


def english_index(df: DataFrame, key: str, text_columns: list[str], buckets: int = TERM_BUCKETS) -> PostingsIndex:
    """An index whose terms are stems, to be written and read like any other.

    ``tf`` adds up the forms of a word, ``length`` counts all words of a row, stop words too.
    """
    placed, words = runs(documents(df, key, text_columns), "t")
    # A document's stems, as often as its words, are counted like words within its row.
    kept = F.filter(words, lambda x: ~x["term"].isin(*STOP_WORDS))
    stems = F.flatten(F.transform(kept, lambda x: F.array_repeat(stem(x["term"]), x["tf"])))
    stemmed, counted = runs(placed.select("key", "length", F.sort_array(stems).alias("stems")), "stems")
    # Readers: the postings, the statistics and the keys that occur again. Texts are read and moved once.
    docs = durable(with_packs(stemmed, counted, "packs", buckets))
    again = durable(docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("again")))
    rows = docs.select("key", "length", F.explode("packs").alias("p")).select("key", "length", "p.*")
    same = F.col("key").eqNullSafe(F.col("again"))
    packed = rows.join(again, same, "left_anti")
    # Rows under one key add up, however many there are.
    loose = (
        unpacked(rows.join(again, same, "left_semi")).groupBy("key", "term", "bucket")
        .agg(F.first("length").alias("length"), F.sum("tf").cast("int").alias("tf"))
        .select("key", "length", "term", "tf", "bucket")
    )
    postings = unpacked(packed).unionByName(loose)
    terms = postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    return PostingsIndex(postings, terms, index_stats(docs, buckets), packed, loose)


def query_stems(index: PostingsIndex, query: str) -> list[tuple[str, int]]:
    """(stem, bucket) of the words of a query that are no stop words, each once."""
    words = [t for t in query_terms(query) if t not in STOP_WORDS]
    if not words:
        return []
    spark = index.postings.sparkSession
    buckets = index.stats.first().buckets
    asked = spark.createDataFrame([(w,) for w in words], "term string").select(stem(F.col("term")).alias("stem")).distinct()
    rows = asked.select("stem", bucket_of(F.col("stem"), buckets).alias("bucket")).collect()
    return sorted((r.stem, r.bucket) for r in rows)


def english_matches(index: PostingsIndex, query: str, k: int, score: str = "score") -> DataFrame:
    """(key, score): the best ``k`` rows that have every word of the query in some form.

    The score is the share of the row's words that are forms of the query's; ties go to the smaller key. Only
    the buckets of the query's stems are read. A query of stop words alone matches nothing.
    """
    stems = query_stems(index, query)
    asked = F.col("bucket").isin([b for _, b in stems]) & F.col("term").isin([s for s, _ in stems])
    # Each row has one posting per stem.
    found = index.postings.where(asked if stems else F.lit(False)).groupBy("key").agg(
        F.count("*").alias("n"), (F.sum("tf") / F.first("length")).alias(score)
    )
    return found.where(F.col("n") == len(stems)).select("key", score).orderBy(F.desc(F.round(score, 9)), "key").limit(k)
