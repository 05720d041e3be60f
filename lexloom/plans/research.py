"""Case-law research: search, memo, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.functions.dates import iso_date
from lexloom.operators import citations, verification
from lexloom.operators.corpus import doc_id, hits
from lexloom.operators.ordering import first_per_key, page_of, top_per_group
from lexloom.operators.ranking import PostingsIndex, rank_index, rank_query
from lexloom.operators.related import related_proceedings
from lexloom.operators.search import has_term, matching, newest_first, search, split_terms

TEXT = ["title", "description", "judge"]


def search_case_law(corpus: DataFrame, query: str, ranked: bool = False, limit: int = 20, page: int = 0, **filters) -> DataFrame:
    """A page of hits, newest first or by BM25; both match the same rows."""
    if not query.strip():
        raise InvalidRequest("query must not be blank")
    if not ranked:
        return hits(search(corpus, query, limit, page, **filters))
    return hits(ranked_search(corpus, query, limit, page, **filters))


def ranked_search(
    corpus: DataFrame, query: str, limit: int = 20, page: int = 0, court_code: str | None = None, **filters
) -> DataFrame:
    """Uniform rows by BM25 score, then date, then id.

    Statistics cover the whole corpus, also where only the rows of one ``court_code`` are wanted; what matches is decided
    by the same predicate as in the unranked search. A row that only matches inside a word has score zero.
    """
    scored = rank_query(corpus, query, TEXT, keep_unscored=True)
    rows = matching(scored if court_code is None else scored.where(F.col("court_code") == court_code), query, **filters)
    return page_of(rows, [F.desc(F.round("score", 6)), *newest_first()], limit, page)


def indexed_search(
    corpus: DataFrame, index: PostingsIndex, query: str, limit: int = 20, page: int = 0, **filters
) -> DataFrame:
    """:func:`ranked_search` with the scores of a stored index, keyed by the id of a judgment.

    No text is split: the postings of the query's terms are read, and joined to the rows that match.
    """
    rows = matching(corpus.withColumn("__id", doc_id()), query, **filters)
    scored = rank_index(index, query).withColumnRenamed("key", "__id")
    joined = rows.join(scored, "__id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = [F.desc(F.round("score", 6)), *newest_first()]
    return page_of(joined, order, limit, page).drop("__id")


def research_memo(corpus: DataFrame, queries: list[str], max_authorities: int = 10, per_query: int = 10) -> DataFrame:
    """Authorities found by several queries, in query order, each once.

    Every query gives at most ``per_query`` rows, so what is merged is small.
    """
    if not queries:
        raise InvalidRequest("at least one query is needed")
    # One scan: every row is tested for all queries, and each query keeps its newest rows.
    tests = [
        F.when(reduce(lambda x, y: x & y, [has_term(t) for t in split_terms(query)], F.lit(True)), F.lit(i))
        for i, query in enumerate(queries)
    ]
    tested = corpus.select(
        F.array_compact(F.array(*tests)).alias("hits"), doc_id().alias("doc_id"), "title",
        iso_date(F.col("decision_date")).alias("decided"),
    )
    matched = tested.where(F.size("hits") > 0).select(F.explode_outer("hits").alias("query_no"), "doc_id", "title", "decided")
    union = top_per_group(
        matched, ["query_no"], [F.col("decided").desc_nulls_last(), F.col("doc_id")], max(0, per_query), "__rank"
    ).drop("__rank")
    union = union.withColumn("age", -F.datediff("decided", F.lit("1600-01-01").cast("date")))
    first = first_per_key(
        union, ["doc_id"], ["query_no", "age", "doc_id"], ["query_no", "title", "decided", "age"]
    )
    return (
        first.orderBy("query_no", F.col("age").asc_nulls_last(), "doc_id")
        .limit(max_authorities)
        .select("query_no", "doc_id", "title", "decided")
    )


def memo_status(corpus: DataFrame, queries: list[str]) -> DataFrame:
    """How many rows each query of a memo matches, in one scan."""
    from lexloom.operators.search import has_term, split_terms

    counts = []
    for i, query in enumerate(queries):
        condition = reduce(lambda a, b: a & b, [has_term(t) for t in split_terms(query)], F.lit(True))
        counts.append(F.struct(F.lit(i).alias("query_no"), F.lit(query).alias("query"), F.count_if(condition).alias("matches")))
    return corpus.agg(F.array(*counts).alias("a")).select(F.inline("a")).withColumn(
        "status", F.when(F.col("matches") > 0, "success").otherwise("not_found")
    )


def verify_texts(
    texts: DataFrame, key: str, text: str, corpus: DataFrame, acts: DataFrame, sections: DataFrame,
    aliases: DataFrame, budget: int | None = 20,
) -> DataFrame:
    """Verdict on every citation of every text; at most ``budget`` cases of each are checked, with None all."""
    found = citations.extract(texts, key, text, fields=verification.READ)
    return verification.sweep(found, key, corpus, acts, sections, aliases, budget)


def related_in_corpus(corpus: DataFrame, limit: int = 20) -> DataFrame:
    """Related proceedings of every judgment of a corpus."""
    texts = corpus.select(
        doc_id().alias("doc_id"), "title",
        F.concat_ws("\n", "title", "description").alias("body"),
        iso_date(F.col("decision_date")).alias("decided"),
    )
    seeds = texts.select(F.col("doc_id").alias("seed_id"), "title")
    return related_proceedings(seeds, texts, limit)
