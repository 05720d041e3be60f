"""Filtered, ordered and paged search over the uniform corpus."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.functions.dates import iso_date
from lexloom.functions.text import citation_key
from lexloom.operators.corpus import doc_id
from lexloom.operators.ordering import page_of


def split_terms(query: str) -> list[str]:
    """Whitespace-separated terms of a query, lower case."""
    return [t for t in re.split(r"\s+", query.strip().lower()) if t]


def _bound(value: str | date | None) -> Column | None:
    if value is None:
        return None
    try:
        day = value if isinstance(value, date) else date.fromisoformat(value)
    except ValueError as error:
        raise InvalidRequest(f"dates must be YYYY-MM-DD, got {value!r}") from error
    return F.lit(day)


def has_term(term: str, wildcards: bool = False) -> Column:
    """Term in title or description, ignoring case.

    ``wildcards`` lets ``%`` and ``_`` act as SQL wildcards.
    """
    title, description = F.lower(F.col("title")), F.lower(F.col("description"))
    if wildcards:
        pattern = f"%{term}%".replace("\\", "\\\\")
        return F.coalesce(title.like(pattern), F.lit(False)) | description.like(pattern)
    return F.coalesce(title.contains(term), F.lit(False)) | description.contains(term)


def matching(
    corpus: DataFrame,
    query: str = "",
    judge: str | None = None,
    from_date: str | date | None = None,
    to_date: str | date | None = None,
    wildcards: bool = False,
) -> DataFrame:
    """Rows that contain every term and satisfy the optional bounds.

    A date bound leaves out rows whose date is missing or does not parse.
    """
    for term in split_terms(query):
        corpus = corpus.where(has_term(term, wildcards))
    if judge:
        corpus = corpus.where(F.lower(F.col("judge")).contains(judge.lower()))
    decided = iso_date(F.col("decision_date"))
    low, high = _bound(from_date), _bound(to_date)
    if low is not None:
        corpus = corpus.where(decided >= low)
    if high is not None:
        corpus = corpus.where(decided <= high)
    return corpus


def newest_first() -> list[Column]:
    """Date descending, undated last, document id as tie-break."""
    return [iso_date(F.col("decision_date")).desc_nulls_last(), doc_id().asc()]


def search(
    corpus: DataFrame, query: str = "", limit: int = 20, page: int = 0, **filters
) -> DataFrame:
    """One page of matching rows, newest first."""
    return page_of(matching(corpus, query, **filters), newest_first(), limit, page)


def search_after(
    corpus: DataFrame,
    query: str = "",
    limit: int = 20,
    after: tuple[str | None, str] | None = None,
    **filters,
) -> DataFrame:
    """The page that follows the hit ``after = (ISO date or None, doc_id)``.

    Deep pages cost no more than the first: nothing before the key is ordered.
    """
    rows = matching(corpus, query, **filters)
    if after is not None:
        last_date, last_id = after
        decided, key = iso_date(F.col("decision_date")), doc_id()
        if last_date is None:
            rows = rows.where(decided.isNull() & (key > last_id))
        else:
            bound = _bound(last_date)
            rows = rows.where(
                decided.isNull() | (decided < bound) | ((decided == bound) & (key > last_id))
            )
    return rows.orderBy(*newest_first()).limit(max(0, limit))


def count_matches(corpus: DataFrame, query: str = "", **filters) -> DataFrame:
    """Number of matching rows, apart from any page."""
    return matching(corpus, query, **filters).agg(F.count("*").alias("total_found"))


def with_citation_keys(corpus: DataFrame) -> DataFrame:
    """Rows exploded to one per non-empty citation key (reported and neutral)."""
    keys = F.array_distinct(
        F.filter(
            F.array(citation_key(F.col("citation")), citation_key(F.col("neutral_citation"))),
            lambda k: k != "",
        )
    )
    return corpus.withColumn("citation_key", F.explode(keys))


def find_by_citation(corpus: DataFrame, citation: str, limit: int = 5) -> DataFrame:
    """Rows whose reported or neutral citation has the key of ``citation``."""
    key = re.sub(r"[\s.\[\]()]+", "", citation).lower()
    same = (citation_key(F.col("citation")) == key) | (
        citation_key(F.col("neutral_citation")) == key
    )
    return corpus.where(same).orderBy(doc_id()).limit(limit)
