"""Own documents: ingest, chunks, passages and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexloom.errors import InvalidRequest, SourceUnavailable
from lexloom.functions.regex import around, flagged, quote, sql_string, with_located
from lexloom.functions.text import count_token, strip, with_tokens
from lexloom.functions.vectors import cosine
from lexloom.operators.matters import clamp
from lexloom.operators.ranking import query_terms
from lexloom.rules import drafts

# --- ingest --------------------------------------------------------------------


def with_content_hash(df: DataFrame, content: str) -> DataFrame:
    """Add ``sha256`` of the content."""
    return df.withColumn("sha256", F.sha2(F.col(content), 256))


def first_copies(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row per distinct content: the one with the smallest ``key``.

    Hashes and keys alone are shuffled; rows follow on their own unique key, so a
    content with very many copies does not gather in one task.
    """
    hashed = with_content_hash(df, content)
    keep = hashed.groupBy("sha256").agg(F.min(key).alias(key)).select(key)
    return hashed.join(keep, key, "left_semi")


def new_documents(incoming: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """First copies of incoming documents whose content is not stored yet."""
    fresh = with_content_hash(incoming, content).join(
        stored.select("sha256").distinct(), "sha256", "left_anti"
    )
    keep = fresh.groupBy("sha256").agg(F.min(key).alias(key)).select(key)
    return fresh.join(keep, key, "left_semi")


# --- chunks ----------------------------------------------------------------------


def chunk_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks of each document at its structural breaks: key, index, content, heading.

    Small units are joined while they stay under 200 characters together; units
    over 1800 are split at blank lines, but a paragraph is never cut.
    """
    breaks = flagged(drafts.STRUCTURE_BREAK, multiline=True)
    marks = sql_string(breaks)
    # A piece is a break with the text up to the next one, so it is never cut out of the whole.
    cut = (
        df.select(key, text)
        .selectExpr(key, text, f"regexp_extract_all({text}, {marks}, 0) AS raws", f"split({text}, {marks}, -1) AS gaps")
        .selectExpr(
            key, text,
            "concat(slice(gaps, 1, 1), zip_with(raws, slice(gaps, 2, size(raws)), (raw, gap) -> concat(raw, gap))) AS pieces",
        )
    )
    pieces = F.filter(F.transform("pieces", strip), lambda s: s != "")
    whole = F.array(strip(F.col(text)))
    units = F.when(F.size(pieces) > 0, pieces).otherwise(whole)
    folded = _fold(cut.select(key, units.alias("units")), key)
    # The outer form: the other one adds a filter on the chunks, which is pushed below all of the above.
    numbered = folded.select(key, F.posexplode_outer("chunks").alias("chunk_index", "content")).where(
        "content IS NOT NULL"
    )
    line = strip(F.substring_index("content", "\n", 1))
    return numbered.withColumn(
        "heading_path", F.when(F.length(line) < drafts.HEADING_CHARS, line)
    )


def _groups(lengths: Column, breaks: Callable[[Column, Column], Column], alone: Callable[[Column], Column]) -> Column:
    """How texts of ``lengths`` fall into chunks: array of ``struct<first, count, alone>``.

    ``breaks(held, n)`` says whether a text of ``n`` characters starts a new chunk when ``held`` characters wait;
    ``alone(n)`` whether it is a chunk of its own. Only whole numbers are carried along, so
    the fold is linear in the text.
    """
    none = F.array().cast("array<struct<first:int,count:int,alone:boolean>>")

    def state(held, first, done):
        return F.struct(held.cast("int").alias("held"), first.cast("int").alias("first"), done.alias("done"))

    def closed(s, upto, last=None):
        entry = F.struct(
            s["first"].alias("first"), (upto - s["first"]).cast("int").alias("count"), F.lit(False).alias("alone")
        )
        waiting = F.when(s["held"] > 0, F.array(entry)).otherwise(none)
        return F.concat(s["done"], waiting) if last is None else F.concat(s["done"], waiting, F.array(last))

    def step(s, x):
        i, n = x["i"], x["n"]
        own = F.struct(i.alias("first"), F.lit(1).alias("count"), F.lit(True).alias("alone"))
        empty = s["held"] == 0
        return (
            F.when(alone(n), state(F.lit(0), i + 1, closed(s, i, own)))
            .when(breaks(s["held"], n), state(n, i, closed(s, i)))
            .otherwise(
                state(
                    F.when(empty, n).otherwise(s["held"] + 2 + n), F.when(empty, i).otherwise(s["first"]), s["done"]
                )
            )
        )

    placed = F.transform(lengths, lambda n, i: F.struct(i.alias("i"), n.alias("n")))
    begin = state(F.lit(0), F.lit(0), none)
    return F.aggregate(placed, begin, step, lambda s: closed(s, F.lit(2**30)))


def _joined(texts: Column, group: Column) -> Column:
    return F.array_join(F.slice(texts, group["first"] + 1, group["count"]), "\n\n")


def _fold(df: DataFrame, key: str) -> DataFrame:
    """(key, chunks) from (key, units): short units joined, long ones cut at their blank lines."""
    size = F.col("units")
    grouped = df.select(
        key,
        "units",
        _groups(
            F.transform(size, F.length),
            lambda held, n: held + n >= drafts.MIN_CHUNK_CHARS,
            lambda n: n > drafts.MAX_CHUNK_CHARS,
        ).alias("groups"),
    )
    # Each long unit's paragraphs are packed on their own.
    split = F.transform(
        F.filter("units", lambda u: F.length(u) > drafts.MAX_CHUNK_CHARS),
        lambda u: F.split(u, "(?U)" + drafts.PARAGRAPH_BREAK, -1),
    )
    parted = grouped.select(key, "units", "groups", split.alias("long"))

    def packed(paragraphs):
        groups = _groups(
            F.transform(paragraphs, F.length),
            lambda held, n: (held + n > drafts.MAX_CHUNK_CHARS) & (held > 0),
            lambda n: F.lit(False),
        )
        return F.transform(groups, lambda g: strip(_joined(paragraphs, g)))

    cut = parted.select(key, "units", "groups", F.transform("long", packed).alias("long"))
    units, long = F.col("units"), F.col("long")
    # The long chunks are taken in turn: a group that stands alone has its place among those before it.
    alone = F.filter("groups", lambda g: g["alone"])
    first_of = F.transform(alone, lambda g: g["first"])
    placed = cut.select(key, "units", "groups", "long", first_of.alias("firsts"))
    # Named a second time outside the function, a column is worked out once, not per group.
    ready = (F.size(units) >= 0) & (F.size(long) >= 0) & (F.size("firsts") >= 0)
    chunks = F.when(
        ready,
        F.transform(
            "groups",
            lambda g: F.when(
                g["alone"], F.get(long, (F.array_position(F.col("firsts"), g["first"]) - 1).cast("int"))
            ).otherwise(F.array(_joined(units, g))),
        ),
    )
    return placed.select(key, F.filter(F.flatten(chunks), lambda c: c != "").alias("chunks"))


def with_embeddings(
    df: DataFrame, text: str, provider: Callable[[], Callable[[list[str]], list[list[float]]]] | None,
    out: str = "embedding", batch: int = 256,
) -> DataFrame:
    """Add the embedding of each text.

    ``provider`` is called once per task and returns the function that embeds a
    list of texts. Without a provider the semantic leg is unavailable.
    """
    if provider is None:
        raise SourceUnavailable("no embedding provider is configured")

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for part in parts:
            texts = part.tolist()
            vectors = []
            for i in range(0, len(texts), batch):
                vectors += model(texts[i : i + batch])
            yield pd.Series(vectors)

    return df.withColumn(out, embed(F.col(text)))


# --- reading ---------------------------------------------------------------------


def passages(df: DataFrame, key: str, text: str, query: str, limit: int = drafts.PASSAGE_LIMIT) -> DataFrame:
    """First passages around any term of the query, taken literally, ignoring case."""
    terms = query.split()
    if not terms:
        raise InvalidRequest("query must not be blank")
    pattern = flagged("(?:" + "|".join(quote(t) for t in terms) + ")", ignore_case=True)
    located = with_located(df.select(key, text), text, pattern, "m", limit)
    exploded = located.select(key, text, F.explode("m").alias("m"))
    end = F.col("m.pos") + F.length("m.raw")
    return exploded.select(
        key, F.col("m.pos").alias("position"), F.col("m.raw").alias("matched"),
        strip(
            around(F.col(text), F.col("m.pos"), end, drafts.PASSAGE_CONTEXT, drafts.PASSAGE_CONTEXT)
        ).alias("passage"),
    )


def truncated(df: DataFrame, text: str, max_chars: int) -> DataFrame:
    """Cut the text to ``max_chars`` (0 keeps all) and say whether it was cut."""
    if max_chars <= 0:
        return df.withColumn("truncated", F.lit(False))
    return df.withColumn("truncated", F.length(text) > max_chars).withColumn(
        text, F.substring(text, 1, max_chars)
    )


def with_child_counts(parents: DataFrame, children: DataFrame, key: str, out: str) -> DataFrame:
    """Parents with the number of their children, zero included."""
    counts = children.groupBy(key).agg(F.count("*").alias(out))
    return parents.join(counts, key, "left").withColumn(
        out, F.coalesce(out, F.lit(0).cast("bigint"))
    )


def newest_documents(docs: DataFrame, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """Own documents newest first, with the number of their chunks; ``limit`` is kept within 1 to 500."""
    owned = chunks.select(F.col("document_id").alias("id"))
    counted = with_child_counts(docs, owned, "id", "chunk_count")
    return counted.orderBy(F.desc("created_at"), F.desc("id")).limit(clamp(limit, 1, 500))


def by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``keys``; a key without a row is no error."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


# --- hybrid retrieval --------------------------------------------------------------


def text_leg(chunks: DataFrame, key: str, text: str, query: str, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` chunks that contain every query token, by token frequency."""
    terms = query_terms(query)
    if not terms:
        raise InvalidRequest("query must not be blank")
    held = with_tokens(chunks, F.col(text), "__t")
    for i, term in enumerate(terms):
        held = held.withColumn(f"__n{i}", count_token(F.col("__t"), term))
    every = F.least(*[F.col(f"__n{i}") for i in range(len(terms))], F.lit(2**31 - 1)) > 0
    frequency = sum((F.col(f"__n{i}") for i in range(1, len(terms))), F.col("__n0"))
    ranked = held.where(every).select(
        *chunks.columns, (frequency.cast("double") / F.size("__t")).alias(score)
    )
    return ranked.orderBy(F.desc(F.round(score, 9)), key).limit(k)


def vector_leg(
    chunks: DataFrame, key: str, embedding: str, query: Sequence[float], k: int, score: str = "score"
) -> DataFrame:
    """Best ``k`` chunks by cosine similarity; rows without a vector are left out."""
    scored = chunks.where(F.col(embedding).isNotNull()).withColumn(
        score, cosine(F.col(embedding), query)
    )
    return scored.where(F.col(score).isNotNull()).orderBy(F.desc(F.round(score, 6)), key).limit(k)


def fuse(text_hits: DataFrame, vector_hits: DataFrame | None, key: str, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of the two legs.

    Ties keep the text leg's order first, then the vector leg's. Without a vector
    leg the mode is ``fulltext_only``.
    """
    def ranked(df, name):
        # A leg holds at most 3 * limit rows, so this window is small.
        digits = 9 if name == "text_rank" else 6
        order = Window.orderBy(F.desc(F.round("score", digits)), key)
        return df.select(key, (F.row_number().over(order) - 1).alias(name))

    left = ranked(text_hits, "text_rank")
    if vector_hits is None:
        both = left.withColumn("vector_rank", F.lit(None).cast("int"))
        mode = "fulltext_only"
    else:
        both = left.join(ranked(vector_hits, "vector_rank"), key, "full_outer")
        mode = "hybrid"

    def share(rank):
        return F.coalesce(F.lit(1.0) / (drafts.RRF_K + F.col(rank) + 1), F.lit(0.0))

    fused = both.withColumn("rrf", share("text_rank") + share("vector_rank"))
    return (
        fused.orderBy(
            F.desc("rrf"), F.col("text_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last()
        )
        .limit(limit)
        .select(
            key,
            F.bround("rrf", 5).alias("relevance"),
            F.array_compact(
                F.array(
                    F.when(F.col("text_rank").isNotNull(), "fulltext"),
                    F.when(F.col("vector_rank").isNotNull(), "semantic"),
                )
            ).alias("matched_by"),
            F.lit(mode).alias("search_mode"),
        )
    )


def search_documents(
    chunks: DataFrame, documents: DataFrame, query: str, vector: Sequence[float] | None = None,
    matter_id: int | None = None, doc_type: str | None = None, limit: int = 10,
) -> DataFrame:
    """Hybrid search over chunks joined to their documents."""
    n = clamp(limit, 1, 50)
    joined = chunks.join(
        documents.select(F.col("id").alias("document_id"), "title", "doc_type", "matter_id"), "document_id"
    )
    if matter_id is not None:
        joined = joined.where(F.col("matter_id") == matter_id)
    if doc_type:
        joined = joined.where(F.col("doc_type") == doc_type)
    k = drafts.LEG_FACTOR * n
    left = text_leg(joined, "id", "content", query, k)
    right = vector_leg(joined, "id", "embedding", vector, k) if vector is not None else None
    best = fuse(left, right, "id", n)
    # At most 50 rows on one side: found by key, not by scanning for each.
    return best.join(joined.select("id", "document_id", "chunk_index", "heading_path", "content", "title"), "id")
