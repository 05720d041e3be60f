"""BM25: on the fly for one query, or from a stored postings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import count_token, tokens, with_tokens

# The usual BM25 constants.
K1, B = 1.2, 0.75

#: Defaults of an index: term buckets, and shares by document of each bucket, so that the postings
#: of a very common term are written by many tasks. Both should grow with the collection;
#: the bucket count is stored with the index.
TERM_BUCKETS = 64
BUCKET_SHARES = 8


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, in order of appearance."""
    import regex

    found = regex.split(r"[^\p{L}\p{N}]+", query.lower())
    return list(dict.fromkeys(t for t in found if t))


def _text(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in columns])


def _weight(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def rank_query(
    df: DataFrame,
    query: str,
    text_columns: list[str],
    score: str = "score",
    keep_unscored: bool = False,
) -> DataFrame:
    """Add the BM25 score of each row for one query.

    Two scans and no shuffle of rows: the first collapses the table to one row of
    statistics, the second scores each row by itself. Rows without a hit are left
    out, or get score zero with ``keep_unscored``.
    """
    terms = query_terms(query)
    parts = with_tokens(df, _text(text_columns), "__tokens")
    parts = parts.withColumn("__len", F.size("__tokens").cast("double"))
    counts = {}
    for i, term in enumerate(terms):
        counts[f"__tf{i}"] = count_token(F.col("__tokens"), term)
    parts = parts.withColumns(counts) if counts else parts
    stats = parts.agg(
        F.count("*").cast("double").alias("__n"),
        F.avg("__len").alias("__mean"),
        *[F.count_if(F.col(c) > 0).cast("double").alias(f"{c}_df") for c in counts],
    )
    one = stats.select(F.struct("*").alias("s")).scalar()  # a scalar subquery of one row
    total = F.lit(0.0)
    for c in counts:
        total = total + _weight(
            one["__n"], one[f"{c}_df"], F.col(c).cast("double"), F.col("__len"), one["__mean"]
        )
    hit = F.greatest(*[F.col(c) for c in counts], F.lit(0), F.lit(0)) > 0
    kept = parts if keep_unscored else parts.where(hit)
    return kept.select(*df.columns, total.alias(score))


@dataclass(frozen=True)
class PostingsIndex:
    """Tables of a stored inverted index.

    An index yet to be written can have its postings in two parts as well: ``packed`` has a row per document and bucket
    (key, length, bucket, terms with blanks between them, tfs), which moves in a third of the bytes, ``loose`` the others.
    """

    postings: DataFrame  # term, bucket, key, tf, length
    terms: DataFrame  # term, bucket, df
    stats: DataFrame  # one row: n, mean_length, buckets
    packed: DataFrame | None = None
    loose: DataFrame | None = None


def bucket_of(term: Column, buckets: int | Column) -> Column:
    """The bucket that holds a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def documents(df: DataFrame, key: str, text_columns: list[str]) -> DataFrame:
    """(key, t, length): the tokens of each row in sorted order, and their number."""
    texts = df.select(F.col(key).alias("key"), _text(text_columns).alias("text"))
    return texts.select("key", F.sort_array(tokens(F.col("text"))).alias("t")).withColumn("length", F.size("t"))


def runs(df: DataFrame, tokens: str) -> tuple[DataFrame, Column]:
    """``df`` with a column beside a sorted array of tokens, and over both the array of ``struct<term, tf>`` of the tokens.

    A document is one row, so its terms are counted within it: in sorted order a term's
    count is the distance from its first place to the next term's.
    """
    t, n = F.col(tokens), F.size(tokens)
    places = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    first = F.filter(places, lambda i: ~F.get(t, i).eqNullSafe(F.get(t, i - 1)))
    placed = df.withColumn("__first", first)
    f = F.col("__first")
    counted = F.transform(
        f,
        lambda at, i: F.struct(F.get(t, at).alias("term"), (F.coalesce(F.get(f, i + 1), n) - at).cast("int").alias("tf")),
    )
    return placed, counted


def with_packs(df: DataFrame, counted: Column, out: str, buckets: int) -> DataFrame:
    """(key, length, ``out``): array of ``struct<bucket, terms, tfs>``, one per bucket, of an array of ``struct<term, tf>``."""
    others = ["key", "length"]
    entry = lambda x: F.struct(bucket_of(x["term"], buckets).alias("bucket"), x["term"].alias("term"), x["tf"].alias("tf"))
    placed = df.select(*others, F.sort_array(F.transform(counted, entry)).alias("__e"))
    parts = placed.select(*others, *[F.col("__e").getField(c).alias(f"__{c}") for c in ("bucket", "term", "tf")])
    begun = F.transform(
        F.array_distinct("__bucket"),
        lambda b: F.struct(b.alias("bucket"), F.array_position(F.col("__bucket"), b).cast("int").alias("at")),
    )
    parts = parts.withColumn("__begun", begun)

    def pack(x, i):
        n = F.coalesce(F.get(F.col("__begun"), i + 1)["at"], F.size("__bucket") + 1) - x["at"]
        return F.struct(
            x["bucket"].alias("bucket"),
            F.array_join(F.slice("__term", x["at"], n), " ").alias("terms"),
            F.slice("__tf", x["at"], n).alias("tfs"),
        )

    return parts.select(*others, F.transform("__begun", pack).alias(out))


def unpacked(packed: DataFrame) -> DataFrame:
    """The postings of packed ones."""
    pairs = F.arrays_zip(F.split("terms", " ", -1).alias("term"), F.col("tfs").alias("tf"))
    return packed.select("key", "length", F.inline(pairs).alias("term", "tf"), "bucket")


def build_index(
    df: DataFrame, key: str, text_columns: list[str], buckets: int = TERM_BUCKETS
) -> PostingsIndex:
    """Postings, document frequencies and corpus statistics of ``df``."""
    lengths = documents(df, key, text_columns)
    placed, counted = runs(lengths, "t")
    # The array is worked out in the generator: of a column a filter on its size would be pushed below, and repeat it.
    postings = placed.select("key", "length", F.inline(counted)).select(
        "key", "length", "term", "tf", bucket_of(F.col("term"), buckets).alias("bucket")
    )
    terms = postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    return PostingsIndex(postings, terms, index_stats(lengths, buckets))


def index_stats(lengths: DataFrame, buckets: int) -> DataFrame:
    """One row: documents, their mean length, and the number of term buckets."""
    return lengths.agg(
        F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.lit(buckets).alias("buckets")
    )


def write_index(index: PostingsIndex, folder: str, shares: int = BUCKET_SHARES) -> None:
    """Store an index; term buckets become partitions that a query prunes by.

    ``shares`` grows with the collection: it bounds how much of the postings of one
    common term a single task writes.
    """
    share = F.pmod(F.xxhash64("key"), F.lit(shares))
    if index.packed is None:
        dealt = index.postings.repartition("bucket", share)
    else:
        dealt = unpacked(index.packed.repartition("bucket", share)).unionByName(index.loose.repartition("bucket", share))
    (
        dealt.sortWithinPartitions("bucket", "term")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    )
    spark = index.postings.sparkSession
    stored = spark.read.parquet(f"{folder}/postings")
    (
        stored.groupBy("bucket", "term").agg(F.count("*").alias("df"))
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    )
    index.stats.write.mode("overwrite").parquet(f"{folder}/stats")


def read_index(spark: SparkSession, folder: str) -> PostingsIndex:
    """Open a stored index."""
    return PostingsIndex(
        spark.read.parquet(f"{folder}/postings"),
        spark.read.parquet(f"{folder}/terms"),
        spark.read.parquet(f"{folder}/stats"),
    )


def rank_index(index: PostingsIndex, query: str, score: str = "score") -> DataFrame:
    """(key, score) of every document with a query term, from the stored tables."""
    spark = index.postings.sparkSession
    terms = query_terms(query)
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    # The buckets are computed once so that they are literals the scan prunes by.
    held = index.stats.first()
    buckets = [
        row.b for row in wanted.select(bucket_of(F.col("term"), held.buckets).alias("b")).distinct().collect()
    ]
    in_query = F.col("bucket").isin(buckets) & F.col("term").isin(terms)
    per_term = index.terms.where(in_query).select("term", "df")
    joined = (
        index.postings.where(in_query)
        .join(F.broadcast(per_term), "term")  # at most one row per query term
    )
    weight = _weight(
        F.lit(float(held.n)), F.col("df").cast("double"), F.col("tf").cast("double"),
        F.col("length").cast("double"), F.lit(float(held.mean_length or 0.0)),
    )
    return joined.groupBy("key").agg(F.sum(weight).alias(score))


def index_is_stale(source: DataFrame, stats: DataFrame) -> DataFrame:
    """One row ``stale``: some source file is newer than the stored index."""
    newest = source.select(F.col("_metadata.file_modification_time").alias("t")).agg(
        F.max("t").alias("source_time")
    )
    built = stats.select(F.col("_metadata.file_modification_time").alias("t")).agg(
        F.min("t").alias("built_time")
    )
    when_built = built.scalar()
    return newest.select(
        (when_built.isNull() | (F.col("source_time") > when_built)).alias("stale")
    )
