"""Object listings and what still has to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.operators.corpus import court_label
from lexloom.rules.courts import SUPREME_COURT

_LISTING = "Contents array<struct<Key string, Size bigint>>, NextContinuationToken string"


def _parsed(text: str):
    return F.from_xml(F.col(text), _LISTING, {"ignoreNamespace": "true"})


def parse_listing(pages: DataFrame, text: str) -> DataFrame:
    """(key, size) of object-listing XML pages."""
    return pages.select(F.inline(_parsed(text)["Contents"]).alias("key", "size"))


def next_tokens(pages: DataFrame, text: str) -> DataFrame:
    """Continuation tokens of pages that are not the last."""
    tokens = pages.select(_parsed(text)["NextContinuationToken"].alias("token"))
    return tokens.where("token <> ''")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(key, size) of files under a root; content is not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
        .select(F.col("path").alias("key"), F.col("length").alias("size"))
    )


def wanted_keys(listing: DataFrame, courts: list[str], from_year: int, to_year: int) -> DataFrame:
    """Metadata files of the courts and years, with the path each one is kept at.

    Only the canonical ``metadata.parquet`` of a High Court bench counts; a
    Supreme Court year may have any Parquet name.
    """
    if from_year > to_year:
        raise InvalidRequest(f"from_year ({from_year}) must not exceed to_year ({to_year})")
    year = F.regexp_extract("key", r"year=(\d{4})/", 1)
    court = F.regexp_extract("key", r"court=([^/]+)/", 1)
    bench = F.regexp_extract("key", r"bench=([^/]+)/", 1)
    parts = listing.select(
        "key", "size", year.try_cast("int").alias("year"),
        F.when(court == "", SUPREME_COURT).otherwise(court).alias("court"), bench.alias("bench"),
    ).where(F.col("year").between(from_year, to_year) & F.col("court").isin(courts))
    supreme = (F.col("court") == SUPREME_COURT) & F.col("key").endswith(".parquet")
    high = (
        (F.col("court") != SUPREME_COURT)
        & F.col("key").endswith("metadata.parquet") & (F.col("bench") != "")
    )
    target = F.when(
        F.col("court") == SUPREME_COURT,
        F.concat(F.lit("sc/metadata/year="), F.col("year"), F.lit("/metadata.parquet")),
    ).otherwise(
        F.concat(
            F.lit("hc/metadata/year="), F.col("year"), F.lit("/court="), F.col("court"),
            F.lit("/bench="), F.col("bench"), F.lit("/metadata.parquet"),
        )
    )
    return parts.where(supreme | high).withColumn("target", target)


def fetch_plan(wanted: DataFrame, held: DataFrame, force: bool = False) -> DataFrame:
    """Add ``fetch``: false for files already held and not empty."""
    kept = held.where("size > 0").select("target", F.lit(True).alias("__held")).distinct()
    planned = wanted.join(kept, "target", "left")
    return planned.withColumn("fetch", F.lit(force) | F.col("__held").isNull()).drop("__held")


def sync_totals(plan: DataFrame) -> DataFrame:
    """Files, bytes and skipped files per court and in total."""
    return plan.rollup("court").agg(
        F.count_if("fetch").alias("files"),
        F.coalesce(F.sum(F.when(F.col("fetch"), F.col("size"))), F.lit(0).cast("bigint")).alias("bytes"),
        F.count_if(~F.col("fetch")).alias("skipped"),
    ).select(
        F.when(F.col("court").isNull(), "all courts").otherwise(court_label(F.col("court"))).alias("court"),
        "files", "bytes",
        F.bround(F.col("bytes") / (1024 * 1024), 1).alias("megabytes"), "skipped",
    )
