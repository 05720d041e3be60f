"""Case-management tables: Parquet folders or a database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import SourceUnavailable
from lexloom.sources import schemas
from lexloom.sources.files import any_file

TABLES = {
    "matters": schemas.MATTERS,
    "hearings": schemas.HEARINGS,
    "matter_events": schemas.MATTER_EVENTS,
    "documents": schemas.DOCUMENTS,
    "document_chunks": schemas.DOCUMENT_CHUNKS,
    "saved_research": schemas.SAVED_RESEARCH,
}


def create_tables(spark: SparkSession, root: str) -> None:
    """Create the tables that do not exist yet, empty."""
    for name, schema in TABLES.items():
        if not any_file(spark, f"{root}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table; a missing one is an error, not an empty result."""
    if name not in TABLES:
        raise SourceUnavailable(f"unknown table {name!r}")
    if not any_file(spark, f"{root}/{name}"):
        raise SourceUnavailable(f"table {name!r} does not exist under {root}")
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def append_table(rows: DataFrame, root: str, name: str) -> None:
    """Append rows."""
    rows.write.mode("append").parquet(f"{root}/{name}")


def read_database(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options
) -> DataFrame:
    """A database table over JDBC, split on a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high,
            numPartitions=parts, **options,
        )
        .load()
    )


def serialised(matters: DataFrame) -> DataFrame:
    """Matters as they are shown: ISO dates, parsed parties, value as a double."""
    shown = matters
    for day in ("cause_of_action_date", "filing_date", "limitation_expiry"):
        shown = shown.withColumn(day, F.date_format(day, "yyyy-MM-dd"))
    return shown.withColumn("parties", F.from_json("parties", schemas.PARTIES)).withColumn(
        "claim_value", F.col("claim_value").cast("double")
    )
