"""Published court calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.dates import iso_date
from lexloom.sources import schemas


def parse_calendar(text: Column) -> Column:
    """Nested map of a calendar document: court, year, entries."""
    return F.from_json(text, schemas.HOLIDAYS)


def published_holidays(documents: DataFrame, text: str) -> DataFrame:
    """(court, day, occasion) of calendar documents.

    Years that are not numbers and entries without a valid date are skipped; of
    two entries for one day the last is kept.
    """
    courts = documents.select(F.explode(parse_calendar(F.col(text))).alias("court", "years"))
    years = courts.select("court", F.explode("years").alias("year", "entries"))
    numbered = years.where(F.col("year").try_cast("int").isNotNull())
    entries = numbered.select("court", F.posexplode("entries").alias("i", "e"))
    dated = entries.select(
        "court", "i", iso_date(F.col("e.date")).alias("day"),
        F.coalesce("e.occasion", F.lit("court holiday")).alias("occasion"),
    ).where(F.col("day").isNotNull())
    return dated.groupBy("court", "day").agg(F.max_by("occasion", "i").alias("occasion"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Holidays of one calendar file."""
    return published_holidays(spark.read.text(path, wholetext=True), "value")
