"""Court calendars as a table: closures, next open days and working-day counts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.functions.dates import add_period, check_unit
from lexloom.rules.calendar import CLOSURE_SEARCH_DAYS, FIXED_NATIONAL_HOLIDAYS

#: Name of the calendar that courts without a published one share.
COMMON = ""


def fixed_holiday(day: Column) -> Column:
    """Occasion of a fixed national holiday, else NULL."""
    result = F.lit(None).cast("string")
    for month, number, occasion in FIXED_NATIONAL_HOLIDAYS:
        result = F.when((F.month(day) == month) & (F.dayofmonth(day) == number), occasion).otherwise(result)
    return result


def weekend(day: Column) -> Column:
    """"Sunday" or "Saturday", else NULL."""
    return F.when(F.weekday(day) == 6, "Sunday").when(F.weekday(day) == 5, "Saturday")


def court_calendar(
    spark: SparkSession, first: date, last: date, published: DataFrame | None = None
) -> DataFrame:
    """One row per court and day: reason, open, open_index, next_open, last_day.

    ``published`` has ``court``, ``day``, ``occasion``. Weekends come before fixed
    holidays and these before published ones. ``open_index`` counts open days up to
    and including the day; ``next_open`` is the first open day on or after it, or the
    day 60 days on if none is open before. ``last_day`` is the end of the calendar. A day
    outside ``first`` to ``last`` makes the operators below fail, so take the range from the
    data (:func:`calendar_over`).

    The windows hold the days of one court, so their size is set by the range.
    """
    courts = spark.createDataFrame([(COMMON,)], "court string")
    if published is not None:
        courts = courts.unionByName(published.select("court").distinct())
    until = F.date_add(F.lit(last), CLOSURE_SEARCH_DAYS + 1)
    grid = courts.select("court", F.explode(F.sequence(F.lit(first), until)).alias("day"))
    if published is not None:
        notices = published.groupBy("court", "day").agg(F.max("occasion").alias("occasion"))
        grid = grid.join(notices, ["court", "day"], "left")
    else:
        grid = grid.withColumn("occasion", F.lit(None).cast("string"))
    day = F.col("day")
    reasoned = grid.select(
        "court", "day",
        F.coalesce(weekend(day), fixed_holiday(day), F.col("occasion")).alias("reason"),
    ).withColumn("open", F.col("reason").isNull())
    by_day = Window.partitionBy("court").orderBy("day")
    counted = reasoned.withColumn(
        "open_index",
        F.sum(F.col("open").cast("bigint")).over(by_day.rowsBetween(Window.unboundedPreceding, 0)),
    ).withColumn(
        "next_open",
        F.coalesce(
            F.min(F.when(F.col("open"), F.col("day"))).over(
                by_day.rowsBetween(0, CLOSURE_SEARCH_DAYS - 1)
            ),
            F.date_add("day", CLOSURE_SEARCH_DAYS),
        ),
    )
    return counted.where(F.col("day") <= F.lit(last)).withColumn("last_day", F.lit(last))


def calendar_over(
    df: DataFrame, days: Sequence[Column], published: DataFrame | None = None
) -> DataFrame:
    """The calendar from the earliest to the latest of ``days`` in ``df``.

    Name every day that will be looked up: starts, ends of periods, and for working days
    :func:`working_days_limit`. Takes one aggregate over ``df``. Without any day it holds one.
    """
    low, high = F.min(F.least(*days, days[0])), F.max(F.greatest(*days, days[0]))
    row = df.agg(low.alias("low"), high.alias("high")).first()
    first, last = row.low or date(2000, 1, 1), row.high or date(2000, 1, 1)
    return court_calendar(df.sparkSession, first, last, published)


def working_days_limit(start: Column, count: Column) -> Column:
    """The day on which the search for the ``count``-th working day ends."""
    return F.date_add(start, (F.greatest(count, F.lit(0)) * 5 + CLOSURE_SEARCH_DAYS).cast("int"))


def _within(day: Column, found: Column, value: Column) -> Column:
    """``value``; NULL for a NULL day; an error for a day the calendar does not have."""
    outside = F.concat(F.lit("no calendar day for "), day.cast("string"))
    return F.when(day.isNotNull() & found.isNull(), F.raise_error(outside).cast("date")).otherwise(value)


def calendar_name(df: DataFrame, court: str, published: DataFrame | None) -> DataFrame:
    """Replace a court without a published calendar by the common one."""
    if published is None:
        return df.withColumn("__calendar", F.lit(COMMON))
    named = published.select(F.col("court").alias("__has")).distinct()
    return (
        df.join(named, F.col(court) == F.col("__has"), "left")
        .withColumn("__calendar", F.coalesce("__has", F.lit(COMMON)))
        .drop("__has")
    )


def with_next_open(df: DataFrame, day: str, calendar: DataFrame, out: str, court: str = "__calendar") -> DataFrame:
    """Add ``out`` (next open day) and ``{out}_reason`` (why ``day`` is closed).

    A day that ``calendar`` does not have is an error; a NULL day gives NULL.
    """
    side = calendar.select(
        F.col("court").alias("__c"), F.col("day").alias("__d"),
        F.col("next_open").alias(out), F.col("reason").alias(f"{out}_reason"),
    )
    on = (F.col(court) == F.col("__c")) & (F.col(day) == F.col("__d"))
    joined = df.join(side, on, "left")
    return joined.withColumn(out, _within(F.col(day), F.col("__d"), F.col(out))).drop("__c", "__d")


def with_open_index(df: DataFrame, day: str, calendar: DataFrame, out: str, court: str = "__calendar") -> DataFrame:
    """Add ``out`` (open days up to and including ``day``) and ``{out}_end`` (the calendar's end).

    A day that ``calendar`` does not have is an error; a NULL day gives NULL.
    """
    side = calendar.select(
        F.col("court").alias("__c"), F.col("day").alias("__d"),
        F.col("open_index").alias(out), F.col("last_day").alias(f"{out}_end"),
    )
    on = (F.col(court) == F.col("__c")) & (F.col(day) == F.col("__d"))
    ended = _within(F.col(day), F.col("__d"), F.col(f"{out}_end"))
    # Both columns hang on the check, so that neither is read without it.
    return (
        df.join(side, on, "left")
        .withColumn(f"{out}_end", ended)
        .withColumn(out, F.when(F.col(f"{out}_end").isNotNull(), F.col(out)))
        .drop("__c", "__d")
    )


def add_working_days(
    df: DataFrame, start: str, count: str, calendar: DataFrame, out: str, court: str = "__calendar"
) -> DataFrame:
    """Add ``out``: the ``count``-th open day after ``start``; 0 gives ``start``.

    The search ends after five days per working day plus 60. A calendar that ends before
    both the day sought and that limit is an error.
    """
    indexed = with_open_index(df, start, calendar, "__from", court).withColumn(
        "__target", F.col("__from") + F.col(count)
    )
    opens = calendar.where("open").select(
        F.col("court").alias("__c"), F.col("open_index").alias("__i"), F.col("day").alias("__found")
    )
    on = (F.col(court) == F.col("__c")) & (F.col("__target") == F.col("__i"))
    limit = working_days_limit(F.col(start), F.col(count))
    short = F.raise_error(F.concat(F.lit("the calendar ends before working days after "), F.col(start).cast("string")))
    return (
        indexed.join(opens, on, "left")
        .withColumn(
            out,
            F.when(F.col(start).isNull() | F.col(count).isNull(), F.lit(None).cast("date"))
            .when(F.col(count) <= 0, F.col(start))
            .when(F.col("__found").isNotNull(), F.least(F.col("__found"), limit))
            .when(limit <= F.col("__from_end"), limit)
            .otherwise(short.cast("date")),
        )
        .drop("__from", "__from_end", "__target", "__c", "__i", "__found")
    )


def working_days_between(
    df: DataFrame, start: str, end: str, calendar: DataFrame, out: str, court: str = "__calendar"
) -> DataFrame:
    """Add ``out``: open days in (start, end]; 0 when end is not later."""
    both = with_open_index(
        with_open_index(df, start, calendar, "__a", court), end, calendar, "__b", court
    )
    return both.withColumn(
        out,
        F.when(F.col(end) <= F.col(start), F.lit(0).cast("bigint")).otherwise(
            F.col("__b") - F.col("__a")
        ),
    ).drop("__a", "__a_end", "__b", "__b_end")


def deadlines(
    df: DataFrame, start: str, value: str, unit: str, calendar: DataFrame, working_days_only: bool = False
) -> DataFrame:
    """Add deadline, moved_from, closure_reason and day_of_week.

    A calendar period that ends on a closed day moves to the next open one.
    """
    check_unit(unit)
    if working_days_only:
        if unit != "days":
            raise InvalidRequest("working days can only be counted in days")
        done = add_working_days(df, start, value, calendar, "deadline")
        done = done.withColumn("moved_from", F.lit(None).cast("date")).withColumn(
            "closure_reason", F.lit(None).cast("string")
        )
    else:
        ends = df.withColumn("__end", add_period(F.col(start), F.col(value), F.lit(unit)))
        rolled = with_next_open(ends, "__end", calendar, "deadline")
        moved = F.col("deadline") != F.col("__end")
        done = (
            rolled.withColumn("moved_from", F.when(moved, F.col("__end")))
            .withColumn("closure_reason", F.when(moved, F.col("deadline_reason")))
            .drop("__end", "deadline_reason")
        )
    return done.withColumn("day_of_week", F.date_format("deadline", "EEEE"))


def known_closures(years: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Closures other than weekends for each (court, year) of ``years``.

    A published entry replaces a fixed holiday on the same day.
    """
    fixed = F.array(
        *[
            F.struct(F.make_date(F.col("year"), F.lit(m), F.lit(d)).alias("day"), F.lit(o).alias("occasion"))
            for m, d, o in FIXED_NATIONAL_HOLIDAYS
        ]
    )
    base = years.select("court", "year", F.inline(fixed))
    if published is None:
        return base
    noticed = (
        published.withColumn("year", F.year("day"))
        .join(years.select("court", "year"), ["court", "year"], "left_semi")
        .groupBy("court", "year", "day").agg(F.max("occasion").alias("published"))
    )
    return base.join(noticed, ["court", "year", "day"], "full_outer").select(
        "court", "year", "day", F.coalesce("published", "occasion").alias("occasion")
    )


def calendar_confidence(df: DataFrame, court: str, day: str, published: DataFrame) -> DataFrame:
    """Add calendar_installed and year_covered for each row's court and year."""
    years = published.select(
        F.col("court").alias("__c"), F.year("day").alias("__y")
    ).distinct()
    courts = years.select(F.col("__c").alias("__has")).distinct()
    joined = df.join(courts, F.col(court) == F.col("__has"), "left").join(
        years, (F.col(court) == F.col("__c")) & (F.year(F.col(day)) == F.col("__y")), "left"
    )
    return (
        joined.withColumn("calendar_installed", F.col("__has").isNotNull())
        .withColumn("year_covered", F.col("__y").isNotNull())
        .withColumn(
            "basis",
            F.when(F.col("year_covered"), "weekends, fixed holidays and the court calendar").otherwise(
                "weekends and fixed holidays only"
            ),
        )
        .drop("__has", "__c", "__y")
    )
