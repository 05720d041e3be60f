"""Court names, forums and the directory of courts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest, SourceUnavailable
from lexloom.functions.text import lookup, strip, word_list
from lexloom.operators.corpus import ALL_COURTS
from lexloom.rules.courts import (
    COURT_ALIASES,
    COURT_DIRECTORY,
    FORUM_DEFAULT,
    FORUM_RULES,
    HIGH_COURTS,
    SUPREME_COURT,
)

_SHORTEST_CONTAINED = 4


def court_code(name: Column) -> Column:
    """Code of a court name: alias, code, then first alias contained; else NULL."""
    key = F.lower(strip(name))
    codes = word_list([*HIGH_COURTS, SUPREME_COURT])
    contained = F.lit(None).cast("string")
    for alias, code in reversed(COURT_ALIASES.items()):
        if len(alias) >= _SHORTEST_CONTAINED:
            contained = F.when(key.contains(alias), code).otherwise(contained)
    return F.coalesce(
        lookup(COURT_ALIASES, key), F.when(F.array_contains(codes, name), name), contained
    )


def resolve_scope(name: str | None) -> str:
    """Search scope for one court name; raises on an unknown court."""
    if not name:
        return ALL_COURTS
    key = name.strip().lower()
    if key in COURT_ALIASES:
        return COURT_ALIASES[key]
    if name in HIGH_COURTS or name == SUPREME_COURT:
        return name
    for alias, code in COURT_ALIASES.items():
        if len(alias) >= _SHORTEST_CONTAINED and alias in key:
            return code
    raise SourceUnavailable(f"unknown court {name!r}")


def forum(subject: Column) -> Column:
    """``struct<forum, basis>`` for a dispute: the first rule with a keyword."""
    lowered = F.lower(subject)

    def answer(name, basis):
        return F.struct(F.lit(name).alias("forum"), F.lit(basis).alias("basis"))

    result = answer(*FORUM_DEFAULT)
    for keywords, name, basis in reversed(FORUM_RULES):
        hit = F.lit(False)
        for word in keywords:
            hit = hit | lowered.contains(word)
        result = F.when(hit, answer(name, basis)).otherwise(result)
    return result


def territorial_options(cause_place: Column, defendant_place: Column) -> Column:
    """Places where the dispute may be brought, with the ground for each."""
    def option(place, basis):
        return F.when(
            F.coalesce(place, F.lit("")) != "",
            F.struct(place.alias("place"), F.lit(basis).alias("basis")),
        )

    return F.array_compact(
        F.array(
            option(cause_place, "where the cause of action arose"),
            option(defendant_place, "where the defendant resides or carries on business"),
        )
    )


def court_directory(spark: SparkSession, court_type: str | None = None) -> DataFrame:
    """The fixed directory, optionally of one type."""
    types = sorted({row[0] for row in COURT_DIRECTORY})
    if court_type is not None and court_type not in types:
        raise InvalidRequest(f"court_type must be one of {types}")
    table = spark.createDataFrame(COURT_DIRECTORY, "court_type string, name string, seat string")
    return table if court_type is None else table.where(F.col("court_type") == court_type)
