"""Case management: diaries, timelines, alerts and record keeping.

Children of a matter are returned as rows, not gathered into one array per
matter: a matter may own a large share of all rows, and a sort on (matter, date,
id) still spreads it over many tasks.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.operators.ordering import dense_number
from lexloom.rules.limitation import (
    ALERT_HORIZON_DAYS,
    IMMINENT_HEARING_DAYS,
    LIMITATION_CRITICAL_DAYS,
)
from lexloom.rules.matters import FINISHED_STATUSES, MATTER_STATUSES, MATTER_TYPES


def clamp(value: int, low: int, high: int) -> int:
    """``value`` kept within [low, high]."""
    return max(low, min(value, high))


def check_choice(value: str | None, allowed: list[str], name: str) -> None:
    """Reject a value outside its list; NULL passes."""
    if value is not None and value not in allowed:
        raise InvalidRequest(f"{name} must be one of {allowed}")


def unfinished(status: Column) -> Column:
    """Neither disposed nor closed."""
    return ~status.isin(FINISHED_STATUSES)


# --- lists -------------------------------------------------------------------


def list_matters(
    matters: DataFrame, status: str | None = None, matter_type: str | None = None, limit: int = 50
) -> DataFrame:
    """Matters by limitation date (missing last), then latest update."""
    check_choice(status, MATTER_STATUSES, "status")
    check_choice(matter_type, MATTER_TYPES, "matter_type")
    if status:
        matters = matters.where(F.col("status") == status)
    if matter_type:
        matters = matters.where(F.col("matter_type") == matter_type)
    return matters.orderBy(
        F.col("limitation_expiry").asc_nulls_last(), F.col("updated_at").desc_nulls_last(), "id"
    ).limit(clamp(limit, 1, 500))


def limitation_alerts(matters: DataFrame, as_on: date) -> DataFrame:
    """Unfinished matters whose limitation date is past or within 60 days."""
    horizon = as_on + timedelta(days=ALERT_HORIZON_DAYS)
    return matters.where(
        unfinished(F.col("status")) & (F.col("limitation_expiry") <= F.lit(horizon))
    ).select(
        F.col("id").alias("matter_id"), "title", "limitation_expiry",
        F.datediff("limitation_expiry", F.lit(as_on)).alias("days_remaining"),
        (F.col("limitation_expiry") < F.lit(as_on)).alias("expired"),
    )


def limitation_status(expiry: Column, as_on: date) -> Column:
    """EXPIRED, CRITICAL or OK; NULL without a limitation date."""
    left = F.datediff(expiry, F.lit(as_on))
    return (
        F.when(left < 0, "EXPIRED").when(left <= LIMITATION_CRITICAL_DAYS, "CRITICAL")
        .when(left.isNotNull(), "OK")
    )


def counts_by_status(matters: DataFrame) -> DataFrame:
    """Matters per status."""
    return matters.groupBy("status").agg(F.count("*").alias("matter_count"))


def upcoming_hearings(hearings: DataFrame, matters: DataFrame, as_on: date, days: int = 30) -> DataFrame:
    """Hearings of unfinished matters listed in the window, earliest first."""
    until = as_on + timedelta(days=clamp(days, 1, 365))
    listed = hearings.withColumn("listed_date", F.coalesce("next_date", "hearing_date")).where(
        F.col("listed_date").between(F.lit(as_on), F.lit(until))
    )
    live = matters.where(unfinished(F.col("status"))).select(
        F.col("id").alias("matter_id"), "title", "case_number", "court"
    )
    away = F.datediff("listed_date", F.lit(as_on))
    return (
        listed.join(live, "matter_id")
        .select(
            "id", "matter_id", "title", "case_number", "court", "listed_date", "purpose", "bench",
            away.alias("days_away"), (away <= IMMINENT_HEARING_DAYS).alias("imminent"),
        )
        .orderBy("listed_date", "id")
    )


# --- one matter or all of them ---------------------------------------------------


def matter_children(
    matters: DataFrame, hearings: DataFrame, events: DataFrame, documents: DataFrame
) -> DataFrame:
    """Hearings, events and documents of each matter, one row each, newest first."""
    ids = matters.select(F.col("id").alias("matter_id"))

    def child(df, kind, day, label):
        return df.select(
            "matter_id", F.lit(kind).alias("child"), F.col("id").alias("child_id"),
            F.col(day).cast("date").alias("on_date"), label.alias("label"),
        )

    rows = (
        child(hearings, "hearing", "hearing_date", F.coalesce("purpose", F.lit("")))
        .unionByName(child(events, "event", "event_date", F.coalesce("description", F.lit(""))))
        .unionByName(child(documents, "document", "created_at", F.col("title")))
    )
    return rows.join(ids, "matter_id").orderBy(
        "matter_id", "child", F.desc("on_date"), F.desc("child_id")
    )


def matter_totals(
    matters: DataFrame, hearings: DataFrame, events: DataFrame, documents: DataFrame
) -> DataFrame:
    """Matters with the number of their hearings, events and documents, zero included."""
    def counted(df, name):
        return df.groupBy("matter_id").agg(F.count("*").alias(name))

    out = matters.withColumn("matter_id", F.col("id"))
    for df, name in ((hearings, "hearing_count"), (events, "event_count"), (documents, "document_count")):
        out = out.join(counted(df, name), "matter_id", "left").withColumn(
            name, F.coalesce(name, F.lit(0).cast("bigint"))
        )
    return out.drop("matter_id")


def timeline(matters: DataFrame, hearings: DataFrame, events: DataFrame) -> DataFrame:
    """Cause of action, filing, events and hearings of each matter in date order.

    Equal dates keep that order, then the id.
    """
    def entry(df, day, kind, description, ordinal, matter="matter_id", bench=None):
        return df.where(F.col(day).isNotNull()).select(
            F.col(matter).alias("matter_id"), F.col(day).cast("date").alias("on_date"),
            kind.alias("kind"), description.alias("description"),
            (bench if bench is not None else F.lit(None).cast("string")).alias("bench"),
            F.lit(ordinal).alias("ordinal"), F.col("id").alias("source_id"),
        )

    known = matters.select(F.col("id").alias("matter_id"))
    spoken = F.concat_ws(
        " - ", F.nullif("purpose", F.lit("")), F.nullif("outcome", F.lit(""))
    )
    children = entry(
        events, "event_date", F.col("event_type"), F.col("description"), 2
    ).unionByName(
        entry(
            hearings, "hearing_date", F.lit("hearing"),
            F.coalesce(F.nullif(spoken, F.lit("")), F.lit("Hearing")), 3, bench=F.col("bench"),
        )
    )
    rows = (
        entry(matters, "cause_of_action_date", F.lit("cause_of_action"), F.lit("Cause of action arose"), 0, "id")
        .unionByName(entry(matters, "filing_date", F.lit("filed"), F.lit("Matter filed"), 1, "id"))
        .unionByName(children.join(known, "matter_id", "left_semi"))
    )
    return rows.orderBy("matter_id", "on_date", "ordinal", "source_id")


# --- record keeping ----------------------------------------------------------------


def append_rows(
    existing: DataFrame, new: DataFrame, order: list[str], parents: DataFrame | None = None,
    parent_key: str = "matter_id",
) -> DataFrame:
    """New rows with ids that continue from the largest existing one.

    Rows whose parent does not exist are left out.
    """
    if parents is not None:
        new = new.join(parents.select(F.col("id").alias(parent_key)), parent_key, "left_semi")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("last")).scalar()
    return dense_number(new, order, "id").withColumn("id", F.col("id") + last)


def apply_patch(base: DataFrame, patch: DataFrame, key: str, stamp: Column) -> DataFrame:
    """Rows of ``base`` with every non-NULL field of ``patch`` written over.

    Omitted (NULL) fields are left alone; patched rows get ``updated_at = stamp``.
    ``patch`` has at most one row per key.
    """
    fields = [c for c in patch.columns if c != key]
    unknown = set(fields) - set(base.columns)
    if unknown:
        raise InvalidRequest(f"unknown fields: {sorted(unknown)}")
    if not fields:
        raise InvalidRequest("at least one field to update must be given")
    renamed = patch.select(
        F.col(key), *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__patched")
    )
    joined = base.join(renamed, key, "left")
    columns = []
    for c in base.columns:
        if c in fields:
            columns.append(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c))
        elif c == "updated_at":
            columns.append(F.when(F.col("__patched"), stamp).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def invalid_matters(matters: DataFrame) -> DataFrame:
    """Rows that break a rule, with the list of broken rules."""
    problems = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title is blank"),
            F.when(~F.col("matter_type").isin(MATTER_TYPES), "unknown matter type"),
            F.when(~F.col("status").isin(MATTER_STATUSES), "unknown status"),
            F.when(F.col("id") <= 0, "id is not positive"),
        )
    )
    return matters.withColumn("problems", problems).where(F.size("problems") > 0)


def orphans(children: DataFrame, parents: DataFrame, child_key: str) -> DataFrame:
    """Child rows whose parent does not exist; a NULL key is no orphan."""
    return children.where(F.col(child_key).isNotNull()).join(
        parents.select(F.col("id").alias(child_key)), child_key, "left_anti"
    )


def unexpired(tokens: DataFrame, now: Column) -> DataFrame:
    """Rows whose ``expires_at`` is not before ``now``."""
    return tokens.where(F.col("expires_at") >= now)
