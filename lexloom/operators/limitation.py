"""Limitation positions and the timeline of a dishonoured cheque."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.dates import last_day_of_period
from lexloom.operators.calendar import with_next_open
from lexloom.rules import limitation as rules


def rule_table(spark: SparkSession) -> DataFrame:
    """The fixed limitation rules."""
    return spark.createDataFrame(
        rules.LIMITATION_RULES,
        "rule_key string, claim string, period_value int, period_unit string, "
        "starting_point string, authority string, source_act string, condonable boolean",
    )


def rules_by_act(table: DataFrame) -> DataFrame:
    """Rule keys of each source Act, sorted; the table is fixed and small."""
    return table.groupBy("source_act").agg(
        F.count("*").alias("rule_count"),
        F.array_join(F.sort_array(F.collect_list("rule_key")), ",").alias("rule_keys"),
    )


def period_label(value: Column, unit: Column) -> Column:
    """"3 years", "1 year"."""
    singular = F.regexp_replace(unit, "s+$", "")
    return F.concat_ws(" ", value.cast("string"), F.when(value == 1, singular).otherwise(unit))


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def positions(claims: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Base and final expiry of each claim.

    ``claims`` has ``rule_key`` and ``start_date`` and may have ``acknowledged``,
    ``copy_applied``, ``copy_ready``, ``wrong_forum_days`` and ``__calendar``. An unknown
    rule, a copy ready before it was applied for and negative days fail the query.

    The order is: exclude the first day; restart at an acknowledgment made in time;
    add the copy days, then the days before a wrong forum; then move to an open day.
    """
    ready = claims.select(
        "*",
        _optional(claims, "acknowledged", "date").alias("__ack"),
        _optional(claims, "copy_applied", "date").alias("__applied"),
        _optional(claims, "copy_ready", "date").alias("__ready"),
        _optional(claims, "wrong_forum_days", "int").alias("__forum"),
    )
    # A fixed table of 31 rows: broadcasting it is always safe.
    ruled = ready.join(F.broadcast(rule_table(claims.sparkSession)), "rule_key", "left")
    value = F.col("period_value")
    unit = F.when(
        F.col("authority").isNull(),
        F.raise_error(F.concat(F.lit("unknown limitation rule: "), F.col("rule_key"))).cast("string"),
    ).otherwise(F.col("period_unit"))
    first = F.date_add("start_date", 1)
    provisional = last_day_of_period(first, value, unit)
    in_time = F.coalesce(F.col("__ack") <= F.col("provisional_expiry"), F.lit(False))
    copy_days = F.when(
        F.col("__ready") < F.col("__applied"),
        F.raise_error(F.lit("copy ready before it was applied for")).cast("int"),
    ).otherwise(F.coalesce(F.datediff("__ready", "__applied"), F.lit(0)))
    forum_days = F.when(
        F.col("__forum") < 0, F.raise_error(F.lit("days before a wrong forum cannot be negative")).cast("int")
    ).otherwise(F.coalesce("__forum", F.lit(0)))
    dated = (
        ruled.withColumn("provisional_expiry", provisional)
        .withColumn("restarted", in_time)
        .withColumn("effective_start", F.when(F.col("restarted"), F.date_add("__ack", 1)).otherwise(first))
        .withColumn("base_expiry", last_day_of_period(F.col("effective_start"), value, unit))
        .withColumn("copy_days", copy_days)
        .withColumn("forum_days", forum_days)
        .withColumn(
            "unadjusted_expiry",
            F.date_add("base_expiry", (F.col("copy_days") + F.col("forum_days")).cast("int")),
        )
    )
    if calendar is None:
        final = dated.withColumn("expiry", F.col("unadjusted_expiry"))
    else:
        final = with_next_open(dated, "unadjusted_expiry", calendar, "__open").withColumn(
            "expiry", F.col("__open")
        ).drop("__open", "__open_reason")
    return _explained(final).drop("__ack", "__applied", "__ready", "__forum", "provisional_expiry")


def _explained(df: DataFrame) -> DataFrame:
    """Add the exclusions applied and one line of reasoning for each step."""
    moved = F.col("expiry") != F.col("unadjusted_expiry")

    def entry(provision, effect, days):
        return F.struct(
            F.lit(provision).alias("provision"), F.lit(effect).alias("effect"), days.alias("days")
        )

    none = F.lit(None).cast("int")
    exclusions = F.array_compact(
        F.array(
            F.when(F.col("restarted"), entry("section 18", "fresh period from acknowledgment", none)),
            F.when(
                F.col("__applied").isNotNull() & F.col("__ready").isNotNull(),
                entry("section 12(2)", "certified copy time excluded", F.col("copy_days")),
            ),
            F.when(
                F.col("forum_days") != 0,
                entry("section 14", "bona fide proceeding in wrong forum excluded", F.col("forum_days")),
            ),
            F.when(
                moved,
                entry("section 4", "expiry moved to next working day", F.datediff("expiry", "unadjusted_expiry")),
            ),
        )
    )
    iso = "yyyy-MM-dd"
    reasoning = F.array_compact(
        F.array(
            F.concat(
                F.lit("Section 12(1): "), F.date_format("start_date", iso),
                F.lit(" is left out of the count."),
            ),
            F.when(F.col("__ack").isNull(), None)
            .when(F.col("restarted"), F.concat(F.lit("Section 18: time restarts after "), F.date_format("__ack", iso), F.lit(".")))
            .otherwise(
                F.concat(
                    F.lit("Section 18 does NOT apply: the period had ended on "),
                    F.date_format("provisional_expiry", iso), F.lit("."),
                )
            ),
            F.when(F.col("copy_days") > 0, F.concat(F.lit("Section 12(2): "), F.col("copy_days"), F.lit(" days for the certified copy are left out."))),
            F.when(F.col("forum_days") > 0, F.concat(F.lit("Section 14: "), F.col("forum_days"), F.lit(" days before the wrong forum are left out."))),
            F.when(moved, F.concat(F.lit("Section 4: filing is good until "), F.date_format("expiry", iso), F.lit("."))),
            F.concat(
                F.col("authority"), F.lit(": "), period_label(F.col("period_value"), F.col("period_unit")),
                F.lit(" from "), F.col("starting_point"), F.lit("."),
            ),
        )
    )
    return df.withColumn("exclusions", exclusions).withColumn("reasoning", reasoning)


def standing(df: DataFrame, as_on: date) -> DataFrame:
    """Add days_remaining, expired and urgency as on a day."""
    left = F.datediff("expiry", F.lit(as_on))
    return (
        df.withColumn("days_remaining", left)
        .withColumn("expired", F.lit(as_on) > F.col("expiry"))
        .withColumn(
            "urgency",
            F.when(F.col("expired"), "EXPIRED")
            .when(F.col("days_remaining") <= rules.LIMITATION_CRITICAL_DAYS, "CRITICAL")
            .when(F.col("days_remaining") <= rules.LIMITATION_SOON_DAYS, "SOON")
            .otherwise("IN_TIME"),
        )
    )


def cheque_timeline(cheques: DataFrame, as_on: date) -> DataFrame:
    """The three clocks of each dishonoured cheque, and what comes next.

    ``cheques`` has ``dishonour_date``, ``notice_date`` and ``served_date`` (both may be
    NULL). Without a notice only the first clock is known.
    """
    service = F.coalesce("served_date", "notice_date")
    timed = (
        cheques.withColumn("notice_deadline", F.date_add("dishonour_date", rules.NOTICE_DAYS))
        .withColumn("service_date", service)
        .withColumn("payment_deadline", F.date_add("service_date", rules.PAYMENT_DAYS))
        .withColumn("cause_of_action_date", F.date_add("payment_deadline", 1))
        .withColumn(
            "complaint_deadline",
            last_day_of_period(
                F.col("cause_of_action_date"), F.lit(rules.COMPLAINT_MONTHS), F.lit("months")
            ),
        )
        .withColumn("complete", F.col("service_date").isNotNull())
    )
    missed = F.coalesce(F.col("notice_date") > F.col("notice_deadline"), F.lit(False))
    first = F.when(missed, "MISSED").when(F.col("notice_date").isNotNull(), "done").otherwise("pending")

    def step(number, action, deadline, status, condonable):
        return F.struct(
            F.lit(number).alias("step"), F.lit(action).alias("action"), deadline.alias("deadline"),
            status.alias("status"), F.lit(condonable).alias("condonable"),
        )

    steps = F.array_compact(
        F.array(
            step(1, "issue the demand notice", F.col("notice_deadline"), first, False),
            F.when(F.col("complete"), step(2, "wait for the time to pay", F.col("payment_deadline"), F.lit("pending"), False)),
            F.when(F.col("complete"), step(3, "file the complaint", F.col("complaint_deadline"), F.lit("pending"), True)),
        )
    )
    next_step = F.try_element_at(F.filter("steps", lambda s: s["status"] == "pending"), F.lit(1))
    left = F.datediff(F.col("next.deadline"), F.lit(as_on))
    return (
        timed.withColumn("steps", steps)
        .withColumn("next", next_step)
        .withColumn("next_step", F.col("next.step"))
        .withColumn("days_remaining", left)
        .withColumn(
            "urgency",
            F.when(F.exists("steps", lambda s: s["status"] == "MISSED"), "MISSED")
            .when(F.col("next").isNull(), "NONE")
            .when(F.col("days_remaining") < 0, "MISSED")
            .when(F.col("days_remaining") <= rules.CHEQUE_CRITICAL_DAYS, "CRITICAL")
            .when(F.col("days_remaining") <= rules.CHEQUE_SOON_DAYS, "SOON")
            .otherwise("IN_TIME"),
        )
        .drop("next")
    )
