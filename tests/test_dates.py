from datetime import date

import pytest
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.functions.dates import add_period, check_unit, dmy_to_iso, iso_date
from lexloom.operators import calendar, limitation


def one(df, column):
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "start, value, unit, want",
    [
        (date(2026, 1, 1), 30, "days", date(2026, 1, 31)),
        (date(2026, 1, 31), 1, "months", date(2026, 2, 28)),
        (date(2024, 2, 29), 1, "years", date(2025, 2, 28)),
    ],
)
def test_add_period(spark, start, value, unit, want):
    df = spark.range(1).select(add_period(F.lit(start), F.lit(value), F.lit(unit)).alias("d"))
    assert one(df, "d") == want


def test_unknown_unit():
    with pytest.raises(InvalidRequest):
        check_unit("fortnights")


def test_text_dates(spark):
    df = spark.createDataFrame([("25-09-2024",), ("5-9-2024",), ("unknown",), ("2024",)], "t string")
    assert [r[0] for r in df.select(dmy_to_iso(F.col("t"))).collect()] == [
        "2024-09-25", "2024-09-05", "unknown", "2024",
    ]
    assert [r[0] for r in df.select(iso_date(dmy_to_iso(F.col("t")))).collect()] == [
        date(2024, 9, 25), date(2024, 9, 5), None, None,
    ]


def claim(spark, rule, start, **more):
    fields = {"rule_key": rule, "start_date": start, **more}
    kinds = {"wrong_forum_days": "int", "rule_key": "string", "__calendar": "string"}
    schema = ", ".join(f"{k} {kinds.get(k, 'date')}" for k in fields)
    return spark.createDataFrame([tuple(fields.values())], schema)


@pytest.mark.parametrize(
    "rule, start, more, want",
    [
        ("breach_of_contract", date(2023, 4, 10), {}, date(2026, 4, 10)),
        ("money_lent", date(2021, 1, 15), {"acknowledged": date(2023, 6, 1)}, date(2026, 6, 1)),
        ("money_lent", date(2018, 1, 15), {"acknowledged": date(2025, 6, 1)}, date(2021, 1, 15)),
        ("breach_of_contract", date(2023, 4, 10), {"wrong_forum_days": 100}, date(2026, 7, 19)),
        (
            "appeal_hc_decree", date(2026, 5, 2),
            {"copy_applied": date(2026, 5, 5), "copy_ready": date(2026, 5, 20)}, date(2026, 8, 15),
        ),
    ],
)
def test_limitation(spark, rule, start, more, want):
    assert one(limitation.positions(claim(spark, rule, start, **more)), "expiry") == want


def test_late_acknowledgment_is_explained(spark):
    row = limitation.positions(
        claim(spark, "money_lent", date(2018, 1, 15), acknowledged=date(2025, 6, 1))
    ).first()
    assert any("does NOT apply" in line for line in row.reasoning)
    assert row.exclusions == []


@pytest.mark.parametrize(
    "rule, more",
    [
        ("no_such_rule", {}),
        ("appeal_hc_decree", {"copy_applied": date(2026, 5, 20), "copy_ready": date(2026, 5, 5)}),
        ("appeal_hc_decree", {"wrong_forum_days": -5}),
    ],
)
def test_bad_claims_fail(spark, rule, more):
    with pytest.raises(Exception, match="unknown limitation rule|before it was applied|cannot be negative"):
        limitation.positions(claim(spark, rule, date(2026, 5, 2), **more)).collect()


def test_closed_day_moves_expiry(spark):
    days = [(f"X", date(2026, 4, d), "vacation") for d in (10, 11, 12)]
    published = spark.createDataFrame(days, "court string, day date, occasion string")
    table = calendar.court_calendar(spark, date(2026, 1, 1), date(2026, 12, 31), published)
    row = limitation.positions(
        claim(spark, "breach_of_contract", date(2023, 4, 10), **{"__calendar": "X"}), table
    ).first()
    assert row.expiry == date(2026, 4, 13)
    assert row.exclusions[0].provision == "section 4"


def test_standing(spark):
    old = limitation.positions(claim(spark, "breach_of_contract", date(2015, 1, 1)))
    new = limitation.positions(claim(spark, "breach_of_contract", date(2025, 1, 1)))
    a = limitation.standing(old, date(2026, 1, 1)).first()
    b = limitation.standing(new, date(2026, 1, 1)).first()
    assert a.expired and a.days_remaining < 0 and a.urgency == "EXPIRED"
    assert not b.expired and b.days_remaining == 730 and b.urgency == "IN_TIME"


def cheque(spark, *dates):
    schema = "dishonour_date date, notice_date date, served_date date"
    df = spark.createDataFrame([dates], schema)
    return limitation.cheque_timeline(df, date(2026, 7, 16)).first()


def test_cheque_timeline(spark):
    only = cheque(spark, date(2026, 7, 15), None, None)
    assert only.notice_deadline == date(2026, 8, 14) and not only.complete and len(only.steps) == 1
    late = cheque(spark, date(2026, 7, 15), date(2026, 8, 19), None)
    assert late.steps[0].status == "MISSED" and late.urgency == "MISSED"
    full = cheque(spark, date(2026, 7, 15), date(2026, 7, 20), date(2026, 7, 24))
    assert full.payment_deadline == date(2026, 8, 8)
    assert full.cause_of_action_date == date(2026, 8, 9)
    assert full.complaint_deadline == date(2026, 9, 8)
    assert full.complete and full.next_step == 2


@pytest.fixture(scope="module")
def common(spark):
    return calendar.court_calendar(spark, date(2026, 1, 1), date(2027, 12, 31)).cache()


def test_reasons(spark, common):
    reasons = {r.day: r.reason for r in common.collect()}
    assert reasons[date(2026, 8, 2)] == "Sunday"
    assert reasons[date(2026, 1, 26)] == "Republic Day"
    assert reasons[date(2026, 8, 15)] == "Saturday"
    assert reasons[date(2026, 8, 4)] is None


def test_next_open_and_working_days(spark, common):
    df = spark.createDataFrame(
        [("", date(2026, 8, 1), 0), ("", date(2026, 8, 3), 5)], "__calendar string, d date, n int"
    )
    moved = calendar.with_next_open(df, "d", common, "next").orderBy("d").collect()
    assert [r.next for r in moved] == [date(2026, 8, 3), date(2026, 8, 3)]
    added = calendar.add_working_days(df, "d", "n", common, "due").orderBy("d").collect()
    assert [r.due for r in added] == [date(2026, 8, 1), date(2026, 8, 10)]
    spans = df.withColumn("e", F.lit(date(2026, 8, 10)))
    counted = calendar.working_days_between(spans, "d", "e", common, "days").orderBy("d").collect()
    assert [r.days for r in counted] == [6, 5]


def test_long_closure_gives_up_after_sixty_days(spark):
    days = spark.sql("SELECT 'X' AS court, explode(sequence(DATE'2026-01-01', DATE'2026-05-01')) AS day, 'shut' AS occasion")
    table = calendar.court_calendar(spark, date(2026, 1, 1), date(2026, 12, 31), days)
    row = table.where("court = 'X' AND day = DATE'2026-01-05'").first()
    assert row.next_open == date(2026, 3, 6)


def test_deadlines(spark, common):
    df = spark.createDataFrame([("", date(2026, 7, 2), 30)], "__calendar string, start date, n int")
    row = calendar.deadlines(df, "start", "n", "days", common).first()
    assert (row.deadline, row.moved_from, row.closure_reason, row.day_of_week) == (
        date(2026, 8, 3), date(2026, 8, 1), "Saturday", "Monday",
    )


def test_published_entry_wins(spark):
    years = spark.createDataFrame([("X", 2026)], "court string, year int")
    published = spark.createDataFrame(
        [("X", date(2026, 1, 26), "Own name"), ("X", date(2026, 3, 4), "Holi"), ("X", date(2025, 3, 4), "other year")],
        "court string, day date, occasion string",
    )
    got = {r.day: r.occasion for r in calendar.known_closures(years, published).collect()}
    assert got[date(2026, 1, 26)] == "Own name" and got[date(2026, 3, 4)] == "Holi"
    assert len(got) == 6


def test_days_outside_the_calendar_fail(spark, common):
    df = spark.createDataFrame([(date(2031, 1, 6), date(2031, 2, 6), 5)], "d date, e date, n int")
    named = df.withColumn("__calendar", F.lit(""))
    for use in (
        lambda: calendar.with_next_open(named, "d", common, "x"),
        lambda: calendar.add_working_days(named, "d", "n", common, "x"),
        lambda: calendar.working_days_between(named, "d", "e", common, "x"),
    ):
        with pytest.raises(Exception, match="calendar"):
            use().collect()


def test_search_that_passes_the_end_of_the_calendar_fails(spark, common):
    named = spark.createDataFrame([(date(2027, 12, 30), 5)], "d date, n int").withColumn("__calendar", F.lit(""))
    with pytest.raises(Exception, match="calendar ends"):
        calendar.add_working_days(named, "d", "n", common, "x").collect()


def test_calendar_over_any_dates(spark):
    rows = [(date(1904, 2, 1), 5), (date(2089, 12, 1), 5), (None, 5), (date(2031, 1, 6), 5)]
    df = spark.createDataFrame(rows, "d date, n int").withColumn("__calendar", F.lit(""))
    table = calendar.calendar_over(df, [F.col("d"), calendar.working_days_limit(F.col("d"), F.col("n"))])
    got = {r.d: r.x for r in calendar.add_working_days(df, "d", "n", table, "x").collect()}
    assert got[date(2031, 1, 6)] == date(2031, 1, 13) and got[None] is None
    assert got[date(2089, 12, 1)] == date(2089, 12, 8) and got[date(1904, 2, 1)] == date(1904, 2, 8)
    assert calendar.calendar_over(df.limit(0), [F.col("d")]).count() == 1
