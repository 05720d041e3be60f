"""Spending under a daily cap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ordering import top_per_group
from lexloom.session import durable

_PAISE = 100


def walk(calls: Iterator[tuple[int, tuple]], left: int) -> tuple[dict[int, tuple], int]:
    """Admit (price, place) one after another while they fit; the last admitted place of each price, and what is left."""
    last: dict[int, tuple] = {}
    for price, place in calls:
        if price <= left:
            left -= price
            last[price] = place
    return last, left


def admit_calls(calls: DataFrame, budget: float, day: str = "day", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Add ``admitted``: whether each call fits what is left of its day's budget.

    ``calls`` has ``cost_paise`` (integer hundredths of a rupee, not negative). A call is refused when the
    spend of the calls admitted before it plus its own cost passes the cap;
    refused calls cost nothing, so a cheaper call may still be admitted later. ``order`` is unique within a day. A call
    without a price is refused, one of price 0 always admitted.

    Once a price is refused it stays refused that day. So of the calls of one day and price the first ones are admitted, at
    most as many as the cap holds; only those candidates are walked, in order, day by day. A day has
    at most cap * (1 + ln cap) of them, however many calls it has, and the number of jobs depends on neither
    calls nor prices. What comes back is the last admitted call of each day and price.
    """
    cap = round(budget * _PAISE)
    place = F.struct(*order)
    priced = calls.where((F.col("cost_paise") > 0) & (F.col("cost_paise") <= cap)).select(
        F.col(day).alias("__day"), F.col("cost_paise").cast("bigint").alias("__price"), place.alias("__place")
    )
    # Tasks send on at most ``cap`` rows of a day and price each.
    first = top_per_group(priced, ["__day", "__price"], [F.col("__place")], max(1, cap), "__nth")
    candidates = first.where(F.col("__nth") <= F.expr(f"{cap}L div __price")).drop("__nth")
    numbered = durable(candidates)
    kinds = ", ".join(f"{name} {kind}" for name, kind in numbered.dtypes)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(_flat(rows), sort_keys=[(c, "ascending") for c in order]))
        admitted, _ = walk(zip(rows["__price"].to_pylist(), range(len(rows))), cap)
        return rows.take(pa.array(sorted(admitted.values()), pa.int64()))

    limits = durable(numbered.groupBy("__day").applyInArrow(run, kinds)).withColumnRenamed("__place", "__last")
    joined = calls.join(
        limits, (F.col(day) == F.col("__day")) & (F.col("cost_paise").cast("bigint") == F.col("__price")), "left"
    )
    fits = (F.col("cost_paise") == 0) | (F.col("__last").isNotNull() & (place <= F.col("__last")))
    cost = F.when(F.col("cost_paise") < 0, F.raise_error(F.lit("a call has a negative price"))).otherwise(F.col("cost_paise"))
    # The price is looked at first, so that a negative one fails.
    return joined.withColumn("admitted", (F.coalesce(cost, F.lit(0)) >= 0) & F.coalesce(fits, F.lit(False))).select(
        *calls.columns, "admitted"
    )


def _flat(rows: pa.Table) -> pa.Table:
    places = rows["__place"].combine_chunks()
    return pa.table({field.name: places.field(i) for i, field in enumerate(places.type)})


def daily_spend(calls: DataFrame, budget: float, day: str = "day") -> DataFrame:
    """Calls, spend and what is left of the budget, per day."""
    total = F.sum("cost_paise")
    return calls.groupBy(day).agg(
        F.count("*").alias("calls"),
        (total / _PAISE).alias("spent_inr"),
        (F.greatest(F.lit(round(budget * _PAISE)) - total, F.lit(0)) / _PAISE).alias("remaining_inr"),
    )
