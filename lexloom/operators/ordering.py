"""Running totals, dense numbering and ranked pages that do not pile onto one task.

A window over an unpartitioned or very large group sorts all of it in one task.
Here rows are range-partitioned on (group, order) instead, so one group may span
many tasks; each task's share is summed first and the sums, one row per
(task, group), give every share its starting value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import durable

_SHARE = "__share"
_OFFSET = "__offset"


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including each row.

    ``order`` must be unique within a group. Use an integer or decimal ``value``
    where the exact total matters.
    """
    keys = [*group, *order]
    valued = df.withColumn(out, value)
    ranged = (
        valued.repartitionByRange(partitions, *keys)
        if partitions
        else valued.repartitionByRange(*keys)
    )
    # The shares must not move between the two reads below.
    shared = durable(ranged.withColumn(_SHARE, F.spark_partition_id()))
    sums = shared.groupBy(*group, _SHARE).agg(F.sum(out).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(_SHARE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select(
        *group, _SHARE, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(_OFFSET)
    )
    within = Window.partitionBy(*group, _SHARE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        shared.withColumn(out, F.sum(out).over(within))
        .join(offsets, [*group, _SHARE])
        .withColumn(out, F.col(out) + F.col(_OFFSET))
        .drop(_SHARE, _OFFSET)
    )


def dense_number(
    df: DataFrame, order: Sequence[str], out: str, start: int = 1
) -> DataFrame:
    """Add ``out``: consecutive numbers from ``start`` in the order of ``order``."""
    numbered = running_total(df, [], order, F.lit(1).cast("bigint"), out)
    return numbered.withColumn(out, F.col(out) + F.lit(start - 1))


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str
) -> DataFrame:
    """First ``k`` rows of each group, numbered from 1 in ``rank``.

    Spark limits every group to ``k`` rows in each map task before the shuffle,
    so a very large group never reaches one task whole.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def first_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """The row with the smallest ``order`` for each key, by partial aggregation."""
    best = F.min_by(F.struct(*carry), F.struct(*order)).alias("__first")
    return df.groupBy(*key).agg(best).select(*key, "__first.*")


def page_of(df: DataFrame, order: Sequence[Column], limit: int, page: int = 0) -> DataFrame:
    """One page of ``limit`` rows; a negative page or limit counts as zero.

    ``order`` must end with a unique key, so pages tile the result.
    """
    size = max(0, limit)
    return df.orderBy(*order).offset(max(0, page) * size).limit(size)
