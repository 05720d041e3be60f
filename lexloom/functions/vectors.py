"""Similarity of embedding columns to one query vector."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_dot(vector, vector))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a fixed query vector, NULL for a zero vector.

    The vector is normalised in the expression; a table that is searched often
    should store unit vectors and use :func:`unit_dot`.
    """
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    constant = F.array(*[F.lit(float(x)) for x in query])
    divisor = norm(vector) * F.lit(length)
    return F.when(divisor > 0, _dot(vector, constant) / divisor)


def unit_dot(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity when both sides have length one."""
    return _dot(vector, F.array(*[F.lit(float(x)) for x in query]))


def stored_cosine(vector: Column, length: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a fixed query vector, from the stored length of the vector."""
    own = math.sqrt(sum(float(x) * float(x) for x in query))
    return _dot(vector, F.array(*[F.lit(float(x)) for x in query])) / (length * F.lit(own))
