"""Text quality by counts, fixed rules and robust multivariate outliers.

Counts of a text become a vector of transformed statistics. For every language and source the
minimum covariance determinant is sought from three starts: medians and quartiles, all rows, and the half of the rows
nearest to the medians in every statistic. A concentration step takes the share of rows closest to the estimate and
estimates mean and covariance from them; steps go on until no determinant falls any more, and of each group the start
with the least determinant counts. A row is an outlier if its Mahalanobis distance from that estimate is beyond a
quantile. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE, SPACE_CLASS
from lexloom.session import durable

#: Characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Whole parts of one unit of a transformed statistic, so that sums are exact in any order.
UNIT = 1024
FEATURES = ["__f0", "__f1", "__f2", "__f3", "__f4"]
#: Standard deviations that no estimate goes below, so that a constant statistic rejects nothing by chance.
FLOORS = (0.5, 0.4, 0.5, 0.5, 0.12)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Words are runs without ASCII white space. A line counts as a duplicate if it has a word and equals an
    earlier line; a word is repeated if it is in a three-word window that occurs twice or
    more in the text. A null text has no words. Windows are told apart by 64-bit hashes within one
    text. Every step is linear in the text, sorting aside.
    """
    keep = [F.col(c) for c in docs.columns if c != text]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    cut = docs.select(
        *keep,
        words.alias("__w"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        lines.alias("__lines"),
    )
    w = F.col("__w")
    # Named more than once within the function, a column is computed before it, not in it.
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    hashed = cut.select(
        *keep,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("__h"),
    )
    h = F.col("__h")
    again = F.size(F.array_distinct(h)) < F.size(h)
    placed = hashed.withColumn(
        "__s", F.when(again, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    ).drop("__h")
    s = F.col("__s")
    twice = F.filter(
        s,
        lambda e, j: F.coalesce(e.h == F.get(s, j + 1).h, F.lit(False))
        | (F.when(j > 0, e.h == F.get(s, F.greatest(j - 1, F.lit(0))).h).otherwise(F.lit(False))),
    )
    starts = placed.withColumn("__p", F.sort_array(F.transform(twice, lambda e: e.i))).drop("__s")
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("__p")


def base_failed() -> Column:
    """The fixed rule: too few words, or more than half of them repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while abs(term) > 1e-17 * abs(total):
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(share: float, freedom: int) -> float:
    """Quantile of the chi-squared distribution, by bisection."""
    low, high = 0.0, 400.0
    for _ in range(200):
        middle = (low + high) / 2
        if _gamma_share(freedom / 2, middle / 2) < share:
            low = middle
        else:
            high = middle
    return high


def _group_key(*columns: str) -> Column:
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.concat_ws("/", *parts)


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``__g``: language and source; the language for small groups together; all for small rests.

    Rows that fail the fixed rule have a group too, but only the others count.
    """
    named = rows.withColumn("__ls", _group_key("lang", "source")).withColumn("__l", _group_key("lang"))
    own = named.groupBy("__ls", "__l").agg(F.count_if(~F.col("base_failed")).alias("__n"))
    rest = own.where(F.col("__n") < least).groupBy("__l").agg(F.sum("__n").alias("__m"))
    mapped = own.join(rest, "__l", "left").select(
        "__ls",
        F.when(F.col("__n") >= least, F.concat(F.lit("s"), "__ls"))
        .when(F.col("__m") >= least, F.concat(F.lit("l"), "__l"))
        .otherwise(F.lit("all"))
        .alias("__g"),
    )
    return named.join(mapped, "__ls").drop("__ls", "__l")


#: Keys of an estimate: the group, and the start that it comes from.
_KEYS = ["__g", "__start"]


def _triangle(estimate: DataFrame) -> DataFrame:
    """The lower triangle t_i_j of each covariance, T T' = C, and ``__det``, the logarithm of its determinant."""
    size = len(FEATURES)
    out = estimate
    for j in range(size):
        inner = sum((F.col(f"__t_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"__t_{j}_{j}", F.sqrt(F.greatest(F.col(f"__c_{j}_{j}") - inner, F.lit(FLOORS[j] ** 2 * 1e-3))))
        for i in range(j + 1, size):
            inner = sum((F.col(f"__t_{i}_{k}") * F.col(f"__t_{j}_{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"__t_{i}_{j}", (F.col(f"__c_{j}_{i}") - inner) / F.col(f"__t_{j}_{j}"))
    keep = [f"__m_{i}" for i in range(size)] + [f"__t_{i}_{j}" for i in range(size) for j in range(i + 1)]
    det = sum((F.log(F.col(f"__t_{i}_{i}")) for i in range(size)), F.lit(0.0)) * 2
    return out.select(*_KEYS, *keep, det.alias("__det"))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance of each group and start, from exact sums of whole parts, floors added."""
    size = len(FEATURES)
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(FEATURES[i]).alias(f"s_{i}") for i in range(size)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q_{i}_{j}") for i in range(size) for j in range(i, size)]
    total = rows.groupBy(*_KEYS).agg(*sums)
    mean = {i: F.col(f"s_{i}") / F.col("n") / UNIT for i in range(size)}
    columns = [mean[i].alias(f"__m_{i}") for i in range(size)]
    for i in range(size):
        for j in range(i, size):
            cov = F.col(f"q_{i}_{j}") / F.col("n") / UNIT / UNIT - mean[i] * mean[j]
            columns.append((cov + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"__c_{i}_{j}"))
    return _triangle(total.select(*_KEYS, *columns))


def _middles(rows: DataFrame) -> DataFrame:
    """Medians of each group and start, and spreads from the quartiles, apart by statistic."""
    size = len(FEATURES)
    quarters = rows.groupBy(*_KEYS).agg(
        *(F.percentile_approx(f, [0.25, 0.5, 0.75], 10_000).alias(f"p_{i}") for i, f in enumerate(FEATURES))
    )
    columns = []
    for i in range(size):
        p = F.col(f"p_{i}")
        columns.append((p[1] / UNIT).alias(f"__m_{i}"))
        spread = (p[2] - p[0]) / UNIT / 1.349
        for j in range(i, size):
            columns.append((spread**2 + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"__c_{i}_{j}"))
    return _triangle(quarters.select(*_KEYS, *columns))


def _with_distance(rows: DataFrame, estimate: DataFrame, out: str, keys: list[str], widest: bool = False) -> DataFrame:
    """Adds the squared Mahalanobis distance: forward substitution through the triangle; ``widest``: the largest part alone."""
    joined, size = rows.join(estimate, keys), len(FEATURES)
    for i in range(size):
        gap = F.col(FEATURES[i]) / UNIT - F.col(f"__m_{i}")
        inner = sum((F.col(f"__t_{i}_{k}") * F.col(f"__y_{k}") for k in range(i)), F.lit(0.0))
        joined = joined.withColumn(f"__y_{i}", (gap - inner) / F.col(f"__t_{i}_{i}"))
    parts = [F.col(f"__y_{i}") ** 2 for i in range(size)]
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), (F.greatest(*parts) if widest else sum(parts)).alias(out))


def _closest(rows: DataFrame, estimate: DataFrame, share: float, widest: bool = False) -> DataFrame:
    """The share of each group's rows closest to its estimate, by narrow bins of the distance."""
    binned = _with_distance(rows, estimate, "d", _KEYS, widest).withColumn("bin", F.floor(F.log(F.col("d") + 1e-6) * 64))
    counts = binned.groupBy(*_KEYS, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_KEYS).orderBy("bin"))
    cut = (
        counts.select(*_KEYS, "bin", "n", upto.alias("upto"), F.sum("n").over(Window.partitionBy(*_KEYS)).alias("all"))
        .where(F.col("upto") - F.col("n") < F.col("all") * share)
        .groupBy(*_KEYS)
        .agg(F.max("bin").alias("most"))
    )
    return binned.join(cut, _KEYS).where(F.col("bin") <= F.col("most"))


def least_determinants(rows: DataFrame, share: float, most_steps: int) -> DataFrame:
    """For each ``__g`` of ``rows`` the estimate with the least determinant over all starts.

    Steps end when the determinant of no group and start falls by a thousandth, or after ``most_steps``; of a start
    the least one counts.
    """
    slim = durable(rows.select("__g", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("__start"), *FEATURES))
    first = slim.where("__start = 0")
    middles = durable(_middles(first))
    near = _closest(slim.where("__start = 2"), middles.withColumn("__start", F.lit(2)), 0.5, widest=True)
    # The medians are not those of a set of rows, so any determinant is better.
    starts = middles.withColumn("__det", F.lit(float("inf")))
    best = durable(starts.unionByName(_moments(slim.where("__start = 1"))).unionByName(_moments(near)))
    for _ in range(most_steps):
        moved = durable(_moments(_closest(slim, best, share)))
        new, old = F.struct(*moved.columns), F.struct(*best.columns)
        both = moved.select(*_KEYS, new.alias("new")).join(best.select(*_KEYS, old.alias("old")), _KEYS)
        lower = F.col("new.__det") < F.col("old.__det") - 1e-3
        both = durable(both.select(lower.alias("lower"), F.when(lower, F.col("new")).otherwise(F.col("old")).alias("e")))
        best = both.select("e.*")
        if both.where("lower").isEmpty():
            break
    fields = [c for c in best.columns if c != "__g"]
    chosen = best.groupBy("__g").agg(F.min_by(F.struct(*fields), F.struct("__det", "__start")).alias("e"))
    return durable(chosen.select("__g", "e.*"))


def judge_quality(
    docs: DataFrame,
    share: float = 0.75,
    most_steps: int = 20,
    quantile: float = 1 - 1e-7,
    least: int = 30,
    text: str = "text",
) -> DataFrame:
    """``docs`` without ``text``, with the counts, ``base_failed``, ``distance`` (squared) and ``kept``.

    Rows that fail the fixed rule are not kept, have no distance, and estimate nothing. The others are
    kept up to the ``quantile`` of the chi-squared distribution. A language and source with fewer than
    ``least`` such rows, six for each statistic, gives no covariance of its own: it is judged with the other such
    sources of the language, or if these are too few with those of all languages. Null languages and sources are values of their own; a null or
    empty text fails the fixed rule. Repeated rows count each. Columns of the same names are replaced, names that
    begin with two underscores are this function's own. An empty table gives an empty result.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"}
    base = docs.select(*(c for c in docs.columns if c not in new))
    counted = text_counts(base, text).withColumn("base_failed", base_failed())
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    values = [
        F.log(1.0 + F.col("n_words")),
        F.col("word_chars") / per_word,
        F.log(1.0 + 1000.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log(1.0 + F.col("n_dup_lines")),
        F.sqrt(F.col("n_repeat_words") / per_word),
    ]
    rows = durable(
        _grouped(
            counted.withColumns({f: F.round(v * UNIT).cast("bigint") for f, v in zip(FEATURES, values)}), least
        )
    )
    estimate = least_determinants(rows.where(~F.col("base_failed")), share, most_steps)
    size = len(FEATURES)
    # Covariances of the closest rows are too small by this factor, were all rows normal.
    shrunk = _gamma_share(size / 2 + 1, chi2_quantile(share, size) / 2) / share
    fallback = rows.join(estimate.select("__g"), "__g", "left_anti").withColumn("distance", F.lit(None).cast("double"))
    measured = _with_distance(rows, estimate, "distance", ["__g"]).withColumn("distance", F.col("distance") * shrunk)
    judged = measured.unionByName(fallback).withColumn(
        "distance", F.when(~F.col("base_failed"), F.col("distance"))
    )
    verdict = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(quantile, size))
    return judged.withColumn("kept", verdict).drop("__g", *FEATURES)
