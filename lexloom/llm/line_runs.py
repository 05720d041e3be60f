"""Lines that many documents share, counted in levelled sorted runs of line hashes.

Documents come in batches. A batch is reduced to (line hash, documents); a merge
anti-join takes out the keys that the stored runs know to be common already, and the
rest is added as a sorted run of level 0. When a level holds ``fanout`` runs they
are merged into one run of the next level, so there are only logarithmically many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE, ascii_lower, key_hash, scratch
from lexloom.session import durable

_KEY = ["h1", "h2"]
_SCHEMA = "h1 bigint, h2 bigint, n bigint"


class LineRuns:
    """Sorted runs of (h1, h2, n): documents counted per 128-bit line hash.

    A run becomes visible only after its table is written, so a lost executor or a
    failed batch leaves the store as it was. Counts of batches with no document in
    common add up.
    """

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 3):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.levels: list[list[str]] = [[]]

    def _runs(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(_SCHEMA)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)

    def counts(self) -> DataFrame:
        """Documents per key over all runs. A key that reached ``enough`` may have met more."""
        stored = self._runs([path for level in self.levels for path in level])
        return stored.groupBy(*_KEY).agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame:
        """Keys of at least ``enough`` documents."""
        return self.counts().where(F.col("n") >= self.enough).select(*_KEY)

    def _write(self, level: int, keys: DataFrame) -> None:
        path = scratch(self.spark, f"lines-{level}")
        keys.sort(*_KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n); keys already known as common stay out."""
        known = any(self.levels)
        fresh = batch.join(self.common().hint("merge"), _KEY, "left_anti") if known else batch
        self._write(0, fresh.select(*_KEY, F.col("n").cast("bigint").alias("n")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._runs(self.levels[level]).groupBy(*_KEY).agg(F.sum("n").alias("n"))
            self._write(level + 1, merged)
            self.levels[level] = []
            level += 1


def line_key(line: Column) -> Column:
    """What two equal lines share: white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _identity(doc_id: str, text: str) -> Column:
    """Tells rows apart; only rows equal in id and text share it, and their results."""
    return F.struct(*(h.alias(n) for h, n in zip(key_hash(F.col(doc_id), F.col(text)), "ab"))).alias("__row")


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    fanout: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``text`` freed of common lines, and ``n_lines``, ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and occurs in ``min_docs``
    documents or more goes from every document, its first one included. A null or
    empty text is one empty line, so it comes back as empty text. Rows with one id are
    one document, as are rows without id; each row keeps its own lines. Other columns pass
    through; an input column called ``n_lines`` or ``n_dropped`` is replaced. An empty
    table gives an empty table.

    Only hashes, line numbers and ids are stored; the texts move once, for the last join.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("__doc"),
        _identity(doc_id, text),
        # The outer form, as the other splits every text once more to see that it has lines.
        F.posexplode_outer(F.split(whole, "\n", -1)).alias("pos", "line"),
    )
    keyed = rows.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= max(min_chars, 0))
    h1, h2 = key_hash(F.col("key"))
    path = scratch(spark, "line-hashes")
    (
        keyed.select(
            "__doc", "__row", "pos", h1.alias("h1"), h2.alias("h2"),
            F.pmod(F.xxhash64("__doc"), F.lit(batches)).cast("int").alias("batch"),
        )
        .write.partitionBy("batch")
        .parquet(path)
    )
    schema = "__doc {}, __row struct<a:bigint,b:bigint>, pos int, h1 bigint, h2 bigint, batch int".format(
        docs.schema[doc_id].dataType.simpleString()
    )
    hashes = spark.read.schema(schema).parquet(path)

    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        own = hashes.where(F.col("batch") == batch).select("__doc", *_KEY).distinct()
        runs.add(own.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")))

    gone = (
        hashes.join(durable(runs.common()), _KEY, "left_semi")
        .groupBy("__row")
        .agg(F.collect_set("pos").alias("__gone"))
    )
    # The lines are cut before the join, so that they are a stored column after it.
    cut = docs.drop("n_lines", "n_dropped").select(
        *(F.col(c) for c in docs.columns if c not in (text, "n_lines", "n_dropped")),
        F.split(whole, "\n", -1).alias("__lines"),
        _identity(doc_id, text),
    )
    joined = cut.join(gone, "__row", "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(
        F.transform(left, lambda i: F.get(F.col("__lines"), i))
    )
    values = {
        text: F.array_join(kept, "\n"),
        "n_lines": F.size("__lines").cast("bigint"),
        "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"),
    }
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    return joined.select(*(values[c].alias(c) if c in values else F.col(c) for c in names))
