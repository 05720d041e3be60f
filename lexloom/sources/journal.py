"""Appends that several writers make to one table, each whole or not at all.

A batch is written to a folder of its own with numbers from 0. It is committed by one entry in the journal, which gives its
first id: entries are numbered, an entry is made only if its number is free, and its range starts where the one before
ended. A writer that finds its number taken reads on and takes the next. Readers see batches that have an entry, so
neither half-written batches nor those of failed writers.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import SourceUnavailable
from lexloom.operators.ordering import dense_number
from lexloom.sources.files import any_file

_ENTRY = "number bigint, batch string, first bigint, rows bigint"


def publish(spark: SparkSession, path: str, content: str) -> bool:
    """Put a small file at ``path`` whole, unless there is one; whether it was put there.

    On a mounted folder by a hard link, elsewhere by a rename that does not replace, as HDFS has it. Stores without
    either are not fit for a journal.
    """
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        target = unquote(parsed.path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        own = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as file:
            file.write(content)
        try:
            os.link(own, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    own = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(own, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    if system.rename(own, target):
        return True
    system.delete(own, False)
    return False


class RowJournal:
    """A table of rows with ids under ``folder``; ids continue from ``start``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "id", start: int = 1):
        self.spark, self.folder, self.schema, self.key, self.start = spark, folder.rstrip("/"), schema, key, start

    def entries(self) -> DataFrame:
        """The journal, one row per committed batch."""
        if not any_file(self.spark, f"{self.folder}/journal/*.json"):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).json(f"{self.folder}/journal")

    def stage(self, rows: DataFrame, order: list[str]) -> tuple[str, int]:
        """Write a batch in ``order`` without committing it: its name and number of rows."""
        batch = uuid.uuid4().hex
        path = f"{self.folder}/data/batch={batch}"
        columns = [part.split()[0] for part in self.schema.split(", ")]
        kept = rows.select(*(c for c in columns if c != self.key))
        dense_number(kept, order, self.key, start=0).select(*columns).write.parquet(path)
        return batch, self.spark.read.parquet(path).count()

    def commit(self, batch: str, rows: int) -> int:
        """Give a staged batch its range of ids; the first of them. A batch is committed once."""
        while True:
            last = self.entries().orderBy(F.desc("number")).first()
            done = self.entries().where(F.col("batch") == batch).first()
            if done:
                return done.first
            number = last.number + 1 if last else 0
            first = last["first"] + last.rows if last else self.start
            entry = json.dumps({"number": number, "batch": batch, "first": first, "rows": rows})
            if publish(self.spark, f"{self.folder}/journal/{number:012d}.json", entry):
                return first

    def append(self, rows: DataFrame, order: list[str]) -> tuple[int, int]:
        """Append rows in ``order``: the first id and the number of rows."""
        batch, count = self.stage(rows, order)
        return self.commit(batch, count), count

    def read(self) -> DataFrame:
        """All committed rows with their ids."""
        entries = self.entries()
        if entries.isEmpty():
            return self.spark.createDataFrame([], self.schema)
        columns = [part.split()[0] for part in self.schema.split(", ")]
        base = f"{self.folder}/data"
        data = self.spark.read.schema(f"{self.schema}, batch string").option("basePath", base).parquet(base)
        joined = data.join(entries.select("batch", F.col("first").alias("__first")), "batch")
        return joined.withColumn(self.key, F.col(self.key) + F.col("__first")).select(*columns)

    def check(self) -> None:
        """Fail unless the ranges follow each other without gap."""
        at = self.start
        for entry in self.entries().orderBy("number").collect():
            if entry["first"] != at:
                raise SourceUnavailable(f"journal entry {entry.number} starts at {entry['first']}, not {at}")
            at += entry.rows
