"""Content hashes that are stored already, in buckets that a batch reads in place.

Hashes lie in a folder per leading digits, each cut into sorted buckets. A batch reads the folders of its own leading
digits only, and its hashes are dealt out the way the stored ones lie, so that the stored side of the
anti-join is neither shuffled nor read whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.documents import with_content_hash
from lexloom.sources.files import any_file


class HashStore:
    """Hashes by batch under ``folder``; a batch sees those of earlier batches."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, digits: int = 1):
        self.spark, self.folder, self.buckets, self.digits = spark, folder.rstrip("/"), buckets, digits
        # The catalog entry is this object's view of the folder; files belong to the folder.
        self.name = "lexloom_hashes_" + hashlib.sha256(self.folder.encode()).hexdigest()[:24]

    def __enter__(self) -> HashStore:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (sha256 STRING, batch BIGINT, prefix STRING) USING parquet "
            f"PARTITIONED BY (prefix) CLUSTERED BY (sha256) SORTED BY (sha256) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'"
        )
        if any_file(self.spark, f"{self.folder}/prefix=*"):
            # Finds the folders written under an earlier entry.
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self

    def __exit__(self, *problem) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _prefix(self):
        return F.substring("sha256", 1, self.digits)

    def add(self, hashes: DataFrame, batch: int) -> None:
        """Append the hashes (sha256) of a batch. A batch that is repeated adds nothing new."""
        rows = hashes.where("sha256 is not null").select("sha256", F.lit(batch).cast("bigint").alias("batch"), self._prefix().alias("prefix"))
        # Dealt out as they are stored, so that a task writes whole buckets.
        (
            rows.repartition(self.buckets, "sha256")
            .write.mode("append").format("parquet").partitionBy("prefix")
            .bucketBy(self.buckets, "sha256").sortBy("sha256").option("path", self.folder)
            .saveAsTable(self.name)
        )

    def stored(self, before: int, prefixes: list[str] | None = None) -> DataFrame:
        """Hashes of the batches before one, of some leading digits or all."""
        rows = self.spark.table(self.name).where(F.col("batch") < before)
        return rows if prefixes is None else rows.where(F.col("prefix").isin(prefixes))

    def new_documents(self, batch: DataFrame, number: int, key: str, content: str) -> DataFrame:
        """First copies of a batch's documents whose content no earlier batch has, with ``sha256``.

        Of a batch's documents without content one is new: they have no hash that could be stored.
        """
        hashed = with_content_hash(batch, content)
        # At most 16 to the power of the digits.
        held = hashed.select(self._prefix().alias("p")).where("p is not null").distinct().collect()
        known = self.stored(number, sorted(r.p for r in held)).select("sha256")
        # The stored side may hold a hash once per batch that was repeated: an anti-join does not mind.
        fresh = hashed.select(key, "sha256").join(known.hint("merge"), "sha256", "left_anti")
        keep = fresh.groupBy("sha256").agg(F.min(key).alias(key)).select(key)
        return hashed.join(keep, key, "left_semi")
