"""Pull what is new, skip what is known, keep daily totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.sources.files import any_file, folders
from lexloom.streaming.hashes import HashStore


def read_new_files(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Stream of Parquet files as they appear; the checkpoint remembers those seen."""
    return (
        spark.readStream.format("parquet")
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )


def read_table_files(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Stream of a table's files: those of the folder ``name``, or the one file of that name."""
    held = folders(spark, f"{folder}/{name}")
    return read_new_files(spark, held[0], schema) if held else read_new_files(spark, folder, schema, name)


def ingest_documents(
    stream: DataFrame, out: str, checkpoint: str, key: str, content: str, buckets: int = 16
) -> StreamingQuery:
    """Append documents whose content is not stored yet, until the source is drained.

    Each batch is written to a folder of its own number, so a batch that is
    repeated after a failure replaces itself. Its hashes are added to ``out``-hashes only then; a repeated batch
    sees those of earlier batches, not its own.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with HashStore(spark, f"{out.rstrip('/')}-hashes", buckets) as store:
            if not any_file(spark, f"{out}-hashes/prefix=*") and any_file(spark, f"{out}/batch=*"):
                # Documents stored before there were hashes.
                store.add(spark.read.parquet(out).where(F.col("batch") < number).select("sha256"), number - 1)
            path = f"{out}/batch={number}"
            store.new_documents(batch, number, key, content).write.mode("overwrite").parquet(path)
            store.add(spark.read.parquet(path).select("sha256"), number)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drop_repeats(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Drop events whose key was seen within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_totals(events: DataFrame, ts: str, value: str) -> DataFrame:
    """Events and value per UTC day; works on a stream and on a table.

    A stream keeps one row of state per day and takes late events whenever they
    come, so no watermark is set.
    """
    return (
        events.groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count("*").alias("calls"), F.sum(value).alias("total"))
        .select(F.col("w.start").cast("date").alias("day"), "calls", "total")
    )


def run_daily_totals(
    stream: DataFrame, ts: str, value: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Keep the latest total of each day under ``out`` until the source is drained.

    Update mode gives each batch's changed days; :func:`read_daily_totals` keeps
    the newest batch of each day.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        daily_totals(stream, ts, value)
        .writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_daily_totals(spark: SparkSession, out: str) -> DataFrame:
    """Latest total of each day."""
    return (
        spark.read.parquet(out).groupBy("day")
        .agg(F.max_by(F.struct("calls", "total"), "batch").alias("t"))
        .select("day", "t.calls", "t.total")
    )
