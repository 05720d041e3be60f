"""Session defaults and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.errors import SourceUnavailable

#: Planner settings every job relies on. Sizes are left to the optimizer: a side
#: is broadcast only when its measured size is under the session threshold, and
#: adaptive execution splits skewed partitions and merges small ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """Create a session with the package defaults; ``settings`` win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder, which is
    remembered for the rest of the session. A cluster without it is refused: a
    machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise SourceUnavailable(
            "set spark.checkpoint.dir to a folder shared by all executors"
        )
    folder = tempfile.mkdtemp(prefix="lexloom-")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several branches of a plan, or where rows must not
    move between two reads. The plan starts afresh from the table, whose measured
    size the optimizer then knows, and an executor can be lost without losing it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lexloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
