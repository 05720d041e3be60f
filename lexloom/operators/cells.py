"""Exact nearest vectors from a stored structure of cells.

Every vector lies in the cell of its nearest centre. A cell keeps its centre and the widest angle of its vectors to
it, so no vector of the cell can be closer to a query than the angle to the centre less that width. Cells are
read in the order of this bound until the next one cannot reach the hits found so far. Centres come from a bounded
sample; every vector is stored, with its length, and the answer is that of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.functions.vectors import norm, stored_cosine

#: Scores are compared after rounding to six places.
_SLACK = 2e-6


@dataclass(frozen=True)
class VectorCells:
    """Stored rows by cell, and one row per number of components and cell."""

    rows: DataFrame  # the table's columns, dim, cell, length
    cells: DataFrame  # dim, cell, centre, width, n


def _fit(sample: np.ndarray, cells: int, steps: int) -> np.ndarray:
    """Centres of unit length: the first rows, moved to the mean direction of those nearest to them."""
    centres = sample[:cells].copy()
    for _ in range(steps):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        lengths = np.linalg.norm(sums, axis=1)
        full = lengths > 1e-9
        centres[full] = sums[full] / lengths[full, None]
    return centres


def _assign(embedding: str, centres: dict[int, np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lengths = batch["dim"].to_numpy(), batch["length"].to_numpy()
            cell, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                flat = batch[embedding].take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float)
                cosines = flat.reshape(-1, dim) / lengths[mine, None] @ centres[dim].T
                cell[mine] = cosines.argmax(axis=1)
                angle[mine] = np.arccos(np.clip(cosines.max(axis=1), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(cell), pa.array(angle)], [*names, "cell", "angle"])

    return run


def write_cells(
    df: DataFrame, key: str, embedding: str, folder: str, cells: int = 64, sample_rows: int = 20_000, steps: int = 4
) -> None:
    """Store the vectors of ``df`` by cell, ``cells`` for each number of components.

    Centres are fitted on at most ``sample_rows`` vectors per number of components, by a hash of the key. Rows without a vector, of
    length zero, or with a null or non-finite component have no direction and are left out, as a search leaves them out.
    """
    raw = F.col(embedding)
    sound = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = df.where(raw.isNotNull() & sound).withColumn("dim", F.size(raw)).withColumn("length", norm(raw)).where("length > 0")
    centres: dict[int, np.ndarray] = {}
    for (dim,) in held.select("dim").distinct().orderBy("dim").collect():
        sample = held.where(F.col("dim") == dim).orderBy(F.xxhash64(key), key).limit(sample_rows).select(raw.alias("v"), "length").toArrow()
        flat = sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        centres[dim] = _fit(flat.reshape(-1, dim) / sample["length"].to_numpy()[:, None], cells, steps)
    names = held.columns
    fields = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in names)
    placed = held.mapInArrow(_assign(embedding, centres, names), f"{fields}, cell int, angle double")
    placed.hint("rebalance", "dim", "cell").write.mode("overwrite").partitionBy("dim", "cell").parquet(f"{folder}/rows")
    spark = df.sparkSession
    stored = spark.read.parquet(f"{folder}/rows") if centres else placed
    listed = [(d, i, c.tolist()) for d, all_ in centres.items() for i, c in enumerate(all_)]
    fitted = spark.createDataFrame(listed, "dim int, cell int, centre array<double>")
    sizes = stored.groupBy("dim", "cell").agg(F.max("angle").alias("width"), F.count("*").alias("n"))
    sizes.join(fitted, ["dim", "cell"]).write.mode("overwrite").parquet(f"{folder}/cells")


def read_cells(spark: SparkSession, folder: str) -> VectorCells:
    """Open stored cells."""
    cells = spark.read.parquet(f"{folder}/cells")
    if cells.isEmpty():
        return VectorCells(cells, cells)
    return VectorCells(spark.read.parquet(f"{folder}/rows"), cells)


@dataclass(frozen=True)
class CellSearch:
    """Hits of one query, and how much of the structure was read for them."""

    hits: DataFrame
    cells_read: int
    cells_held: int
    rows_read: int


def nearest_in_cells(
    stored: VectorCells, key: str, embedding: str, query: Sequence[float], k: int, score: str = "score"
) -> CellSearch:
    """The best ``k`` rows by cosine similarity, ties to the smaller key: what ``vector_leg`` finds by a scan.

    The list of cells, not of rows, comes to the driver. Each step reads twice as many cells as the last.
    """
    if k < 1:
        raise InvalidRequest("k must be positive")
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    if stored.cells.isEmpty() or not length:
        return CellSearch(stored.rows.limit(0).withColumn(score, F.lit(None).cast("double")), 0, 0, 0)
    listed = stored.cells.where(F.col("dim") == len(query)).select("cell", "centre", "width", "n").collect()
    unit = [float(x) / length for x in query]
    bounds = []
    for cell in listed:
        cosine = max(-1.0, min(1.0, sum(a * b for a, b in zip(unit, cell.centre))))
        # The centres' own lengths are one up to rounding, hence the slack.
        bounds.append((math.cos(max(0.0, math.acos(cosine) - cell.width - 1e-6)), cell.cell, cell.n))
    bounds.sort(key=lambda b: (-b[0], b[1]))
    columns = [c for c in stored.rows.columns if c not in ("dim", "cell", "length", "angle")]
    read, step = 0, max(1, len(bounds) // 16)
    best = None
    while read < len(bounds):
        read = min(len(bounds), read + step)
        step = read
        chosen = stored.rows.where((F.col("dim") == len(query)) & F.col("cell").isin([c for _, c, _ in bounds[:read]]))
        scored = chosen.withColumn(score, stored_cosine(F.col(embedding), F.col("length"), query))
        best = scored.select(*columns, score).orderBy(F.desc(F.round(score, 6)), key).limit(k)
        if read == len(bounds):
            break
        found = best.agg(F.count("*").alias("n"), F.min(F.round(score, 6)).alias("least")).first()
        if found.n == k and found.least > bounds[read][0] + _SLACK:
            break
    if best is None:
        best = stored.rows.limit(0).withColumn(score, F.lit(None).cast("double")).select(*columns, score)
    return CellSearch(best, read, len(bounds), sum(n for _, _, n in bounds[:read]))
