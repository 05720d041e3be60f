"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length, large groups split evenly. A query first meets the longest vectors, which
gives it a score to beat. A group whose longest vector cannot beat it is never visited; in a visited group each small
bucket of like lengths turns that score into a cosine to beat, and prunes its
vectors by length alone, or where the cosine is high by the coordinate on which the
query is largest. What is left is verified by whole products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ordering import top_per_group
from lexloom.session import durable

_SLACK = 1e-9
_EXACT = float(1 << 53)
_STEEP = 0.6
_BUCKET = 512


def whole_vectors(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, dim, norm, copies): floor(scale * x) of each component, without unusable rows; equal rows are counted.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    raw = F.col(embedding).cast("array<double>")
    sound = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(F.col(vec_id).isNotNull() & raw.isNotNull() & sound)
    whole = kept.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(raw, lambda x: F.floor(x * F.lit(scale)).cast("bigint")).alias("v"),
    ).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    square: Column = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return whole.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(square).alias("norm"), "copies")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.empty((len(column), 0), np.int64)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exactly: in doubles where they hold them, else in Python's whole numbers."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    bound = float(np.abs(queries.astype(float)).max()) * float(np.abs(rows.astype(float)).max()) * queries.shape[1]
    if bound < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries.astype(object) @ rows.astype(object).T


def _survivors(query: np.ndarray, length: float, beat: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of one bucket (longest first) that may reach ``beat``, by length or by one coordinate."""
    if not np.isfinite(beat) or beat <= 0 or length == 0:
        return np.arange(len(rows))
    cosine = beat / (length * norms[0]) if norms[0] else np.inf
    if cosine > 1 + _SLACK:
        return np.empty(0, np.int64)
    # Sorted by length, so those long enough are a prefix.
    fit = np.searchsorted(-norms, -(beat / length) * (1 - _SLACK), side="right")
    if cosine < _STEEP:
        return np.arange(fit)
    # With unit vectors q, c and q.c >= t, a coordinate of c is within sqrt((1 - t^2)(1 - q_f^2)) of t' q_f, t' in [t, 1].
    focus = int(np.abs(query).argmax())
    part = query[focus] / length
    cosines = np.minimum(beat / (length * np.maximum(norms[:fit], 1e-300)), 1.0)
    wide = np.sqrt(np.maximum(1 - cosines**2, 0)) * np.sqrt(max(1 - part * part, 0.0))
    unit = rows[:fit, focus] / np.maximum(norms[:fit], 1e-300)
    low = np.minimum(part * cosines, part) - wide - 1e-7
    high = np.maximum(part * cosines, part) + wide + 1e-7
    return np.flatnonzero((unit >= low) & (unit <= high))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 8 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _starter(seeds: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    """Gives each query the k-th best score among the longest vectors, its own left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch["vec_id"].to_numpy(), batch["dim"].to_numpy()
            beat = np.full(len(ids), -np.inf)
            for dim, seed_ids, seed_rows in seeds:
                mine = np.flatnonzero(dims == dim)
                if not len(mine):
                    continue
                scores = products(_matrix(pa.chunked_array([batch["v"].take(pa.array(mine))]), dim), seed_rows).astype(float)
                scores[ids[mine][:, None] == seed_ids[None, :]] = -np.inf
                if len(seed_ids) >= k:
                    beat[mine] = np.partition(scores, len(seed_ids) - k, axis=1)[:, len(seed_ids) - k]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names), pa.array(beat)], [*batch.schema.names, "beat"])

    return run


def _visit(k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": [], "copies": []}
        if len(queries) and len(rows):
            dim = key[0].as_py()
            order = np.argsort(-rows["norm"].to_numpy(), kind="stable")
            norms, ids, copies = (rows[c].to_numpy()[order] for c in ("norm", "vec_id", "copies"))
            held = _matrix(rows["v"], dim)[order]
            asked, lengths = _matrix(queries["v"], dim), queries["norm"].to_numpy()
            for query, length, own, beat in zip(asked, lengths, queries["vec_id"].to_pylist(), queries["beat"].to_pylist()):
                top_ids, top_scores, top_copies = (np.empty(0, np.int64) for _ in range(3))
                for at in range(0, len(ids), _BUCKET):
                    here = slice(at, at + _BUCKET)
                    left = _survivors(query, length, beat, held[here], norms[here]) + at
                    left = left[ids[left] != own]
                    if not len(left):
                        continue
                    top_ids = np.concatenate([top_ids, ids[left]])
                    top_copies = np.concatenate([top_copies, copies[left]])
                    top_scores = np.concatenate([top_scores, products(query[None, :], held[left])[0].astype(np.int64)])
                    best = _best(top_scores, top_ids, k)
                    top_ids, top_scores, top_copies = top_ids[best], top_scores[best], top_copies[best]
                    if len(top_ids) == k:
                        beat = max(beat, float(top_scores[-1]))
                out["query_id"] += [own] * len(top_ids)
                out["vec_id"] += top_ids.tolist()
                out["score"] += top_scores.tolist()
                out["copies"] += top_copies.tolist()
        return pa.table({name: pa.array(v, pa.int64()) for name, v in out.items()})

    return run


def top_products(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    scale: float = 256.0,
    seeds: int = 2048,
    group_rows: int = 8192,
    query_rows: int = 2048,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every query, ties to the smaller id.

    ``queries`` is a condition on ``vec_id``. The score is the inner product of floor(``scale`` * x). A query's
    candidates are all rows of other ids with as many components, repeated rows each; fewer than ``k`` are
    all returned. A query that is given several times is answered once; different vectors under one id share one list. Unusable rows (see ``whole_vectors``) take no part; a table without
    usable rows gives an empty result. A score that a long cannot hold raises.

    Queries and vectors meet in groups of at most about ``query_rows`` and ``group_rows`` rows,
    split by a hash, so a length that a third of all vectors share is spread as well.
    """
    whole = durable(whole_vectors(vectors, scale, vec_id, embedding))
    # The longest vectors of each number of components: a bounded number of them, as starting points.
    longest = top_per_group(whole, ["dim"], [F.desc("norm"), F.col("vec_id")], seeds, "place")
    seen = longest.orderBy("dim", "place").limit(4 * seeds).toArrow()
    starts = [
        (dim, part["vec_id"].to_numpy(), _matrix(part["v"], dim))
        for dim in sorted(set(seen["dim"].to_pylist()))
        for part in [seen.filter(pc.equal(seen["dim"], dim))]
    ]
    schema = "vec_id bigint, v array<bigint>, dim int, norm double, copies bigint"
    asked = durable(whole.where(queries).mapInArrow(_starter(starts, k), f"{schema}, beat double"))
    # Groups of like lengths: five hundredths of the logarithm apart.
    ranged = whole.withColumn("range", F.floor(F.log(F.col("norm") + 1e-9) * 20))
    sizes = ranged.groupBy("dim", "range").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("parts"))
    placed = ranged.join(sizes, ["dim", "range"]).select(
        "dim", "range", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v", "norm", "copies"
    )
    shares = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("shares"))
    groups = durable(placed.groupBy("dim", "range", "part").agg(F.max("norm").alias("longest")))
    key = ["dim", "range", "part", "share"]
    near = asked.join(groups, "dim").where(
        (F.col("beat") <= 0) | (F.col("norm") * F.col("longest") * (1 + _SLACK) >= F.col("beat"))
    )
    left = near.join(shares, "dim").select(
        "dim", "range", "part", F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int").alias("share"),
        "vec_id", "v", "norm", "beat",
    )
    right = placed.join(shares, "dim").select(
        "dim", "range", "part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "vec_id", "v", "norm", "copies"
    )
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _visit(k), "query_id bigint, vec_id bigint, score bigint, copies bigint"
    )
    order = [F.desc("score"), F.col("vec_id")]
    # The best different rows first: among them are the best rows, copies counted.
    best = top_per_group(found, ["query_id"], order, k, "place")
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    ranked = top_per_group(each, ["query_id"], order, k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
