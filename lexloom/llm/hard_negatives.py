"""Hard negatives by a secondary sort.

Scored pairs travel under one packed key (anchor, descending score, id). Pairs are dealt out by anchor and sorted by
the key within each partition: the DataFrame form of repartitionAndSortWithinPartitions, so the sort
may spill and nothing of an anchor is gathered. One iterator then walks a partition: a positive opens a window of
scores, negatives that fall into open windows come out at once, and what has been read is forgotten.

Blocks of anchors and rows are scored by matrix products. Before the shuffle a block keeps, for each anchor, only
what can still be among the first: its best same-label rows, and then for each window its best rows of another label.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows with the anchor's own id are
never partners of it; equal rows under another id count each. An anchor given several times has its rows as often.
Vectors meet only those with as many components. Without partners, or in an empty table, there are no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.topk import products
from lexloom.session import durable

#: The key: anchor id, anchor's variant (rows of one id may differ), descending score, id. All unsigned
#: and big-endian, so that bytes sort as the numbers do.
_KEY = struct.Struct(">QQQQ")
_FLIP = 1 << 63
_TOP = (1 << 64) - 1

_PAIRS = "key binary, copies bigint"


def pack_key(anchor: int, variant: int, score: int, vec_id: int) -> bytes:
    """The bytes that sort by anchor, then from the highest score, then by id."""
    return _KEY.pack(anchor + _FLIP, variant + _FLIP, _TOP - (score + _FLIP), vec_id + _FLIP)


def unpack_key(key: bytes) -> tuple[int, int, int, int]:
    anchor, variant, score, vec_id = _KEY.unpack(key)
    return anchor - _FLIP, variant - _FLIP, _TOP - score - _FLIP, vec_id - _FLIP


def labelled_vectors(
    vectors: DataFrame, label: Column, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, label, v, dim, copies): floor(scale * x) of each component of the usable rows, equal rows counted."""
    raw = F.col(embedding).cast("array<double>")
    sound = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(F.col(vec_id).isNotNull() & label.isNotNull() & raw.isNotNull() & sound)
    whole = kept.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        label.cast("int").alias("label"),
        F.transform(raw, lambda x: F.floor(x * F.lit(scale)).cast("bigint")).alias("v"),
    )
    counted = whole.groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies"))
    return counted.select("vec_id", "label", "v", F.size("v").alias("dim"), "copies")


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _rows(table: pa.Table, dim: int) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim) if dim else np.empty((table.num_rows, 0), np.int64)


def _products(anchors: pa.Table, rows: pa.Table, dim: int) -> np.ndarray:
    return products(_rows(anchors, dim), _rows(rows, dim)).astype(np.int64, copy=False)


def _firsts(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by descending score and id. Rows are distinct, so no copy is needed twice."""
    if len(scores) > 8 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class _Pairs:
    """Pairs of one block on their way to the shuffle."""

    def __init__(self):
        self.keys, self.copies = [], []

    def add(self, anchor: int, variant: int, places, scores, ids, copies) -> None:
        for i in places.tolist():
            self.keys.append(pack_key(anchor, variant, int(scores[i]), int(ids[i])))
            self.copies.append(int(copies[i]))

    def table(self) -> pa.Table:
        return pa.table({"key": pa.array(self.keys, pa.binary()), "copies": pa.array(self.copies, pa.int64())})


def _best_positives(k: int):
    def run(key: tuple[pa.Scalar, ...], anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = _Pairs()
        if len(anchors) and len(rows):
            dim = key[0].as_py()
            ids, copies = rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
            every = _products(anchors, rows, dim)
            for own, variant, scores in zip(anchors["vec_id"].to_pylist(), anchors["variant"].to_pylist(), every):
                others = np.flatnonzero(ids != own)
                places = others[_firsts(scores[others], ids[others], k)]
                out.add(own, variant, places, scores, ids, copies)
        return out.table()

    return run


def _best_negatives(k: int, low: int, high: int):
    def run(key: tuple[pa.Scalar, ...], anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = _Pairs()
        if len(anchors) and len(rows):
            dim = key[0].as_py()
            ids, labels, copies = (rows[c].to_numpy() for c in ("vec_id", "label", "copies"))
            every = _products(anchors, rows, dim)
            about = zip(*(anchors[c].to_pylist() for c in ("vec_id", "variant", "label", "positives")), every)
            for own, variant, label, positives, scores in about:
                windows = [window_of(p, low, high) for p in sorted(set(positives), reverse=True)]
                least = min(a for a, _ in windows)
                near = np.flatnonzero((scores >= least) & (labels != label) & (ids != own))
                near = near[np.lexsort((ids[near], -scores[near]))]
                falling = -scores[near]
                chosen = set()
                for a, b in windows:
                    # Sorted from the highest, so a window is one stretch.
                    start, end = np.searchsorted(falling, -b, "left"), np.searchsorted(falling, -a, "right")
                    chosen.update(near[start : min(end, start + k)].tolist())
                out.add(own, variant, np.array(sorted(chosen), np.int64), scores, ids, copies)
        return out.table()

    return run


def sorted_by_anchor(pairs: DataFrame, partitions: int) -> DataFrame:
    """Pairs dealt out by anchor and sorted by the packed key within each partition."""
    return pairs.repartition(partitions, F.substring("key", 1, 16)).sortWithinPartitions("key")


def _first_positives(k: int):
    """Walks sorted pairs and gives each anchor the scores of its first k positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held = None, 0
        for batch in batches:
            out = {"key": [], "vec_id": [], "variant": [], "score": []}
            for key, copies in zip(batch["key"].to_pylist(), batch["copies"].to_pylist()):
                own, variant, score, _ = unpack_key(key)
                if (own, variant) != anchor:
                    anchor, held = (own, variant), 0
                for _ in range(min(copies, k - held)):
                    held += 1
                    for name, value in zip(out, (key, own, variant, score)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.binary() if n == "key" else pa.int64()) for n, v in out.items()})

    return run


def open_windows(pairs: Iterator[tuple[bytes, bool, int]], n_positives: int, n_negatives: int, low: int, high: int):
    """Walk pairs (key, positive, copies) in the order of their keys and give (anchor, positive, rank, negative) tuples.

    Scores fall along an anchor's pairs, so a window opens at its positive and closes below its least score. Only windows
    that are open are held, besides at most ``n_negatives`` negatives of the present score: a positive of
    score 0 has a window at that score alone, and may follow its negatives there.
    """
    anchor, windows, opened, level, level_negatives = None, [], 0, None, []
    for key, positive, copies in pairs:
        own, variant, score, vec_id = unpack_key(key)
        if (own, variant) != anchor:
            anchor, windows, opened, level = (own, variant), [], 0, None
        if score != level:
            level, level_negatives = score, []
            windows = [w for w in windows if w[3] <= score and w[4] < n_negatives]
        for _ in range(min(copies, n_positives if positive else n_negatives)):
            if positive:
                if opened == n_positives:
                    break
                opened += 1
                least, most = window_of(score, low, high)
                window = [vec_id, score, most, least, 0]
                if least <= most:
                    windows.append(window)
                    # Only a score of 0 lies within its own window.
                    for negative in level_negatives if least <= score <= most else ():
                        window[4] += 1
                        yield own, variant, vec_id, window[4], negative, window[1], score
            else:
                if len(level_negatives) < n_negatives:
                    level_negatives.append(vec_id)
                for window in windows:
                    if window[3] <= score <= window[2] and window[4] < n_negatives:
                        window[4] += 1
                        yield own, variant, window[0], window[4], vec_id, window[1], score


_OUT = ["anchor_id", "variant", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _emit(n_positives: int, n_negatives: int, low: int, high: int, size: int = 8192):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in ("key", "positive", "copies")))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32() if c == "rank" else pa.int64() for c in _OUT]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _OUT)

        rows = []
        for row in open_windows(pairs(), n_positives, n_negatives, low, high):
            rows.append(row)
            if len(rows) == size:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    return run


def _in_blocks(anchors: DataFrame, rows: DataFrame, by: list[str], anchor_rows: int, block_rows: int):
    """Both sides with (part, share): every anchor meets every row of its ``by`` in just one block.

    A block has about ``anchor_rows`` anchors and ``block_rows`` rows, split by hashes, so a
    label or length that most rows have is spread as well.
    """
    # One row for each value of ``by``: written, so that its measured size decides about broadcasting it.
    sizes = durable(
        rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
        .join(anchors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / anchor_rows).cast("int").alias("shares")), by)
    )
    spot = F.xxhash64("vec_id", "label", "v")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(sizes, by).withColumn("share", F.pmod(spot, F.col("shares")).cast("int")).withColumn("part", upto("parts"))
    right = rows.join(sizes, by).withColumn("part", F.pmod(spot, F.col("parts")).cast("int")).withColumn("share", upto("shares"))
    return left.drop("parts", "shares"), right.drop("parts", "shares")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    anchor_rows: int = 1024,
    block_rows: int = 8192,
    partitions: int | None = None,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``vec_id``, ``label`` the label of a row. An anchor's positives are its
    ``n_positives`` highest other rows of its label; each has up to ``n_negatives`` of the highest rows of other
    labels whose score is ``low`` to ``high`` percent of its own. Ties go to the smaller id. Scores are inner
    products of floor(``scale`` * x); a score that a long cannot hold raises. Columns besides id, vector and those of
    ``label`` are not read.
    """
    spark = vectors.sparkSession
    dealt = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(labelled_vectors(vectors, label, scale, vec_id, embedding))
    asked = durable(rows.where(anchors).withColumn("variant", F.xxhash64("label", "v")))

    # The first positives of every anchor.
    by = ["dim", "label"]
    left, right = _in_blocks(asked, rows, by, anchor_rows, block_rows)
    block = ["dim", "label", "part", "share"]
    scored = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_best_positives(n_positives), _PAIRS)
    positives = durable(
        sorted_by_anchor(scored, dealt).mapInArrow(
            _first_positives(n_positives), "key binary, vec_id bigint, variant bigint, score bigint"
        )
    )
    # A negative score has an empty window.
    windowed = positives.where("score >= 0").groupBy("vec_id", "variant").agg(F.collect_set("score").alias("positives"))
    opened = asked.join(windowed, ["vec_id", "variant"])

    # What may fall into their windows.
    left, right = _in_blocks(opened, rows, ["dim"], anchor_rows, block_rows)
    block = ["dim", "part", "share"]
    scored = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_best_negatives(n_negatives, low, high), _PAIRS)

    known = positives.select("key", F.lit(True).alias("positive"), F.lit(1).cast("bigint").alias("copies"))
    both = known.union(scored.select("key", F.lit(False).alias("positive"), "copies"))
    kinds = ", ".join(f"{c} {'int' if c == 'rank' else 'bigint'}" for c in _OUT)
    found = sorted_by_anchor(both, dealt).mapInArrow(_emit(n_positives, n_negatives, low, high), kinds)
    again = asked.where("copies > 1").select(F.col("vec_id").alias("anchor_id"), "variant", "copies")
    repeated = found.join(again, ["anchor_id", "variant"], "left")
    times = F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int")))
    return repeated.withColumn("__nth", times).select(*(c for c in _OUT if c != "variant"))
