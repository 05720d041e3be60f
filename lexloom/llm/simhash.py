"""Near copies by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at most ``distance`` bits apart
differ in at most ``distance // segments`` bits of some segment, so each
fingerprint enumerates that Hamming ball around each of its segments, fetches the
fingerprints of the table that carry such a segment, and the whole distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import key_hash, slices, word_lists
from lexloom.llm.components import components
from lexloom.session import durable

_BLOCK = 100_000
SEED = 42


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Shingles per text, and blocks of (text number, XXH64 with seed 42) in text order.

    Words are cut at ASCII white space with A-Z lower-cased and joined by one space; a
    text of fewer than ``width`` words is one shingle, a text without words has none.
    """
    words = word_lists(texts)
    counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
    flat = words.flatten()
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = " ".join(flat.to_pylist()).encode()
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    ends = starts + lengths
    first = np.cumsum(counts) - counts
    shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), shingles)
    head = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    tail = head + np.minimum(width, counts[owner]) - 1

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        digest = xxhash.xxh64_intdigest
        for at in range(0, len(owner), _BLOCK):
            here = slice(at, at + _BLOCK)
            a, b = starts[head[here]].tolist(), ends[tail[here]].tolist()
            yield owner[here], np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))

    return shingles, blocks()


def fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    """64-bit SimHash of every text over its ``width``-word shingles, repeats included.

    A bit is set if over half the shingles' hashes have it set; no shingle gives 0.
    """
    shingles, blocks = shingle_hashes(texts, width)
    sums = np.zeros((len(shingles), 64), np.int64)
    for own, hashes in blocks:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    ones = sums * 2 > shingles[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprinter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2_000_000):
            values = pa.array(fingerprints(part["text"], width).view(np.int64), pa.int64())
            rest = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), values], [*rest, "fp"])

    return run


def with_fingerprint(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h1, h2, fp) of every row: id, hashes of id and text, fingerprint as a signed long."""
    h1, h2 = key_hash(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(_fingerprinter(width), f"doc_id {kind}, h1 bigint, h2 bigint, fp bigint")


def links(table: DataFrame, distance: int, segments: int | None = None) -> DataFrame:
    """(u, v), u < v: the pairs of different fingerprints (column ``fp``, distinct) that link."""
    segments = segments or max(1, (distance + 2) // 2)
    radius = distance // segments
    edges = [64 * i // segments for i in range(segments + 1)]
    kept, probed = [], []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        size = high - low
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))
        kept.append(F.struct(F.lit(i).alias("seg"), part.alias("key")))
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(size), r)]
        ball = F.array(*(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("bigint") for m in masks))
        if radius == 1:
            # Of two segments one bit apart, the one without the bit finds the other.
            ball = F.filter(ball, lambda m: m.bitwiseAND(part) == 0)
        probed.append(F.transform(ball, lambda m: F.struct(F.lit(i).alias("seg"), part.bitwiseXOR(m).alias("key"))))
    held = table.select(F.col("fp").alias("v"), F.explode(F.array(*kept)).alias("s")).select("v", "s.seg", "s.key")
    asked = table.select(F.col("fp").alias("u"), F.explode(F.flatten(F.array(*probed))).alias("s")).select("u", "s.seg", "s.key")
    near = asked.join(
        held,
        (asked.seg == held.seg) & (asked.key == held.key) & (F.col("u") != F.col("v"))
        & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance),
    )
    return near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_copies(
    docs: DataFrame,
    width: int = 3,
    distance: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, h1, h2, fp, component_id) for every row of ``docs``.

    Fingerprints over ``width``-word shingles link at ``distance`` differing bits or fewer;
    ``component_id`` is the smallest id that links reach, the row's own included. Copies
    have one fingerprint, so pairs are sought between different fingerprints only. Null
    and empty texts have fingerprint 0 and link like any other. Links by the texts themselves: ``near_texts``. Null ids are no
    component ids unless nothing else is reached. An empty table gives an empty result.
    """
    marked = durable(with_fingerprint(docs, width, doc_id, text))
    table = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    pairs = links(table.select("fp"), distance)
    roots = components(pairs)
    rooted = table.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id.

    Takes the options of ``near_copies``. Rows equal in id and text are one document: they stay
    or go together. If the smallest id has several texts in a group, the least hash of
    them stays; a null id stays only where there is no other. All columns pass through.
    """
    marked = near_copies(docs, **options)
    best = marked.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("b")
    )
    stay = best.select("b.h1", "b.h2")
    h1, h2 = key_hash(F.col(options.get("doc_id", "doc_id")), F.col(options.get("text", "text")))
    keyed = docs.select(F.struct("*").alias("__doc"), h1.alias("h1"), h2.alias("h2"))
    return keyed.join(stay, ["h1", "h2"], "left_semi").select("__doc.*")
