"""Near copies of texts: candidates by several SimHash fingerprints, links by shared shingles.

Each text has a few fingerprints from the same shingle hashes, mixed anew for each. They are cut into segments; every text
enumerates the ball of one bit around each of its segments and meets the texts that carry such a segment (multi-index hashing). A
pair that meets in any segment is a candidate, and the texts decide: a link needs a share of all different shingles in common. One
fingerprint alone would have to allow many differing bits to find pairs near the bound; several short
segments find them with few.

A group of copies may hold a third of all texts, so pairs are not listed within it. First every text meets only one other
per segment value, the least; those links give provisional groups. Then pairs are sought between different groups
only, where one of them is not the group of the segment value's least text.

Before texts are moved, a candidate must pass what their tallies allow: the number of different shingles in each of a fixed number of
hash classes bounds how many two texts can share, so no link is lost and nearly all chance meetings end there.

A null or empty text has no shingles, and is a copy of others without shingles. Texts of any length are read whole. Rows with one text
are one node. Other columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import key_hash, slices
from lexloom.llm.components import components
from lexloom.llm.simhash import shingle_hashes
from lexloom.session import durable

#: Bits of a segment; three of them to a fingerprint.
SEGMENT_BITS = 21
_SEGMENTS = 3
#: Candidates further apart than this in their first fingerprint are dropped unread: 32 of 64 bits differ between unrelated texts,
#: some 8 between texts that share four fifths of their shingles.
_FAR = 22


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: pa.Array, width: int, turns: int) -> np.ndarray:
    """``turns`` 64-bit SimHash fingerprints of every text, as rows; no shingle gives 0."""
    shingles, blocks = shingle_hashes(texts, width)
    sums = np.zeros((turns, len(shingles), 64), np.int32)
    for own, hashes in blocks:
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for turn in range(turns):
            mixed = _mixed(hashes, turn) if turn else hashes
            bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[turn, own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    ones = sums * 2 > shingles[None, :, None]
    return np.packbits(ones, axis=2, bitorder="little").view("<u8")[:, :, 0].T


#: Classes of a tally. Unrelated texts of n shingles differ by some 1.1 * sqrt(n * classes), linked ones by n / 4 at most.
_CLASSES = 64


def _shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    counts, blocks = shingle_hashes(texts, width)
    hashes = np.concatenate([np.empty(0, np.uint64), *(h for _, h in blocks)])
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]


def tallies(texts: pa.Array, width: int) -> np.ndarray:
    """Different ``width``-word shingles of every text in each class of their hashes, as rows."""
    found = [np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=_CLASSES) for x in _shingle_sets(texts, width)]
    return np.array(found, np.int32).reshape(-1, _CLASSES)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _marker(width: int, turns: int, similar_width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text", 2_000_000):
            prints = fingerprints(some["text"], width, turns).view(np.int64)
            rest = [c for c in some.schema.names if c != "text"]
            made = [_lists(prints), _lists(tallies(some["text"], similar_width))]
            yield pa.RecordBatch.from_arrays([*(some[c] for c in rest), *made], [*rest, "prints", "tally"])

    return run


def _segments(prints: Column, turns: int) -> list[Column]:
    low = (1 << SEGMENT_BITS) - 1
    return [
        F.shiftrightunsigned(prints[t], SEGMENT_BITS * i).bitwiseAND(F.lit(low)) for t in range(turns) for i in range(_SEGMENTS)
    ]


def _spots(nodes: DataFrame, turns: int, ball: bool) -> DataFrame:
    """(node, near, spot): a row for each segment of a text, with ``ball`` also for the values of one bit more.

    A spot is the number of the segment and its value. Of two segments one bit apart, the one without the bit
    finds the other.
    """
    found = []
    for seg, part in enumerate(_segments(F.col("prints"), turns)):
        keys = F.array(part)
        if ball:
            bits = F.array(*(F.lit(1 << b).cast("bigint") for b in range(SEGMENT_BITS)))
            keys = F.concat(keys, F.transform(F.filter(bits, _without(part)), _with(part)))
        found.append(F.transform(keys, _numbered(seg)))
    columns = [c for c in nodes.columns if c != "prints"]
    return nodes.select(*columns, F.col("prints")[0].alias("near"), F.explode(F.flatten(F.array(*found))).alias("spot"))


def _without(part: Column):
    return lambda bit: bit.bitwiseAND(part) == 0


def _with(part: Column):
    return lambda bit: bit.bitwiseOR(part)


def _numbered(seg: int):
    return lambda key: key + F.lit(seg << SEGMENT_BITS)


def _close() -> Column:
    return F.bit_count(F.col("u_near").bitwiseXOR(F.col("v_near"))) <= _FAR


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def star_pairs(nodes: DataFrame, turns: int) -> DataFrame:
    """(u, v): every text with the least text of each of its segment values."""
    spots = _spots(nodes, turns, ball=False)
    least = spots.groupBy("spot").agg(F.min(F.struct("node", "near")).alias("l"))
    met = spots.join(least, "spot").select(
        F.col("node").alias("u"), F.col("near").alias("u_near"), F.col("l.node").alias("v"), F.col("l.near").alias("v_near")
    )
    return _ordered(met.where((F.col("u") != F.col("v")) & _close()))


def cross_pairs(rooted: DataFrame, turns: int) -> DataFrame:
    """(u, v): texts of different groups (``root``) within one bit of each other in a segment."""
    held = durable(_spots(rooted, turns, ball=False))
    main = durable(held.groupBy("spot").agg(F.min_by("root", "node").alias("main")))
    # Probes of values that no text has end here, before they are moved.
    probes = _marked(_spots(rooted, turns, ball=True), "spot", main.select("spot"), _SPOT_BITS)
    asked = probes.where("__may").drop("__may").join(main, "spot")
    asked = durable(asked.toDF("spot", "u", "u_root", "u_near", "main"))
    there = held.join(main, "spot").select(
        "spot", F.col("node").alias("v"), F.col("root").alias("v_root"), F.col("near").alias("v_near"), "main"
    )
    apart = (F.col("u_root") != F.col("v_root")) & _close()
    strange = asked.where("u_root <> main").drop("main").join(there.drop("main"), "spot").where(apart)
    usual = asked.where("u_root = main").drop("main").join(there.where("v_root <> main").drop("main"), "spot").where(apart)
    return _ordered(strange.select("u", "v").union(usual.select("u", "v")))


def _shingler(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2_000_000):
            sets = [x.view(np.int64) for x in _shingle_sets(part["text"], width)]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


#: Bits of a filter that decides which texts are moved: at most 131,072 words of 64 bits.
_FILTER_BITS = 23
#: The same for the values of nine segments: at most 294,912 words.
_SPOT_BITS = 25


def _marked(rows: DataFrame, key: str, keys: DataFrame, size: int = _FILTER_BITS) -> DataFrame:
    """``rows`` with ``__may``: false if ``key`` is surely not among ``keys`` (one column of longs), by a bitmap of fixed size.

    What is surely not there stays where it is; only the rest is moved for an exact join.
    """
    def spot(name: str) -> tuple[Column, Column]:
        low = F.col(name).bitwiseAND(F.lit((1 << size) - 1))
        return F.shiftright(low, 6), low.bitwiseAND(F.lit(63)).cast("int")

    word, bit = spot(keys.columns[0])
    bits = keys.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("b")).groupBy("__word").agg(
        F.bit_or("b").alias("__bits")
    )
    word, bit = spot(key)
    # One row for each of the bitmap's words at most.
    joined = rows.withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    return joined.select(*rows.columns, (F.coalesce(F.getbit("__bits", bit), F.lit(0)) == 1).alias("__may"))


def possible_pairs(pairs: DataFrame, tallied: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` that may share enough shingles by their tallies (node, tally); drops none that do."""
    sized = tallied.select("node", F.aggregate("tally", F.lit(0), lambda total, n: total + n).alias("size"), "tally")
    met = pairs.join(sized.toDF("u", "u_size", "u_tally"), "u").join(sized.toDF("v", "v_size", "v_tally"), "v")
    shared = F.aggregate(F.zip_with("u_tally", "v_tally", lambda a, b: F.least(a, b)), F.lit(0), lambda total, n: total + n)
    both = F.col("u_size") + F.col("v_size")
    # Sizes alone settle most, so the tallies are compared for the others only.
    alike = F.least("u_size", "v_size") >= similarity * F.greatest("u_size", "v_size")
    enough = F.when(alike, shared * (1 + similarity) >= similarity * both - 1e-6).otherwise(False)
    return met.where(enough).select("u", "v")


def similar_pairs(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts (node, text) share enough of their different ``width``-word shingles.

    Only the texts that occur in a pair are cut into shingles, each once.
    """
    pairs = durable(pairs)
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    asked = durable(asked)
    near = _marked(texts, "node", asked).where("__may").drop("__may")
    # One row of each text: numbers are compared, texts follow.
    first = near.join(asked, "node", "left_semi").groupBy("node").agg(F.min("place").alias("place"))
    chosen = near.join(durable(first), ["node", "place"]).dropDuplicates(["node"]).select("node", "text")
    sets = durable(chosen.mapInArrow(_shingler(width), "node bigint, shingles array<bigint>"))
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_groups(
    docs: DataFrame,
    similarity: float = 0.8,
    similar_width: int = 5,
    width: int = 3,
    turns: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, h1, h2, node, root) of every row: ids and hashes of the row, its text, and the group of near copies.

    Texts are linked where they share ``similarity`` of their ``similar_width``-word shingles; candidates come from ``turns``
    fingerprints over ``width``-word shingles. A segment of two texts at that bound is within one bit with a chance of about
    0.28, so nine segments miss one such pair in twenty, and closer pairs hardly ever.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2 = key_hash(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.xxhash64(whole).alias("node"), whole.alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    made = f"doc_id {kind}, h1 bigint, h2 bigint, node bigint, prints array<bigint>, tally array<int>"
    marked = durable(rows.mapInArrow(_marker(width, turns, similar_width), made))
    held = durable(marked.groupBy("node").agg(F.first("prints").alias("prints"), F.first("tally").alias("tally")))
    nodes, tallied = held.select("node", "prints"), held.select("node", "tally")
    texts = rows.select("node", F.col("h1").alias("place"), "text")

    def linked(pairs: DataFrame) -> DataFrame:
        return similar_pairs(possible_pairs(pairs, tallied, similarity), texts, similar_width, similarity)

    near = durable(linked(star_pairs(nodes, turns)))
    rooted = durable(_rooted(nodes, near))
    across = linked(cross_pairs(rooted.select("node", "root", "prints"), turns))
    final = _rooted(nodes.select("node"), near.union(across))
    return marked.drop("prints", "tally").join(final, "node").select("doc_id", "h1", "h2", "node", "root")


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id.

    Takes the options of ``similar_groups``. Rows equal in id and text are one document: they stay
    or go together. If the smallest id has several texts in a group, the least hash of
    them stays; a null id stays only where there is no other. All columns pass through.
    """
    marked = durable(similar_groups(docs, **options))
    best = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("b"))
    stay = durable(best.select("b.h1", "b.h2"))
    gone = durable(marked.select("h1", "h2").distinct().join(stay, ["h1", "h2"], "left_anti"))
    h1, h2 = key_hash(F.col(options.get("doc_id", "doc_id")), F.col(options.get("text", "text")))
    keyed = docs.select(F.struct("*").alias("__doc"), h1.alias("h1"), h2.alias("h2"))
    known = _marked(keyed, "h1", gone.select("h1"))
    # Most rows stay, and stay where they are.
    doubtful = known.where("__may").join(gone, ["h1", "h2"], "left_anti")
    return known.where(~F.col("__may")).select("__doc.*").unionByName(doubtful.select("__doc.*"))
