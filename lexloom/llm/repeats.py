"""Byte strings that repeat across documents, by prefix doubling over hashed ranks.

The rank of a position at some length stands for the bytes that follow it; here it is a hash of them. Spark
shuffles the ranks to buckets by value, each bucket sorts its share, and positions whose rank is unique to
a document drop out, so only the rest is ranked at the next, greater offset:

1. Every string of the threshold's length contains the least-hashed half-length gram of its own, so the
   first round ranks those grams only, about one position in thirteen.
2. The strings that share one such gram form a run of positions. The bytes of a whole run are ranked; a run
   that a smaller document has as well is settled, and so is one whose gram never stands in another run.
3. Each position of the other runs is ranked by the pair of the ranks at its half lengths, which
   reaches the threshold; the least document of each rank decides.

Documents are held in slices of a few megabytes, one row each, and every slice sends each rank once,
so a passage that a third of all documents share weighs no more than one row per slice.
"""

from __future__ import annotations

import functools
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import scratch, slices
from lexloom.session import durable

_SLICE = 3_000_000
_STEP = 0x9E3779B97F4A7C15 | 1
_LAST = (1 << 63) - 1


@functools.lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and the powers of an odd number and of its inverse."""
    rng = np.random.default_rng(20240229)
    values = rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
    back = pow(_STEP, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full((2, size + 1), 1, np.uint64)
        up[1:], down[1:] = np.uint64(_STEP), np.uint64(back)
        return values, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Bytes:
    """Ranks of substrings of some bytes in constant time: a difference of running sums."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        self.size = len(data)
        room = 1 << max(22, int(self.size).bit_length())
        values, self.up, self.down = _tables(room)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values[kind][data] * self.up[: self.size], dtype=np.uint64)])

    def rank(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(1))


def _runs(data: np.ndarray, sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position, place of the gram from there) of each run of positions that share their least gram."""
    half = (threshold + 1) // 2
    width = threshold - half + 1
    if len(data) < threshold:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    grams = _Bytes(data).rank(np.arange(len(data) - half + 1), half)
    # The place rides in the low bits, so that ties go to the leftmost.
    least = (grams & ~np.uint64(0xFFFFFFFF)) >> np.uint64(1)
    least = least | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64(0x7FFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    # A position counts if its string ends within its document.
    inside = np.zeros(len(data) + 1, np.int32)
    long = sizes >= threshold
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - threshold + 1)[long], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1])[: len(place)] > 0)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    gram = place[at]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (at[1:] != at[:-1] + 1)])
    return at[new], (gram[new] - at[new]).astype(np.uint8)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; integers byte by byte, which compresses better."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1) if len(a) else np.empty((0, a.itemsize), np.uint8)
        parts.append(struct.pack("<qc", len(a), a.dtype.char.encode()) + np.ascontiguousarray(raw.T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(struct.pack("<q", len(p)) + p for p in parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, arrays, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        (size,) = struct.unpack_from("<q", raw, at)
        count, char = struct.unpack_from("<qc", raw, at + 8)
        kind = np.dtype(char.decode())
        body = np.frombuffer(raw, np.uint8, size - 9, at + 17).reshape(kind.itemsize, count)
        arrays.append(np.ascontiguousarray(body.T).view(kind).ravel())
        at += 8 + size
    return arrays


def _slicer(threshold: int):
    """Rows of one slice each: its documents' order numbers, sizes, bytes and runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for some in slices(batches, "text", _SLICE):
            texts = some["text"].take(pa.array(range(len(some)), pa.int64())).cast(pa.large_binary())
            texts = pc.fill_null(texts, b"")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1))
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8, int(sizes.sum()))
            begin, gram = _runs(data, sizes, threshold)
            marks = np.zeros(len(data), bool)
            marks[begin] = True
            ids = some["doc_id"]
            order = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            head = _pack(order, sizes, np.packbits(marks), gram)
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array([number], pa.int64()), "head": pa.array([head]), "body": pa.array([data.tobytes()], pa.large_binary()).cast(pa.binary())}
            )
            number += 1

    return run


class _Slice:
    """A slice read back: order numbers, sizes, bytes, and its runs."""

    def __init__(self, head: bytes, body: bytes, threshold: int):
        self.order, self.sizes, marks, gram = _unpack(head)
        self.data, self.threshold = np.frombuffer(body, np.uint8), threshold
        self.begin = np.flatnonzero(np.unpackbits(marks, count=len(self.data)))
        self.gram_at = self.begin + gram
        ends = np.cumsum(self.sizes)
        self.owner = np.searchsorted(ends, self.begin, side="right")
        last = ends[self.owner] - threshold + 1
        following = np.append(self.begin[1:], np.iinfo(np.int64).max)
        self.count = np.minimum(following, last) - self.begin
        self.ranks = _Bytes(self.data)
        self.grams = self.ranks.rank(self.gram_at, (threshold + 1) // 2)

    def runs(self, keep: np.ndarray) -> np.ndarray:
        """Ranks of the bytes of whole runs, their place of the gram and length mixed in."""
        with np.errstate(over="ignore"):
            shape = (self.gram_at[keep] - self.begin[keep]) * 1000 + self.count[keep]
            return _mixed(self.ranks.rank(self.begin[keep], self.count[keep] + self.threshold - 1) + shape.astype(np.uint64))

    def positions(self, keep: np.ndarray) -> np.ndarray:
        """All positions of the runs ``keep``."""
        n = self.count[keep]
        return np.repeat(self.begin[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Ranks at the threshold's length: of the pair of ranks at ``at`` and half a threshold on."""
        half = (self.threshold + 1) // 2
        with np.errstate(over="ignore"):
            second = self.ranks.rank(at + self.threshold - half, half)
            return _mixed(self.ranks.rank(at, half) * np.uint64(0xA24BAED4963EE407) + second)


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[slice]]:
    """Order of ``keys`` by bucket (ascending within), and the part of each bucket."""
    bucket = (keys % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    return order, [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _firsts(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys ascending, the least and greatest order number of each, and each key's place."""
    unique, place = np.unique(keys, return_inverse=True)
    least = np.full(len(unique), np.iinfo(np.int64).max)
    most = np.full(len(unique), np.iinfo(np.int64).min)
    np.minimum.at(least, place, order)
    np.maximum.at(most, place, order)
    return unique, least, most, place


class _Rounds:
    """What a slice sends in each round, and how its answers are read.

    An answer is a row of bits in the order sent. Rounds: 0 grams, 1 runs of a gram,
    2 whole runs, 3 positions. ``answers`` maps a round to bits per bucket.
    """

    def __init__(self, part: _Slice, buckets: int, answers: dict[int, dict[int, np.ndarray]]):
        self.part, self.buckets, self.answers = part, buckets, answers
        self.unique: dict[int, np.ndarray] = {}

    def _read(self, number: int, unique: np.ndarray) -> np.ndarray:
        order, cuts = _split(unique, self.buckets)
        bits = np.zeros(len(unique), bool)
        for bucket, cut in enumerate(cuts):
            if cut.stop > cut.start:
                bits[order[cut]] = np.unpackbits(self.answers[number][bucket], count=cut.stop - cut.start).astype(bool)
        return bits

    def _send(self, number: int, unique: np.ndarray, columns: Callable[[np.ndarray], list[np.ndarray]]):
        order, cuts = _split(unique, self.buckets)
        for bucket, cut in enumerate(cuts):
            if cut.stop > cut.start:
                yield number, bucket, _pack(*columns(order[cut]))

    def grams(self):
        """Round 0: each gram, and whether two documents of the slice have it."""
        unique, least, most, self.gram = _firsts(self.part.grams, self.part.order[self.part.owner])
        self.unique[0] = unique
        if 0 in self.answers:
            self.keep = np.flatnonzero(self._read(0, unique)[self.gram])
            return
        high = (unique >> np.uint64(24)).astype(np.uint64)
        yield from self._send(0, unique, lambda o: [(high[o] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (high[o] >> np.uint64(32)).astype(np.uint8), least[o] < most[o]])

    def runs(self):
        """Rounds 1 and 2: for each gram one run and whether there are more; each run and its first document."""
        part, keep = self.part, self.keep
        ranks, grams = part.runs(keep), part.grams[keep]
        order = part.order[part.owner[keep]]
        unique, first, last, self.of_gram = _firsts(grams, ranks.view(np.int64))
        runs, least, _, self.of_run = _firsts(ranks, order)
        self.later = order > least[self.of_run]
        if 1 in self.answers:
            several = self._read(1, unique)[self.of_gram]
            self.settled = self.later | self._read(2, runs)[self.of_run]
            # One run of each rank still in question: the first of its first document.
            asks = np.flatnonzero(several & ~self.settled)
            self.asks = asks[np.unique(self.of_run[asks], return_index=True)[1]]
            return
        yield from self._send(1, unique, lambda o: [unique[o], first[o], first[o] != last[o]])
        yield from self._send(2, runs, lambda o: [runs[o], least[o]])

    def positions(self):
        """Round 3: positions of the runs in question, and the first document of each."""
        part = self.part
        self.asked = np.flatnonzero(np.isin(self.of_run, self.of_run[self.asks]) & ~self.settled)
        at = part.positions(self.keep[self.asked])
        order = np.repeat(part.order[part.owner[self.keep[self.asked]]], part.count[self.keep[self.asked]])
        unique, least, _, place = _firsts(part.pairs(at), order)
        if 3 in self.answers:
            again = self._read(3, unique)[place] | (order > least[place])
            self.repeated = np.concatenate([part.positions(self.keep[self.settled]), at[again]])
            return
        yield from self._send(3, unique, lambda o: [unique[o], least[o]])


def _answers(rows: list[dict] | None) -> dict[int, dict[int, np.ndarray]]:
    found: dict[int, dict[int, np.ndarray]] = {}
    for row in rows or []:
        found.setdefault(row["round"], {})[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return found


def _known(part: _Slice, buckets: int, answers: dict, rounds: set[int]) -> dict:
    """Answers with an empty entry for rounds in which this slice sent nothing."""
    return {number: answers.get(number, {}) for number in rounds}


def _sender(threshold: int, buckets: int, rounds: set[int]):
    """What each slice sends next, given the answers to ``rounds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = _Slice(batch["head"][i].as_py(), batch["body"][i].as_py(), threshold)
                given = _answers(batch["answers"][i].as_py()) if "answers" in batch.schema.names else {}
                state = _Rounds(part, buckets, _known(part, buckets, given, rounds))
                sent = list(state.grams())
                if 0 in rounds:
                    sent = list(state.runs())
                if 1 in rounds:
                    sent = list(state.positions())
                if sent:
                    numbers, places, blobs = zip(*sent)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "slice": pa.array([batch["slice"][i].as_py()] * len(sent), pa.int64()),
                            "round": pa.array(numbers, pa.int32()),
                            "bucket": pa.array(places, pa.int32()),
                            "sent": pa.array(blobs, pa.binary()),
                        }
                    )

    return run


def _sorter(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sorts one bucket of a round and answers every slice."""
    number = key[0].as_py()
    parts = [_unpack(blob.as_py()) for blob in rows["sent"]]
    sizes = [len(p[0]) for p in parts]
    columns = [np.concatenate(c) for c in zip(*parts)]
    if number == 0:
        ranks = columns[0].astype(np.uint64) | columns[1].astype(np.uint64) << np.uint64(32)
        _, place, count = np.unique(ranks, return_inverse=True, return_counts=True)
        several = np.zeros(len(count), bool)
        np.logical_or.at(several, place, columns[2])
        bits = (several | (count > 1))[place]
    elif number == 1:
        _, least, most, place = _firsts(columns[0], columns[1])
        several = least != most
        np.logical_or.at(several, place, columns[2])
        bits = several[place]
    else:
        _, least, _, place = _firsts(columns[0], columns[1])
        bits = columns[1] > least[place]
    cuts = np.cumsum([0, *sizes]).tolist()
    answers = [np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.table(
        {
            "slice": rows["slice"],
            "round": pa.array([number] * len(rows), pa.int32()),
            "bucket": rows["bucket"],
            "bits": pa.array(answers, pa.binary()),
        }
    )


def _remover(threshold: int, buckets: int, fields: list[str]):
    """The documents of each slice without their repeated bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = _Slice(batch["head"][i].as_py(), batch["body"][i].as_py(), threshold)
                given = _known(part, buckets, _answers(batch["answers"][i].as_py()), {0, 1, 2, 3})
                state = _Rounds(part, buckets, given)
                for step in (state.grams, state.runs, state.positions):
                    list(step())
                edge = np.zeros(len(part.data) + 1, np.int32)
                np.add.at(edge, state.repeated, 1)
                np.add.at(edge, state.repeated + threshold, -1)
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.cumsum(part.sizes)
                starts = ends - part.sizes
                upto = np.concatenate([[0], np.cumsum(gone)])
                # A removed run begins where the byte before stays or another document ends.
                fresh = gone & ~np.concatenate([[False], gone[:-1]])
                nonempty = starts[part.sizes > 0]
                fresh[nonempty] |= gone[nonempty]
                spans = np.concatenate([[0], np.cumsum(fresh)])
                kept = [part.data[a:b][~gone[a:b]].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.order, pa.int64(), mask=part.order == _LAST),
                        pa.array(part.sizes, pa.int64()),
                        pa.array(upto[ends] - upto[starts]),
                        pa.array(spans[ends] - spans[starts]),
                        pa.array(kept, pa.binary()),
                    ],
                    fields,
                )

    return run


def remove_repeats(
    docs: DataFrame, threshold: int = 50, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document.

    A byte goes if a string of ``threshold`` bytes that covers it also starts in a document with a smaller id; ``kept`` holds
    the other bytes, joined. Judged on the texts as given. Null and empty texts have no bytes. A null id
    counts as greater than all ids. Rows with one id do not count as smaller than each
    other, so nothing goes on their account. Shorter texts stay whole. An empty table gives an empty result.

    Ranks are 64-bit hashes, so strings are told apart but for a chance of the number of
    compared strings squared over 2**65.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # One row per slice, in files by slice number, so that answers meet their slices without moving these.
    name = f"repeats_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(_slicer(threshold), "slice bigint, head binary, body binary")
        .write.bucketBy(buckets, "slice")
        .option("compression", "zstd")
        .option("path", scratch(spark, "repeats"))
        .saveAsTable(name)
    )
    held = spark.table(name)
    answers = None
    for rounds in (set(), {0}, {0, 1, 2}):
        source = held if answers is None else held.join(_by_slice(answers), "slice", "left")
        sent = source.mapInArrow(
            _sender(threshold, buckets, rounds), "slice bigint, round int, bucket int, sent binary"
        )
        answered = durable(
            sent.groupBy("round", "bucket").applyInArrow(_sorter, "slice bigint, round int, bucket int, bits binary")
        )
        answers = answered if answers is None else answers.union(answered)
    fields = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    return held.join(_by_slice(answers), "slice", "left").mapInArrow(
        _remover(threshold, buckets, fields), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def _by_slice(answers: DataFrame) -> DataFrame:
    return answers.groupBy("slice").agg(F.collect_list(F.struct("round", "bucket", "bits")).alias("answers"))
