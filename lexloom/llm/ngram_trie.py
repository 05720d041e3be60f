"""An n-gram model as an Elias-Fano trie in memory-mapped levels.

Level 1 holds words, level n holds under each context of n - 1 words the words seen after it, all as 64-bit hashes. A level is
cut into shards by a hash of the context, a context that owns a large share of the text by context and word. A shard has
its contexts and the pointers to their words in Elias-Fano form, the words of a context in ascending order, and
quantised numbers: of a word its smoothed probability, of a context the weight left for the
level below. A word is sought among its context's words only.

Smoothing is absolute discounting with interpolation: p(w|h) = (c(h w) - D) / c(h) + weight(h) p(w|shorter h), on top of
add-one word probabilities. n-grams of one occurrence leave their share to the level below. An n-gram
that occurs twice has parts that do, so level n is counted only where level n - 1 has both.
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import learns_from, put_file, shared_path, slices, word_lists
from lexloom.llm.elias_fano import EliasFano, encode, successor
from lexloom.llm.repeats import _pack, _unpack
from lexloom.session import durable

#: The closing token; no word has a space.
END = xxhash.xxh3_64_intdigest(b" end of text")
_SLICE = 9_000_000
#: Steps of a quantised binary logarithm.
_STEPS = 2048


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _quantised(share: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log2(np.maximum(share, 1e-300)) * _STEPS), 0, 65535).astype("<u2")


def _share(quantised: np.ndarray) -> np.ndarray:
    return np.exp2(quantised.astype(np.float64) / -_STEPS)


def write_shard(path: Path, arrays: dict[str, np.ndarray]) -> None:
    """Named flat arrays in one file that can be mapped."""
    head, body, at = [], [], 0
    for name, array in arrays.items():
        raw = np.ascontiguousarray(array).tobytes()
        head.append((name, array.dtype.str, len(array), at))
        pad = -len(raw) % 8
        body.append(raw + b"\0" * pad)
        at += len(raw) + pad
    top = json.dumps(head).encode()
    top += b" " * (-(len(top) + 8) % 8)
    put_file(path, struct.pack("<q", len(top)) + top + b"".join(body))


def map_shard(path: Path) -> dict[str, np.ndarray] | None:
    """The arrays of a shard, mapped; None if the shard is empty."""
    if not path.exists():
        return None
    data = np.asarray(np.memmap(path, np.uint8, "r"))
    (size,) = struct.unpack("<q", data[:8].tobytes())
    found = {}
    for name, kind, count, at in json.loads(data[8 : 8 + size].tobytes()):
        kind = np.dtype(kind)
        begin = 8 + size + at
        found[name] = data[begin : begin + count * kind.itemsize].view(kind)
    return found


def _part(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k.split(".")[1]: v for k, v in arrays.items() if k.startswith(f"{name}.")})


class _Words:
    """A shard of level 1: hashes and counts."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.counts = _part(arrays, "keys"), arrays["counts"]


class _Level:
    """A shard of a higher level."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.contexts, self.pointers = _part(arrays, "contexts"), _part(arrays, "pointers")
        self.words, self.shares = arrays["words"], arrays["shares"]
        self.counts, self.weights = arrays["counts"], arrays["weights"]


@functools.lru_cache(maxsize=4096)
def _shard(folder: str, level: int, bucket: int) -> _Words | _Level | None:
    arrays = map_shard(Path(folder) / f"level-{level}-{bucket:05d}.bin")
    return arrays and (_Words(arrays) if level == 1 else _Level(arrays))


@dataclass(frozen=True)
class NgramModel:
    """Where the levels are, and the totals: order, shards, training tokens and different words.

    Longer n-grams are held from ``least`` occurrences on. ``hot`` has for each level its large contexts: keys ascending, counts, weights.
    """

    folder: str
    shards: int
    least: int = 2
    order: int = 1
    tokens: int = 0
    words: int = 0
    hot: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...] = ()

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Training count of each word hash."""
        out = np.zeros(len(words), np.int64)
        for bucket, at in _by_bucket(words % np.uint64(self.shards), self.shards):
            shard = _shard(self.folder, 1, bucket)
            if shard:
                place = shard.keys.find(words[at])
                out[at[place >= 0]] = shard.counts[place[place >= 0]]
        return out

    def _spot(self, level: int, contexts: np.ndarray) -> np.ndarray:
        """Place of each context among the level's large ones, or -1."""
        keys = self.hot[level - 2][0] if len(self.hot) > level - 2 else np.empty(0, np.uint64)
        if not len(keys):
            return np.full(len(contexts), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, contexts), len(keys) - 1)
        return np.where(keys[at] == contexts, at, -1)

    def buckets(self, level: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The shard of each n-gram: by context, by both where the context is large."""
        spread = np.where(self._spot(level, contexts) >= 0, _mixed(contexts, words), contexts)
        return spread % np.uint64(self.shards)

    def lookup(self, level: int, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, discounted share, weight of the level below) of each n-gram; 0, 0, 1 where unknown."""
        count = np.zeros(len(words), np.int64)
        share, weight = np.zeros(len(words)), np.ones(len(words))
        for bucket, at in _by_bucket(self.buckets(level, contexts, words), self.shards):
            shard = _shard(self.folder, level, bucket)
            if not shard:
                continue
            unique, back = np.unique(contexts[at], return_inverse=True)
            known = shard.contexts.find(unique)
            seen = np.flatnonzero(known >= 0)
            low, stop = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
            low[seen] = shard.pointers.access(known[seen]).astype(np.int64)
            stop[seen] = shard.pointers.access(known[seen] + 1).astype(np.int64)
            left = np.ones(len(unique))
            left[seen] = _share(shard.weights[known[seen]])
            place = successor(shard.words, low[back], stop[back], words[at])
            hit = np.flatnonzero(place >= 0)
            count[at[hit]] = shard.counts[place[hit]]
            share[at[hit]] = _share(shard.shares[place[hit]])
            weight[at] = left[back]
        spot = self._spot(level, contexts)
        large = np.flatnonzero(spot >= 0)
        if len(large):
            weight[large] = self.hot[level - 2][2][spot[large]]
        return count, share, weight


def _by_bucket(bucket: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    # Sixteen bits are sorted by radix.
    bucket = bucket.astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(shards + 1)).tolist()
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield number, order[a:b]


class _Text:
    """Texts as numbers: each text's words after one END and before another."""

    def __init__(self, texts: pa.Array):
        words = word_lists(texts)
        self.counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        names, digest = coded.dictionary, xxhash.xxh3_64_intdigest
        raw, cuts = names.buffers()[2], np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1].tolist()
        raw = raw.to_pybytes() if raw else b""
        self.hashes = np.fromiter(
            [*(digest(raw[a:b]) for a, b in zip(cuts, cuts[1:])), END], np.uint64, len(names) + 1
        )
        stops = np.cumsum(self.counts)
        flat = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        last = len(names)
        # One END before each text and one after it.
        self.tokens = np.insert(flat, np.concatenate([stops - self.counts, stops]), last)
        ends = np.cumsum(self.counts + 2)
        self.first, self.ends = ends - self.counts - 2, ends
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts + 2)
        self.seen: np.ndarray | None = None

    def known(self, model: NgramModel) -> np.ndarray:
        """Training count of each different word."""
        if self.seen is None:
            self.seen = model.counts(self.hashes)
        return self.seen

    def grams(self, size: int) -> np.ndarray:
        """Places of the first tokens of all ``size``-grams that lie within one text."""
        at = np.arange(len(self.tokens) - size + 1)
        return at[self.owner[at] == self.owner[at + size - 1]]

    def contexts(self, size: int, at: np.ndarray) -> np.ndarray:
        """Key of the ``size`` tokens from each place."""
        key = self.hashes[self.tokens[at]]
        for i in range(1, size):
            key = _mixed(key, self.hashes[self.tokens[at + i]])
        return key


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one of each different pair, each pair's number, its count)."""
    back, unique = pd.factorize(_mixed(a, b))
    first = np.empty(len(unique), np.int64)
    # Written from the end, so that the first of each stays.
    first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
    return first, back, np.bincount(back, minlength=len(unique))


def _count(model: NgramModel, level: int):
    """Counts of the n-grams of each slice, by shard."""

    def blobs(text: _Text) -> Iterator[tuple[int, bytes]]:
        if level == 1:
            inner = np.ones(len(text.tokens), bool)
            inner[text.first] = False
            count = np.bincount(text.tokens[inner], minlength=len(text.hashes))
            used = np.flatnonzero(count)
            keys, count = text.hashes[used], count[used].astype(np.uint64)
            for bucket, at in _by_bucket(keys % np.uint64(model.shards), model.shards):
                yield bucket, _pack(keys[at], count[at].astype(np.uint32))
            return
        at = text.grams(level)
        if not len(at):
            return
        below = _kept(model, level - 1, text)
        at = at[(below[at] > 0) & (below[at + 1] > 0)]
        if not len(at):
            return
        contexts, words = text.contexts(level - 1, at), text.hashes[text.tokens[at + level - 1]]
        first, _, count = _unique_pairs(contexts, words)
        contexts, words = contexts[first], words[first]
        unique, place, back = np.unique(contexts, return_index=True, return_inverse=True)
        # A context's own count is that of the shorter n-gram in its place.
        sums = below[at[first][place]]
        for bucket, some in _by_bucket(model.buckets(level, contexts, words), model.shards):
            own, inside = np.unique(back[some], return_inverse=True)
            order = np.lexsort((words[some], inside))
            yield bucket, _pack(
                unique[own], sums[own].astype(np.uint64), np.bincount(inside, minlength=len(own)).astype(np.uint32),
                words[some][order], count[some][order].astype(np.uint32),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text", _SLICE):
            sent = list(blobs(_Text(some["text"])))
            if sent:
                places, packed = zip(*sent)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(places, pa.int32()), "sent": pa.array(packed, pa.binary())})

    return run


def _kept(model: NgramModel, size: int, text: _Text) -> np.ndarray:
    """For each place the count of the ``size``-gram from there, 0 if it is not in the model."""
    counts = np.zeros(len(text.tokens) + 1, np.int64)
    if size == 1:
        seen = text.known(model)
        counts[:-1] = np.where(seen >= model.least, seen, 0)[text.tokens]
        return counts
    below, at = _kept(model, size - 1, text), text.grams(size)
    at = at[(below[at] > 0) & (below[at + 1] > 0)]
    if len(at):
        contexts, words = text.contexts(size - 1, at), text.hashes[text.tokens[at + size - 1]]
        first, back, _ = _unique_pairs(contexts, words)
        count, _, _ = model.lookup(size, contexts[first], words[first])
        counts[at] = count[back]
    return counts


_BUILT = "bucket int, entries bigint, total bigint, context bigint"


def _left(total: np.ndarray, words: np.ndarray, count: np.ndarray, discount: float) -> np.ndarray:
    """What a context of ``count`` occurrences leaves to the level below, with ``words`` kept words of ``total`` occurrences."""
    return np.maximum(1 - (total - discount * words) / count, 1e-9)


def _build(model: NgramModel, level: int, discount: float):
    """Merges the counts of one shard and writes it; says how much large contexts have kept."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [_unpack(blob.as_py()) for blob in rows["sent"]]
        path = Path(model.folder) / f"level-{level}-{bucket:05d}.bin"
        columns = [np.concatenate(c) for c in zip(*parts)]
        said = {"bucket": [bucket], "entries": [0], "total": [0], "context": [None]}
        if level == 1:
            keys, back = np.unique(columns[0], return_inverse=True)
            counts = np.bincount(back, columns[1].astype(np.float64)).astype(np.uint64)
            write_shard(path, {**{f"keys.{k}": v for k, v in encode(keys).items()}, "counts": counts})
            said["entries"], said["total"] = [len(keys)], [int(counts.sum())]
        else:
            contexts = np.repeat(columns[0], columns[2])
            sums = np.repeat(columns[1], columns[2])
            order = np.lexsort((columns[3], contexts))
            contexts, sums, words, counts = contexts[order], sums[order], columns[3][order], columns[4][order].astype(np.int64)
            new = np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])])
            starts = np.flatnonzero(new)
            counts = np.add.reduceat(counts, starts)
            keep = counts >= model.least
            contexts, sums, words, counts = contexts[starts][keep], sums[starts][keep], words[starts][keep], counts[keep]
            if len(contexts):
                own, begin = np.unique(contexts, return_index=True)
                shares = (counts - discount) / sums
                words_of, total_of = np.diff(np.append(begin, len(contexts))), np.add.reduceat(counts, begin)
                write_shard(
                    path,
                    {
                        **{f"contexts.{k}": v for k, v in encode(own).items()},
                        **{f"pointers.{k}": v for k, v in encode(np.append(begin, len(contexts))).items()},
                        "words": words.astype("<u8"),
                        "counts": counts.astype("<u4"),
                        "shares": _quantised(shares),
                        "weights": _quantised(_left(total_of, words_of, sums[begin], discount)),
                    },
                )
                said["entries"], said["total"] = [len(contexts)], [int(counts.sum())]
                large = np.flatnonzero(model._spot(level, own) >= 0)
                said["bucket"] += [bucket] * len(large)
                said["entries"] += words_of[large].tolist()
                said["total"] += total_of[large].tolist()
                said["context"] += own[large].view(np.int64).tolist()
        return pa.table(
            {
                "bucket": pa.array(said["bucket"], pa.int32()),
                "entries": pa.array(said["entries"], pa.int64()),
                "total": pa.array(said["total"], pa.int64()),
                "context": pa.array(said["context"], pa.int64()),
            }
        )

    return run


def _large(model: NgramModel, level: int, bar: int):
    """Entries of each shard of ``level`` with a count of ``bar`` or more, as contexts of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in batch["bucket"].to_pylist():
                shard = _shard(model.folder, level, bucket)
                if not shard:
                    continue
                at = np.flatnonzero(shard.counts >= bar)
                if level == 1:
                    keys = shard.keys.access(at)
                else:
                    begin = shard.pointers.access(np.arange(shard.pointers.n)).astype(np.int64)
                    keys = _mixed(shard.contexts.access(np.searchsorted(begin, at, "right") - 1), shard.words[at])
                yield pa.RecordBatch.from_pydict(
                    {"context": pa.array(keys.view(np.int64)), "n": pa.array(shard.counts[at].astype(np.int64))}
                )

    return run


def _hot(spark, model: NgramModel, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, weights yet unknown) of the contexts of ``level`` that own more than a quarter of an even shard.

    There are fewer than four per shard, since their counts add up to the tokens.
    """
    bar = max(1000, model.tokens // (4 * model.shards))
    buckets = spark.range(model.shards).select(F.col("id").cast("int").alias("bucket"))
    found = buckets.mapInArrow(_large(model, level - 1, bar), "context bigint, n bigint").toPandas()
    keys = found.context.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.n.to_numpy(np.int64)[order], np.ones(len(keys))


def train_model(
    docs: DataFrame, order: int = 3, least: int = 2, discount: float = 0.75, text: str = "text", shard_bytes: int = 16_000_000
) -> NgramModel:
    """Count and write the levels over all of ``docs``, a level a pass.

    There is a shard for every ``shard_bytes`` of text, so that a shard stays as large as it is, whatever the collection. A context
    is large if it owns more than a quarter of an even shard; its words are spread over all shards.
    Scores do not depend on the number of shards. A null or empty text is an END. Without rows the model knows nothing.
    """
    spark = docs.sparkSession
    _, folder = shared_path(spark, "ngram-levels")
    rows = docs.select(F.col(text).cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = NgramModel(folder, max(1, -(-held // shard_bytes)), least)
    for level in range(1, order + 1):
        counted = rows.mapInArrow(_count(model, level), "bucket int, sent binary")
        built = durable(counted.groupBy("bucket").applyInArrow(_build(model, level, discount), _BUILT))
        if level == 1:
            totals = built.agg(F.sum("entries").alias("entries"), F.sum("total").alias("total")).first()
            model = replace(model, tokens=totals.total or 0, words=totals.entries or 0, order=1)
        else:
            keys, counts, _ = model.hot[level - 2]
            # Large contexts have their words in many shards: whole numbers are added up.
            parts = built.where("context is not null").groupBy("context").agg(F.sum("entries").alias("words"), F.sum("total").alias("total"))
            of = {r.context: (r.total, r.words) for r in parts.collect()}
            total, words = np.array([of.get(k, (0, 0)) for k in keys.view(np.int64).tolist()], np.int64).reshape(-1, 2).T
            weights = _share(_quantised(_left(total, words, counts, discount)))
            model = replace(model, order=level, hot=(*model.hot[: level - 2], (keys, counts, weights)))
        if level < order:
            model = replace(model, hot=(*model.hot, _hot(spark, model, level + 1)))
    return model


def _scorer(model: NgramModel, names: list[str], kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text", _SLICE):
            text = _Text(some["text"])
            known = text.known(model)
            share = (known + 1.0) / (model.tokens + model.words + 1.0)
            scored = np.ones(len(text.tokens), bool)
            scored[text.first] = False
            base = np.where(scored, np.log10(share)[text.tokens], 0.0)
            full = share[text.tokens]
            # A context that the level below lacks is none here.
            inner = _kept(model, 1, text) > 0
            for level in range(2, model.order + 1):
                at = text.grams(level)
                at = at[inner[at]]
                if not len(at):
                    break
                contexts, words = text.contexts(level - 1, at), text.hashes[text.tokens[at + level - 1]]
                first, back, _ = _unique_pairs(contexts, words)
                count, shares, weights = model.lookup(level, contexts[first], words[first])
                place = at + level - 1
                full[place] = shares[back] + weights[back] * full[place]
                inner = np.zeros(len(text.tokens) + 1, bool)
                inner[at] = (count > 0)[back]
            log = np.where(scored, np.log10(full), 0.0)
            sums = {
                "n_tokens": text.counts + 1,
                "n_known": np.add.reduceat((scored & (known > 0)[text.tokens]).astype(np.int64), text.first),
                "train_tokens": np.full(len(text.counts), model.tokens, np.int64),
                "base_score": np.add.reduceat(base, text.first),
                "score": np.add.reduceat(log, text.first),
            }
            yield pa.RecordBatch.from_arrays([*(some[c] for c in kept), *(pa.array(sums[n]) for n in names)], [*kept, *names])

    return run


def score_texts(docs: DataFrame, model: NgramModel, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens (long), base_score and score (log10).

    The tokens of a text are its words, A-Z lower-cased, and an END. ``base_score`` is by add-one word
    probabilities alone. Null and empty texts are one END. Columns of the same names are replaced.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in {text, *names}]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    fields += [f"{n} {'double' if n.endswith('score') else 'bigint'}" for n in names]
    rows = docs.select(*kept, F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model, names, kept), ", ".join(fields))


def score_held_out(docs: DataFrame, modulus: int = 7, left_out: int = 2, **training) -> DataFrame:
    """Score all of ``docs`` by a model of those whose id's crc32 modulo ``modulus`` is not ``left_out``."""
    learns = learns_from(F.col("doc_id"), modulus, left_out)
    model = train_model(docs.where(learns), **training)
    return score_texts(docs.withColumn("held_out", ~learns), model)
