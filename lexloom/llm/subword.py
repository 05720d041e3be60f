"""Toxicity by subword bags: averaged character n-gram vectors into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into a fixed table of vectors, so words never
seen share vectors with those they resemble. A passage of some words is the average of
its words' vectors, and a linear softmax reads it; vectors and softmax are trained together
in numpy. A document is as toxic as its worst passage: training starts from all passages
of the labelled documents and then goes on with the worst passages of the toxic ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import give_back, learns_from, slices, word_lists
from lexloom.operators.ordering import top_per_group

#: A labelled text over one part in this many of the sample's characters is learnt from after all shorter ones.
LONG_PARTS = 50

_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str], bits: int, shortest: int = 3, longest: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' n-grams, ends per word); a word is marked at both ends."""
    some = [_subwords(words[i : i + 40_000], bits, shortest, longest) for i in range(0, len(words), 40_000)]
    buckets = np.concatenate([np.empty(0, np.int32), *(b for b, _ in some)])
    return buckets, np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for _, n in some)]))


def _subwords(words: list[str], bits: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    text = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    room = ends[owner] - np.arange(len(points))
    place = np.arange(len(points)) - (ends - sizes)[owner] + 1
    found, owners = [], [np.arange(len(words), dtype=np.int32)]
    with np.errstate(over="ignore"):
        # The whole word: a sum of its characters, each weighed by its place.
        turn = place.astype(np.uint64)
        found.append(np.add.reduceat((points + np.uint64(7)) * (turn * _MIX ^ (turn << np.uint64(40))), ends - sizes))
        rolling = np.zeros(len(points), np.uint64)
        for n in range(1, min(longest, len(points)) + 1):
            rolling[: len(points) - n + 1] = rolling[: len(points) - n + 1] * _MIX + points[n - 1 :]
            if n >= shortest:
                keep = np.flatnonzero(room >= n)
                found.append(rolling[keep] + np.uint64(n))
                owners.append(owner[keep])
        mixed = np.concatenate(found)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    of = np.concatenate(owners)
    buckets = (mixed >> np.uint64(64 - bits)).astype(np.int32)[np.argsort(of, kind="stable")]
    return buckets, np.bincount(of, minlength=len(words))


def passages(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each passage, its document): ``width`` words each, cut evenly per document."""
    pieces = -(-counts // width)
    owner = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.cumsum(counts) - counts
    return first[owner] + nth * counts[owner] // np.maximum(pieces[owner], 1), owner


def _segment_sum(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts, none of them empty."""
    return np.add.reduceat(values, np.concatenate([[0], ends[:-1]]), axis=0)


@dataclass(frozen=True)
class SubwordModel:
    """Score per bucket (vectors times the softmax's weights), bias, passage width, table bits."""

    buckets: np.ndarray
    bias: float
    width: int
    bits: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text: that of its worst passage; no words: the bias alone."""
        words = word_lists(texts)
        counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
        worst = np.full(len(counts), -np.inf)
        if counts.sum():
            coded = words.flatten().dictionary_encode()
            grams, ends = subwords(coded.dictionary.to_pylist(), self.bits)
            sizes = np.diff(np.concatenate([[0], ends]))
            each = _segment_sum(self.buckets[grams], ends) / sizes
            first, owner = passages(counts, self.width)
            stops = np.append(first[1:], counts.sum())
            used = each[coded.indices.to_numpy(zero_copy_only=False)]
            np.maximum.at(worst, owner, _segment_sum(used, stops) / (stops - first))
        worst[counts == 0] = 0.0
        return 1.0 / (1.0 + np.exp(-np.clip(worst + self.bias, -40, 40)))


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _log_odds(
    cuts: np.ndarray, tokens: np.ndarray, grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
    labels: np.ndarray, bits: int, prior: float,
) -> np.ndarray:
    """Log odds of label 1 per bucket against all documents, drawn to 0 by ``prior`` documents."""
    having = np.zeros((2, 1 << bits))
    for document, label in enumerate(labels.tolist()):
        here = np.unique(tokens[cuts[document] : cuts[document + 1]])
        having[label][np.unique(grams[_spans(starts[here], sizes[here])])] += 1
    share = labels.mean()
    return np.log((having[1] + prior * share) / (having[0] + prior * (1 - share)) * (1 - share) / share)


def _fit_line(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and bias of a logistic fit of ``labels`` to ``margin``, by damped Newton steps."""
    spread = margin.std() + 1e-9
    x = np.stack([margin / spread, np.ones(len(margin))], axis=1)
    fit = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        slope = x.T @ (labels - p) - 0.02 * fit
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        fit += move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
    return max(float(fit[0]), 0.0) / spread, float(fit[1])


def train(
    texts: pa.Array,
    labels: np.ndarray,
    width: int = 4,
    bits: int = 17,
    size: int = 4,
    rounds: int = 2,
    rate: float = 2.0,
    batch: int = 4096,
    prior: float = 15.0,
    seed: int = 7,
) -> SubwordModel:
    """Fit vectors and softmax together by gradient steps over passages.

    The first coordinate starts from each bucket's log odds over documents, so that the worst
    passages of the first round are sensible; the others start at random. Rounds take all passages of
    documents with label 0 and the worst one of the others. At the end the softmax is
    fitted once more to whole documents, to the worst passage of each. Without both labels the model says the
    share of label 1 everywhere.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    words = word_lists(texts)
    counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
    if len(set(labels[counts > 0].tolist())) < 2:
        return SubwordModel(np.zeros(1 << bits), float(np.log(share / (1 - share))), width, bits)
    coded = words.flatten().dictionary_encode()
    tokens = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    grams, ends = subwords(coded.dictionary.to_pylist(), bits)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    first, owner = passages(counts, width)
    lengths = np.append(first[1:], len(tokens)) - first

    cuts = np.concatenate([[0], np.cumsum(counts)])
    odds = _log_odds(cuts, tokens, grams, starts, sizes, labels, bits, prior)
    vectors = rng.normal(0, 0.05, (1 << bits, size))
    vectors[:, 0] = odds
    weights = np.zeros((size, 2))
    weights[0] = -4.0, 4.0
    bias = np.log([1 - share, share])

    def step(chosen: np.ndarray) -> None:
        nonlocal weights, bias
        size_of = lengths[chosen]
        here, back = np.unique(tokens[_spans(first[chosen], size_of)], return_inverse=True)
        bags, bag_sizes = grams[_spans(starts[here], sizes[here])], sizes[here]
        word = _segment_sum(vectors[bags], np.cumsum(bag_sizes)) / bag_sizes[:, None]
        passage = _segment_sum(word[back], np.cumsum(size_of)) / size_of[:, None]
        z = passage @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(chosen)), labels[owner[chosen]]] -= 1
        spread = np.repeat((p @ weights.T) / size_of[:, None], size_of, axis=0)
        to_word = np.stack([np.bincount(back, spread[:, k], len(here)) for k in range(size)], axis=1)
        to_gram = np.repeat(to_word / bag_sizes[:, None], bag_sizes, axis=0)
        used, at = np.unique(bags, return_inverse=True)
        to_v = np.stack([np.bincount(at, to_gram[:, k], len(used)) for k in range(size)], axis=1)
        vectors[used] -= rate * np.clip(to_v, -0.5, 0.5)
        weights -= 0.01 * rate * np.clip(passage.T @ p / len(chosen), -1, 1)
        bias -= 0.01 * rate * p.sum(axis=0) / len(chosen)

    def worst() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = vectors @ (weights[:, 1] - weights[:, 0])
        each = _segment_sum(flat[grams], ends) / sizes
        margin = _segment_sum(each[tokens], np.cumsum(lengths)) / lengths
        best = np.full(len(counts), -np.inf)
        np.maximum.at(best, owner, margin)
        return flat, margin, best

    for _ in range(rounds):
        _, margin, best = worst()
        chosen = np.flatnonzero((labels[owner] == 0) | (margin >= best[owner] - 1e-9))
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), batch):
            step(chosen[order[at : at + batch]])
    flat, _, best = worst()
    best[counts == 0] = 0.0
    scale, moved = _fit_line(best, labels)
    return SubwordModel(flat * scale, moved, width, bits)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, most_docs: int, most_chars: int, modulus: int, left_out: int
) -> DataFrame:
    """(text, toxic) to learn from, in order: a bounded number of rows and characters, by a hash of their id.

    Different texts of one id are rows of their own, copies are one row; second and later texts
    of an id come after the first ones of all ids, texts longer than one part in ``LONG_PARTS`` of
    ``most_chars`` after all others. A text that does not fit is passed over. Rows with a null id or label, and those
    whose crc32 of the id leaves ``left_out``, do not take part. All rows are in one task.
    """
    learns = F.col("doc_id").isNotNull() & learns_from(F.col("doc_id"), modulus, left_out)
    known = labels.where(F.col("toxic").isin(0, 1) & learns).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(learns).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = texts.withColumn("h", F.xxhash64("text"))
    # Copies go before the sizes are ranked: numbers only, and at most ``most_docs`` of an id.
    sizes = hashed.select("doc_id", "h", F.length("text").cast("bigint").alias("n")).groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    long = F.col("n") > most_chars // LONG_PARTS
    ranked = top_per_group(sizes.where(F.col("n") <= most_chars), ["doc_id"], [long, F.col("h")], most_docs, "nth")
    # At most ``most_docs`` rows of numbers: small, whatever the tables are.
    listed = (
        ranked.join(known, "doc_id")
        .orderBy(long, "nth", F.xxhash64("doc_id"), "doc_id")
        .limit(most_docs)
        .select("doc_id", "h", "n", "toxic")
        .toArrow()
    )
    fits, left = [], most_chars
    for n in listed["n"].to_pylist():
        fits.append(n <= left)
        left -= n if fits[-1] else 0
    chosen = docs.sparkSession.createDataFrame(
        listed.filter(pa.array(fits, pa.bool_())).select(["doc_id", "h", "toxic"]).to_pylist(), "doc_id bigint, h bigint, toxic int"
    )
    rows = hashed.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text"))
    return rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "h").select("text", "toxic")


def learnt(sample: DataFrame, **training) -> SubwordModel:
    """The model of a bounded sample (text, toxic), trained in one task; the driver sees its weights only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        model = train(whole["text"].combine_chunks(), whole["toxic"].to_numpy().astype(np.int64), **training)
        yield pa.RecordBatch.from_pydict(
            {"buckets": [model.buckets.tobytes()], "bias": [model.bias], "width": [model.width], "bits": [model.bits]}
        )
        del whole, model
        give_back()

    rows = sample.mapInArrow(run, "buckets binary, bias double, width bigint, bits bigint").collect()
    if not rows:
        return train(pa.array([], pa.string()), np.empty(0, np.int64), **training)
    (row,) = rows
    return SubwordModel(np.frombuffer(row.buckets, np.float64), row.bias, row.width, row.bits)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    out: str = "toxic_score",
    modulus: int = 3,
    left_out: int = 1,
    most_docs: int = 4000,
    most_chars: int = 14_000_000,
    **training,
) -> DataFrame:
    """``docs`` with ``out``: the probability, 0 to 1, that a text is toxic.

    ``labels`` (doc_id, toxic) teaches, but for ids whose crc32 modulo ``modulus`` is ``left_out``; at most
    ``most_docs`` labelled texts and ``most_chars`` characters are learnt from, chosen by a hash of the id, so that
    numpy trains, in one task, on a bounded sample; a text that does not fit is passed over. Every row of ``docs`` is scored over its whole text. A
    null or empty text scores as one without evidence. Without labels of both kinds every
    score is the share of label 1 (one half without labels). All columns pass through; an earlier ``out`` is replaced.
    """
    sample = labelled_sample(docs, labels, most_docs, most_chars, modulus, left_out)
    model = docs.sparkSession.sparkContext.broadcast(learnt(sample, **training))
    keep = [c for c in docs.columns if c != out]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text", 2_000_000):
            scores = pa.array(model.value.scores(some["text"]), pa.float64())
            yield pa.RecordBatch.from_arrays([*(some[c] for c in keep), scores], [*keep, out])

    return docs.select(*keep).mapInArrow(run, f"{fields}, `{out}` double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay."""
    scored = score_toxicity(docs, labels, out="__toxic", **options)
    return scored.where(F.col("__toxic") < threshold).drop("__toxic")
