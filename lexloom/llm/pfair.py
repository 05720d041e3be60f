"""Sources interleaved to target weights by Pfair windows and earliest deadline first.

Documents of a source are numbered and cut into blocks. Weights are whole parts of a
period of Q slots. With q parts, block k (from 0) of a source is released at floor(k Q / q) and
is due at ceil((k + 1) Q / q); every slot goes to the released block with the earliest
deadline. As the parts add up to Q, no deadline is missed, so at any slot a source
is less than one block away from its target. The windows repeat with the period, so
one period is worked out, in one row of arrays that depends on the number of sources
alone, and every block finds its slot there by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import key_hash
from lexloom.operators.ordering import running_total

#: A source's share is off by at most one part in this many per source.
PARTS_PER_SOURCE = 64


def _named(source: str) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def whole_parts(weights: DataFrame) -> DataFrame:
    """(key, parts, period) from (key, weight bigint): parts add up to the period.

    Every source gets one part and a share of the rest by largest remainder, ties to
    the smaller key. The period is the power of two of at least 64 slots per source.
    """
    every = Window.partitionBy(F.lit(0))
    sized = weights.select(
        "key",
        F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("decimal(38,0)").alias("w"),
        F.pow(
            F.lit(2.0), F.ceil(F.log2(F.count(F.lit(1)).over(every) * PARTS_PER_SOURCE))
        ).cast("bigint").alias("period"),
        F.count(F.lit(1)).over(every).alias("n"),
    ).withColumn("total", F.greatest(F.sum("w").over(every), F.lit(1)))
    shared = sized.withColumn("fair", F.col("w") * (F.col("period") - F.col("n"))).select(
        "key", "period",
        (F.expr("fair div total") + 1).cast("bigint").alias("parts"),
        (F.col("fair") % F.col("total")).alias("rest"),
    )
    order = every.orderBy(F.desc("rest"), "key")
    missing = F.col("period") - F.sum("parts").over(every)
    extra = F.floor(missing / F.count(F.lit(1)).over(every)) + F.when(
        F.row_number().over(order) <= missing % F.count(F.lit(1)).over(every), 1
    ).otherwise(0)
    return shared.select("key", (F.col("parts") + extra).cast("bigint").alias("parts"), "period")


def schedule(parts: DataFrame) -> DataFrame:
    """(key, turn, at): the slot within a period of every block of a period.

    Earliest deadline first as a fold over the slots; ties go to the smaller key.
    """
    row = parts.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("key", "parts"))).alias("s"), F.max("period").alias("period")
    ).where("period is not null")
    slots = row.select(
        "s",
        F.expr(
            """aggregate(
              sequence(0, period - 1),
              named_struct('done', transform(s, x -> 0L), 'out', cast(array() as array<int>)),
              (state, t) -> transform(array(array_min(transform(s, (x, i) -> if(
                  state.done[i] < x.parts and (state.done[i] * period) div x.parts <= t,
                  named_struct('due', ((state.done[i] + 1) * period + x.parts - 1) div x.parts, 'i', i),
                  null))).i),
                pick -> named_struct(
                  'done', transform(state.done, (d, i) -> if(i = pick, d + 1, d)),
                  'out', concat(state.out, array(pick))))[0],
              state -> state.out)"""
        ).alias("out"),
    ).select("s", F.posexplode("out").alias("at", "i"))
    turn = F.row_number().over(Window.partitionBy("i").orderBy("at")) - 1
    return slots.select(F.expr("s[i].key").alias("key"), turn.cast("bigint").alias("turn"), F.col("at").cast("bigint").alias("at"))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame | None = None,
    block_docs: int = 128,
    temperature: float = 0.5,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str | None = "text",
) -> DataFrame:
    """The place of every document in the mix; all documents stay.

    Returns ``doc_id``, ``source``, ``weight`` (share of the slots), ``block`` (within the source, from
    0), ``in_block``, ``slot``, ``release`` and ``deadline``, and the row's hashes ``h1``, ``h2``. Reading by
    (slot, in_block) gives the mix. ``targets`` (source, weight) sets the weights; without it a source
    weighs its number of documents to the power ``temperature``. A source missing from ``targets``, or with
    a weight under one millionth, gets one part of the period. Once a source has run out its slots stay
    empty and the others keep their proportions. The order within a source is a hash of id and text.

    A null source is a source of its own. Rows alike in id, source and text share one place
    each but count singly. An empty table gives an empty result.
    """
    h1, h2 = key_hash(F.col(doc_id), F.col(source), *([F.col(text)] if text else []))
    alike = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _named(source).alias("key"),
        h1.alias("h1"), h2.alias("h2"),
    ).groupBy("doc_id", "source", "key", "h1", "h2").agg(F.count(F.lit(1)).alias("rows"))
    numbered = running_total(alike, ["key"], ["h1", "h2", "doc_id"], F.col("rows"), "upto")
    if targets is None:
        weights = numbered.groupBy("key").agg(F.max("upto").alias("n")).select(
            "key", F.round(F.pow("n", F.lit(temperature)) * 1_000_000).cast("bigint").alias("weight")
        )
    else:
        given = targets.groupBy(_named(targets.columns[0]).alias("key")).agg(F.sum(targets.columns[1]).alias("given"))
        weights = numbered.select("key").distinct().join(given, "key", "left").select(
            "key", F.round(F.col("given") * 1_000_000).cast("bigint").alias("weight")
        )
    parts = whole_parts(weights)
    start = F.col("upto") - F.col("rows")
    blocks = (
        numbered.select("*", F.floor(start / block_docs).alias("block"), (start % block_docs).alias("in_block"))
        .join(parts, "key")
        .withColumn("turn", F.col("block") % F.col("parts"))
        .join(schedule(parts), ["key", "turn"])
    )
    return blocks.select(
        "doc_id", "source",
        (F.col("parts") / F.col("period")).alias("weight"),
        "block", "in_block",
        (F.expr("block div parts") * F.col("period") + F.col("at")).alias("slot"),
        F.expr("(block * period) div parts").alias("release"),
        F.expr("((block + 1) * period + parts - 1) div parts").alias("deadline"),
        "h1", "h2",
    )


def with_places(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``slot`` and ``in_block`` of the mix; earlier columns of these names are replaced."""
    return _placed(docs, **options).select(
        *(f"__doc.`{c}`" for c in docs.columns if c not in ("slot", "in_block")), "slot", "in_block"
    )


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mix, all columns and rows as they are."""
    return _placed(docs, **options).orderBy("slot", "in_block", "h1", "h2").select("__doc.*")


def _placed(docs: DataFrame, **options) -> DataFrame:
    placed = mix_sources(docs, **options).select("h1", "h2", "slot", "in_block")
    names = {name: options.get(name, name) for name in ("doc_id", "source", "text")}
    h1, h2 = key_hash(*(F.col(names[n]) for n in ("doc_id", "source", "text") if names[n]))
    keyed = docs.select(F.struct("*").alias("__doc"), h1.alias("h1"), h2.alias("h2"))
    return keyed.join(placed, ["h1", "h2"])
