"""A text collection made ready for training: five stages over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.bpe import encode_bpe
from lexloom.llm.common import scratch, table
from lexloom.llm.line_runs import drop_common_lines
from lexloom.llm.near_texts import drop_similar
from lexloom.llm.pfair import in_mixed_order, with_places
from lexloom.llm.subword import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7."""
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have; ``n_chars`` follows the text."""
    kept = drop_common_lines(docs.select(*COLUMNS), min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Candidates meet in segments of three fingerprints of three-word shingles; a link needs four fifths
    of the five-word shingles in common.
    """
    return drop_similar(docs.select(*COLUMNS), similarity=0.8, similar_width=5, width=3)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources are due at square-root weights.

    A table of several files is read in another order, so the last stage gives the places again.
    """
    return in_mixed_order(docs.select(*COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, without the text, and its ``slot`` and ``in_block`` in the mix.

    Executors still hold what the stages before left, so the tables of pieces and states are small here.
    The ids are decoded again: ``decoded_sha256`` is of what they decode to, ``text_sha256`` of the text.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    hashed = with_places(docs.select(*COLUMNS)).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    coded = encode_bpe(hashed, path, public_tokenizers.PATTERN, decoded="decoded", pieces=100_000, states=30_000)
    return coded.withColumns(
        {"n_tokens": F.size("token_ids").cast("bigint"), "decoded_sha256": F.sha2("decoded", 256)}
    ).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: SQL can express neither the toxicity model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written to the shared folder and read again.

    The result is in the order of the mix.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.orderBy("slot", "in_block", "doc_id")
