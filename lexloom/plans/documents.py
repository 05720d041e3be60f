"""Own documents from files to searchable chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.documents import chunk_documents, with_embeddings
from lexloom.operators.matters import append_rows
from lexloom.session import durable
from lexloom.sources.files import document_text, require_text
from lexloom.sources.rows import TABLES


def ingest_files(
    files: DataFrame, documents: DataFrame, chunks: DataFrame, created_at: str,
    matter_id: int | None = None, doc_type: str | None = None, provider: Callable | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New rows of the documents and chunks tables for files not stored yet.

    A content is stored once: the smallest path of its copies names it. Chunks have
    vectors only when a provider is given.
    """
    read = require_text(durable(document_text(files)))
    fresh = read.join(documents.select("sha256").distinct(), "sha256", "left_anti")
    keep = fresh.groupBy("sha256").agg(F.min("path").alias("path")).select("path")
    named = fresh.join(keep, "path", "left_semi").select(
        F.lit(matter_id).cast("bigint").alias("matter_id"),
        F.regexp_extract("path", r"[^/]*$", 0).alias("title"),
        F.lit(doc_type).cast("string").alias("doc_type"),
        F.col("path").alias("source_path"), "sha256", "page_count",
        F.length("text").alias("char_count"), F.col("text").alias("full_text"),
        F.lit("{}").alias("metadata"), F.lit(created_at).cast("timestamp").alias("created_at"),
    )
    stored = durable(append_rows(documents, named, ["source_path"]))
    parts = chunk_documents(stored, "id", "full_text").withColumnRenamed("id", "document_id")
    if provider is not None:
        parts = with_embeddings(parts, "content", provider)
    else:
        parts = parts.withColumn("embedding", F.lit(None).cast("array<float>"))
    from lexloom.functions.text import tokens

    parts = parts.withColumn("tokens", tokens(F.col("content")))
    numbered = append_rows(chunks, parts, ["document_id", "chunk_index"])
    return _in_order(stored, "documents"), _in_order(numbered, "document_chunks")


def _in_order(rows: DataFrame, table: str) -> DataFrame:
    return rows.select(*[part.split()[0] for part in TABLES[table].split(", ")])
