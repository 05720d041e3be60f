"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.bpe import encode_bpe
from lexloom.llm.common import learns_from, table
from lexloom.llm.frames import fill_in_middle, store_frames, with_digests
from lexloom.llm.hard_negatives import hard_negatives
from lexloom.llm.line_runs import drop_common_lines
from lexloom.llm.ngram_trie import score_held_out
from lexloom.llm.personal import KINDS, find_personal
from lexloom.llm.pfair import mix_sources
from lexloom.llm.repeats import remove_repeats
from lexloom.llm.robust import judge_quality
from lexloom.llm.simhash import near_copies
from lexloom.llm.subword import score_toxicity
from lexloom.llm.token_files import write_token_files
from lexloom.llm.topk import top_products
from lexloom.session import durable


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines found in ten documents or more, dropped everywhere."""
    kept = drop_common_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at three bits or fewer."""
    found = near_copies(table(spark, folder, "documents"), width=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without strings of fifty bytes that an earlier document has."""
    left = remove_repeats(table(spark, folder, "documents"), threshold=50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every text under a trigram model of six sevenths of them."""
    return score_held_out(table(spark, folder, "documents").select("doc_id", "text"))


def op5_robust_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every text, the fixed rule, and outliers within language and source."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return judge_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    coded = encode_bpe(
        table(spark, folder, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        decoded="decoded",
    )
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document in a mix of the sources at square-root weights."""
    return mix_sources(table(spark, folder, "documents")).drop("h1", "h2")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learnt from two thirds of the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, folder, "labels"), out="score")
    return scored.select(
        "doc_id",
        (~learns_from(F.col("doc_id"), 3, 1)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op9_top_products(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    return top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids in flat files in the order of ids, read back."""
    files = write_token_files(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2
    )
    return files.documents()


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses and numbers of persons by patterns, and those that a model of whole spans adds."""
    found = find_personal(table(spark, folder, "documents"), columns=["doc_id"])
    base = F.filter("spans", lambda s: s.base)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"),
    )


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut in three at random units and put in another order, from stored frames."""
    stored = durable(store_frames(table(spark, folder, "documents").select("doc_id", "text")))
    return with_digests(fill_in_middle(stored))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of other labels that score half to nineteen twentieths of a positive."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, moved)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_repeats": op3_repeats,
    "op4_ngram_scores": op4_ngram_scores,
    "op5_robust_quality": op5_robust_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pfair_mix": op7_pfair_mix,
    "op8_toxicity": op8_toxicity,
    "op9_top_products": op9_top_products,
    "op10_token_files": op10_token_files,
    "op11_personal_data": op11_personal_data,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op1_line_dedup": f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS key FROM placed),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM common)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id""",
    "op9_top_products": """
WITH sound AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (SELECT r, vec_id, len(v) AS dim, unnest(v) AS x, unnest(range(len(v))) AS i FROM sound),
asked AS (SELECT min(r) AS r FROM sound WHERE vec_id % 50 = 0 GROUP BY vec_id, v),
scored AS (
  SELECT q.vec_id AS query_id, c.r, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.r IN (SELECT r FROM asked) GROUP BY q.vec_id, q.r, c.r, c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op12_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
),
hashed AS (SELECT *, len(units) AS n, sha256('42:' || id) AS h FROM cut),
drawn AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed
),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts""",
    "op13_hard_negatives": """
WITH sound AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, len(embedding) AS dim,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (SELECT r, vec_id, label, dim, unnest(v) AS x, unnest(range(len(v))) AS i FROM sound),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, c.r AS other, c.vec_id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.i = c.i AND a.dim = c.dim AND a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL
),
positive AS (
  SELECT r, anchor_id, other AS p, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) <= 5
),
negative AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.p ORDER BY s.score DESC, s.vec_id, s.other) AS rank
  FROM positive p JOIN scored s USING (r)
  WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negative WHERE rank <= 3""",
}
