"""Byte BPE and token files against the public libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lexloom.llm.bpe import BpeCodec, Transducer, decode_bpe, encode_bpe, merge, read_ranks
from lexloom.llm.token_files import WordEncoder, part_arrays, write_token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, token_ids string"
TEXTS = [
    None, "", " ", "\n\n  \n", "Hello, world's  end", "naïve café — déjà vu", "你好,世界", "👩‍👩‍👧 family", "a" * 3000,
    "don't  stop\t\n x", "<|endoftext|>", "é ́x", "İstanbul ΣΑΣ ſ", "x y z\u0085w", "1234567 89", "\x00\x01",
    "leenauxeux leeaueau èanelleeau",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "again", None), (3, "again", None), (None, "no id", "c")]
    return spark.createDataFrame(rows, SCHEMA)


def test_codec_equals_the_library(spark, reference):
    got = encode_bpe(table(spark), RANKS, P.PATTERN, decoded="back").collect()
    assert len(got) == len(TEXTS) + 3
    by_id = {r.doc_id: r for r in got if r.doc_id != 3}
    for i, text in enumerate(TEXTS):
        if i != 3:
            assert by_id[i].token_ids == reference.encode_ordinary(text or "") and by_id[i].back == (text or "")


def test_decoding_a_table(spark, reference):
    coded = encode_bpe(table(spark), RANKS, P.PATTERN)
    back = decode_bpe(coded, RANKS)
    assert back.columns == ["doc_id", "token_ids", "text"]
    assert {r.text for r in back.collect()} == {t or "" for t in TEXTS} - {TEXTS[3]} | {"again", "no id", TEXTS[3]}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert encode_bpe(empty, RANKS, P.PATTERN).collect() == []
    assert write_token_files(empty, WORDS, end=2).documents().collect() == []


@pytest.mark.parametrize("most", [50, 100_000])
def test_transducer_equals_merging(most):
    ranks, rng = read_ranks(RANKS), random.Random(5)
    transducer = Transducer(ranks, most)
    parts = [b"lee", b"aux", b" the", b"ing", b"tion", "é".encode(), b"  ", b"ea", b"ueau", b"\xff", b"x", b"0"]
    for _ in range(1500):
        piece = b"".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        want = [ranks[piece]] if piece in ranks else merge(piece, ranks)
        assert list(transducer(piece)) == want
    assert len(transducer.states) <= most


def test_streaming_decode_joins_split_characters():
    codec = BpeCodec(RANKS, P.PATTERN)
    ids = codec.encode("😀é" * 3000)
    assert "".join(codec.decode(iter(ids))) == "😀é" * 3000
    assert "".join(codec.decode([codec.transducer.ranks[b"\xe2"]])) == "�"


@pytest.mark.parametrize("most", [3, 1000])
def test_word_encoder_equals_the_library(most):
    encoder, library = WordEncoder(WORDS, 2, "<u2", most), Tokenizer.from_file(WORDS)
    for texts in (TEXTS, TEXTS[5:9], TEXTS[::-1]):
        ids, counts = encoder(pa.array(texts, pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_files_in_order_of_ids(spark):
    files = write_token_files(table(spark).repartition(5), WORDS, end=2)
    got = sorted(files.documents().collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(WORDS), 0
    texts = [(None, "no id")] + [(i, t) for i, t in enumerate(TEXTS)]
    texts = sorted(texts + [(3, "again")] * 2, key=lambda x: (x[0] is not None, x[0]))
    for row, (doc_id, _) in zip(got, texts):
        assert row.doc_id == doc_id and row.start == at
        at += row.n_tokens
    by_id = {r.doc_id: r for r in got if r.doc_id != 3}
    for i, text in enumerate(TEXTS):
        if i != 3:
            ids = library.encode(text or "", add_special_tokens=False).ids + [2]
            assert (by_id[i].n_tokens, by_id[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    for part in files.parts.collect():
        ids, offsets, docs, _ = part_arrays(files.folder, part.part, files.kind)
        assert (len(ids), len(docs), offsets[-1]) == (part.ids, part.docs, part.ids)


def test_long_pieces_are_read_in_proportion(reference):
    codec = BpeCodec(RANKS, P.PATTERN)
    for text in ("a" * 400_000, "ab" * 100_000):
        assert codec.encode(text).tolist() == list(codec.transducer(text.encode()))
    assert codec.encode("a" * 3000).tolist() == reference.encode_ordinary("a" * 3000)
    assert "".join(codec.decode(codec.encode("a" * 400_000).tolist())) == "a" * 400_000


def test_clashing_column_of_texts(spark):
    docs = spark.createDataFrame([(1, "one two", "kept")], "doc_id bigint, text string, __text string")
    (row,) = encode_bpe(docs, RANKS, P.PATTERN).collect()
    assert row["__text"] == "kept" and len(row.token_ids) == 2


def test_parts_are_read_back_by_as_many_tasks(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('word ', id) as text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_token_files(docs, WORDS, end=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    n = files.parts.count()
    assert n == 8 and files.documents().rdd.getNumPartitions() == n


def test_small_tables_give_the_same_ids(spark):
    docs = spark.createDataFrame([(i, f"{t or ''} nonesuch{i} aux lee") for i, t in enumerate(TEXTS * 20)], "doc_id bigint, text string")
    want = {r.doc_id: r.token_ids for r in encode_bpe(docs, RANKS, P.PATTERN).collect()}
    got = {r.doc_id: r.token_ids for r in encode_bpe(docs, RANKS, P.PATTERN, pieces=5, states=50).collect()}
    assert got == want
    codec = BpeCodec(RANKS, P.PATTERN, 5, 50)
    for row in docs.collect():
        codec.encode(row.text)
    assert len(codec.known) <= 5 and len(codec.known.older) <= 5 and len(codec.transducer.states) <= 50
