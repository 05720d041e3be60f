"""Token ids in flat unsigned files with 64-bit document offsets, mapped into memory to read.

Documents are range-partitioned by id. Each task writes three flat files for its part:
ids (little-endian, two or four bytes), offsets (8 bytes, one more than documents, from the part's
start) and document ids (8 bytes, plus one byte each that tells missing ids). A part's
base, the ids and documents of all parts before it, is a prefix sum over one small row per part.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import keep, shared_path, slices, word_lists
from lexloom.session import durable

_TOGETHER = 256


class WordEncoder:
    """Ids of texts by a tokenizer that never joins text across ASCII white space.

    Each different word goes to the tokenizer once; two generations of at most about ``most``
    words each keep the ids of the words met lately.
    """

    def __init__(self, path: str, end: int | None, kind: str = "<u4", most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.kind, self.most = end, np.dtype(kind), most
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.older, self.memo = self.memo, {}
        memo, older, new = self.memo, self.older, []
        for w in words:
            if w not in memo:
                if w in older:
                    memo[w] = older[w]
                else:
                    new.append(w)
        for at in range(0, len(new), _TOGETHER):
            some = new[at : at + _TOGETHER]
            # As one text, which is quicker; a token is of the word that its place is in.
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(got.ids, self.kind).tobytes()
            begins = np.cumsum([0, *(len(w) + 1 for w in some)])
            places = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.offsets))
            cuts = (np.searchsorted(places, begins) * self.kind.itemsize).tolist()
            for w, start, stop in zip(some, cuts, cuts[1:]):
                memo[w] = ids[start:stop]
        return [memo[w] for w in words]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text); the end id, if any, closes each text."""
        words = word_lists(texts, fold=False)
        coded = words.flatten().dictionary_encode()
        pieces = self._known(coded.dictionary.to_pylist())
        if self.end is not None:
            pieces.append(np.array([self.end], self.kind).tobytes())
        size = self.kind.itemsize
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // size
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(pieces), self.kind)
        used = coded.indices.to_numpy(zero_copy_only=False)
        cuts = words.offsets.to_numpy()
        if self.end is not None:
            used = np.insert(used, cuts[1:], len(pieces) - 1)
            cuts = cuts + np.arange(len(cuts))
        per = lengths[used]
        upto = np.concatenate([[0], np.cumsum(per)])
        at = np.repeat(starts[used] - upto[:-1], per) + np.arange(upto[-1])
        return flat[at], np.diff(upto[cuts])


@dataclass(frozen=True)
class TokenFiles:
    """A written set of parts: folder as mounted, type of an id, and one row per part."""

    folder: str
    kind: str
    #: part, docs, ids, first_doc, base: documents and ids of the part, and of all before it.
    parts: DataFrame

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32, part) of every document, read back from the files.

        The checksum is of the ids as four little-endian bytes each, whatever the files use.
        """
        read = _reader(self.folder, self.kind)
        # A number of its own, since the few rows would else be merged into one task.
        n = max(1, self.parts.count())
        return self.parts.select("part", "base").repartitionByRange(n, "part").mapInArrow(
            read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int"
        )


def part_arrays(folder: str, part: int, kind: str) -> tuple[np.ndarray, ...]:
    """The mapped ids, offsets, document ids and presence of one part."""
    at = Path(folder)

    def mapped(name: str, dtype: str) -> np.ndarray:
        path = at / f"{name}-{part:06d}.bin"
        return np.memmap(path, dtype, "r") if path.stat().st_size else np.empty(0, dtype)

    return mapped("ids", kind), mapped("offsets", "<u8"), mapped("docs", "<i8"), mapped("present", "u1")


def _reader(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch["part"].to_pylist(), batch["base"].to_pylist()):
                ids, offsets, docs, present = part_arrays(folder, part, kind)
                for at in range(0, len(docs), 8192):
                    cut = offsets[at : at + 8193].astype(np.int64)
                    digests = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[at : at + 8192], pa.int64(), mask=present[at : at + 8192] == 0),
                            pa.array(cut[:-1] + base),
                            pa.array(np.diff(cut)),
                            pa.array(digests, pa.int64()),
                            pa.array(np.full(len(digests), part, np.int32)),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    return run


def _writer(folder: str, tokenizer: str, end: int | None, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = ("words", tokenizer, end, kind), TaskContext.get().partitionId()
        encoder = keep(key, lambda: WordEncoder(tokenizer, end, kind))
        names = ("ids", "offsets", "docs", "present")
        Path(folder).mkdir(parents=True, exist_ok=True)
        mine = {n: Path(folder) / f".{n}-{part:06d}.{uuid.uuid4().hex}" for n in names}
        files, n_docs, n_ids = None, 0, 0
        try:
            for some in slices(batches, "text", 12_000_000, key):
                if files is None:
                    files = {n: path.open("wb") for n, path in mine.items()}
                    files["offsets"].write(np.zeros(1, "<u8").tobytes())
                ids, counts = encoder(some["text"])
                docs = some["doc_id"]
                files["ids"].write(ids.tobytes())
                files["offsets"].write((np.cumsum(counts) + n_ids).astype("<u8").tobytes())
                files["docs"].write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                files["present"].write(docs.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                n_docs, n_ids = n_docs + len(docs), n_ids + len(ids)
            if files is not None:
                for n, file in files.items():
                    file.close()
                    mine[n].replace(Path(folder) / f"{n}-{part:06d}.bin")
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part], pa.int32()), "docs": [n_docs], "ids": [n_ids]}
                )
        finally:
            for path in mine.values():
                path.unlink(missing_ok=True)

    return run


def _kind(tokenizer: str) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> TokenFiles:
    """Encode every text and write the ids in ascending order of ``doc_id``.

    ``tokenizer`` is a path that every machine has, of a tokenizer that never joins text across white space; ``end``
    closes each document. A null or empty text has no ids of its own. Null ids come first; rows with
    one id follow each other in the order of their texts' hashes. A repeated task writes the same
    files again under its own names and renames them, so parts are whole or absent.
    An empty table has no parts.
    """
    _, folder = shared_path(docs.sparkSession, "token-files")
    kind = _kind(tokenizer)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    parts = durable(
        ordered.mapInArrow(_writer(folder, tokenizer, end, kind), "part int, docs bigint, ids bigint")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.select(
        "*",
        F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first_doc"),
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"),
    )
    return TokenFiles(folder, kind, durable(based))
