"""What the operators of this folder share: keys, words, batches, shared files."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import SourceUnavailable
from lexloom.session import shared_folder

#: White space of every contract here: space, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

T = TypeVar("T")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else.

    ``lower`` does the same on pure ASCII and is much faster there.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def key_hash(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together a 128-bit key."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)


def learns_from(doc_id: Column, modulus: int, left_out: int) -> Column:
    """Whether the crc32 of the id as text leaves another remainder than ``left_out``.

    A missing id counts as empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != left_out


def shared_path(spark: SparkSession, kind: str) -> tuple[str, str]:
    """A fresh place under the shared folder: as Spark names it, and as a mounted path.

    Files that tasks map into memory need a folder mounted on every machine, so the
    shared folder must be a ``file:`` path (a network or FUSE mount on a cluster).
    """
    base = shared_folder(spark).rstrip("/")
    parsed = urlparse(base)
    if parsed.scheme not in ("", "file"):
        raise SourceUnavailable(
            f"memory-mapped files need a mounted spark.checkpoint.dir, not {parsed.scheme}:"
        )
    name = f"{kind}-{uuid.uuid4().hex}"
    return f"{base}/{name}", f"{unquote(parsed.path)}/{name}"


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh table path under the shared folder, wherever that is."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def put_file(path: Path, content: bytes) -> None:
    """Write a file whole or not at all; a repeated task replaces it by the same content."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_bytes(content)
    part.replace(path)


#: What a worker keeps between its tasks: one object, and what it is.
_kept: dict[tuple, object] = {}


def keep(key: tuple, make: Callable[[], T]) -> T:
    """The object ``key``, made once per Python worker. A worker keeps only the last key's."""
    if key not in _kept:
        _give_up()
        _kept[key] = make()
    return _kept[key]


def _give_up() -> None:
    if _kept:
        _kept.clear()
        # What was kept may refer to itself in circles.
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: idle workers and other tasks share one machine's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int = 6_000_000, keeping: tuple | None = None
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes at a time.

    A single longer text is a slice of its own. What the worker kept for another
    operator than ``keeping`` is given up first.
    """
    if keeping not in _kept:
        _give_up()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)
    give_back()


def word_lists(texts: pa.Array, fold: bool = True) -> pa.LargeListArray:
    """The words of each text, cut at ASCII white space; a missing text has none.

    ``fold`` lower-cases A-Z.
    """
    # A copy, as the ASCII functions misread the offsets of a sliced array.
    whole = texts.take(pa.array(range(len(texts)), pa.int64()))
    large = pc.fill_null(whole.cast(pa.large_string()), "")
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(large) if fold else large)
    lists = pc.ascii_split_whitespace(trimmed).cast(pa.large_list(pa.large_string()))
    # An empty text splits into one empty word.
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
    empty = (pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0)
    lengths[empty] = 0
    flat = lists.flatten()
    flat = flat.filter(pc.not_equal(flat, ""))
    offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int64())
    return pa.LargeListArray.from_arrays(offsets, flat)
