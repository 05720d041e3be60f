"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of bounded size with the running number of units and of code
points after each. A unit is found by its number: the frame that holds it is looked up in the running numbers and
only that frame is decompressed. A transformed text is again a list of frames: those that lie
whole in one part are taken over as they are, at most two are cut and packed anew. Digests stream the
frames in order, so no more than one frame is unpacked at a time.

Units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` from left to right: one starts at the first
code point and wherever white space follows something else.

A null or empty text has no frames and no units and stays plain. A text of any length is read once into frames; a
single very long word is spread over frames like any other text. Repeated rows are treated each
on its own. A null id is hashed as empty text. An empty table gives an empty result. Other columns pass through;
one with the name of an output is replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE, slices

#: Marks of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
FRAMED = "frames array<binary>, units array<bigint>, chars array<bigint>, marked boolean"

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACE]] = True


def _later_starts(data: np.ndarray) -> np.ndarray:
    """Places after the first where a unit starts."""
    space = _SPACE[data]
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Packer:
    """Builds a list of frames from raw bytes and finished frames; small neighbours share a frame."""

    def __init__(self, most: int, level: int = 3):
        self.most, self.frames, self._raw = most, [], bytearray()
        self._zip = zstandard.ZstdCompressor(level=level)

    def raw(self, data: bytes) -> None:
        self._raw += data
        while len(self._raw) > self.most:
            end = self.most
            # Not within a code point.
            while end > 1 and self._raw[end] & 0xC0 == 0x80:
                end -= 1
            self.frames.append(self._zip.compress(bytes(self._raw[:end])))
            del self._raw[:end]

    def whole(self, frame: bytes) -> None:
        self._flush()
        self.frames.append(frame)

    def done(self) -> list[bytes]:
        self._flush()
        out, self.frames = self.frames, []
        return out

    def _flush(self) -> None:
        if self._raw:
            self.frames.append(self._zip.compress(bytes(self._raw)))
            self._raw.clear()


class FramedText:
    """One stored text: unit places, parts and bytes, unpacking only the frames that are needed."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int]):
        self.frames, self.units, self.chars = frames, units, chars
        self._unzip = zstandard.ZstdDecompressor()
        #: Numbers of the frames unpacked so far.
        self.opened: list[int] = []

    def open(self, at: int) -> bytes:
        self.opened.append(at)
        return self._unzip.decompress(self.frames[at])

    def place(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte within it, code points before) of the start of a unit; the end for the number of units."""
        at = bisect_right(self.units, unit)
        if at == len(self.frames):
            return at, 0, self.chars[-1] if self.chars else 0
        before = self.units[at - 1] if at else 0
        data = np.frombuffer(self.open(at), np.uint8)
        later = _later_starts(data)
        nth = unit - before
        if self.units[at] - before > len(later):
            # The first byte of the frame starts a unit too.
            later = np.concatenate([[0], later])
        byte = int(later[nth])
        return at, byte, (self.chars[at - 1] if at else 0) + _code_points(data[:byte])

    def copy(self, start: tuple[int, int], end: tuple[int, int], packer: Packer) -> None:
        """Hand the part between two places to the packer: whole frames as they are, cut ones unpacked."""
        (first, low), (last, high) = start, end
        for at in range(first, min(last + 1, len(self.frames))):
            a, b = (low if at == first else 0), (high if at == last else None)
            if a == 0 and b is None:
                packer.whole(self.frames[at])
            elif b is None or a < b:
                packer.raw(self.open(at)[a:b])

    def between(self, first: int, last: int) -> bytes:
        """The bytes of units ``first`` to ``last`` (exclusive)."""
        a, b = self.place(first), self.place(last)
        return b"".join(
            self.open(at)[a[1] if at == a[0] else 0 : b[1] if at == b[0] else None]
            for at in range(a[0], min(b[0] + 1, len(self.frames)))
        )


def pack(data: bytes, packer: Packer) -> tuple[list[bytes], list[int], list[int]]:
    """Frames of a text with the running numbers of units and of code points after each."""
    packer.raw(data)
    frames, units, chars = packer.done(), [], []
    at, n_units, n_chars, word = 0, 0, 0, False
    for frame in frames:
        size = zstandard.frame_content_size(frame)
        piece = np.frombuffer(data, np.uint8, size, at)
        n_units += len(_later_starts(piece)) + (at == 0 or bool(word and _SPACE[piece[0]]))
        n_chars += _code_points(piece)
        word, at = not _SPACE[piece[-1]], at + size
        units.append(n_units)
        chars.append(n_chars)
    return frames, units, chars


def stream(frames: list[bytes], start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The bytes ``start`` to ``end`` of a list of frames, one frame at a time; frames outside are not unpacked."""
    unzip, at = zstandard.ZstdDecompressor(), 0
    for frame in frames:
        size = zstandard.frame_content_size(frame)
        if end is not None and at >= end:
            return
        if at + size > start:
            yield unzip.decompress(frame)[max(0, start - at) : None if end is None else end - at]
        at += size


def digest(pieces: Iterator[bytes]) -> str:
    """Lowercase hex SHA-256 of streamed bytes."""
    state = hashlib.sha256()
    for piece in pieces:
        state.update(piece)
    return state.hexdigest()


def find_markers(frames: list[bytes], markers: tuple[bytes, ...]) -> list[int]:
    """The first place of each marker in the streamed bytes, also across frames; -1 if there is none."""
    found, at, tail = [-1] * len(markers), 0, b""
    keep = max(map(len, markers)) - 1
    for piece in stream(frames):
        seen = tail + piece
        for i, marker in enumerate(markers):
            if found[i] < 0 and (here := seen.find(marker)) >= 0:
                found[i] = at - len(tail) + here
        at += len(piece)
        tail = seen[-keep:] if keep else b""
    return found


def restored(frames: list[bytes], form: str, markers: tuple[str, str, str] = MARKERS) -> Iterator[bytes]:
    """The text before the transformation, from its output and form alone."""
    if form == "plain":
        yield from stream(frames)
        return
    marks = tuple(m.encode() for m in markers)
    p, s, m = find_markers(frames, marks)
    prefix, suffix, middle = p + len(marks[0]), s + len(marks[1]), m + len(marks[2])
    yield from stream(frames, prefix, s if form == "psm" else m)
    yield from stream(frames, middle)
    yield from stream(frames, suffix, m if form == "psm" else p)


def _fields(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def store_frames(
    docs: DataFrame,
    text: str = "text",
    out: str = "framed",
    frame_bytes: int = 1 << 15,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``docs`` with ``out`` for ``text``: frames of at most ``frame_bytes`` (a code point more), running numbers, and
    whether the text holds a marker."""
    keep = [c for c in docs.columns if c not in (out, text)]
    marks = [m.encode() for m in markers]
    kind = pa.struct(
        [("frames", pa.list_(pa.binary())), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("marked", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(frame_bytes)
        for some in slices(batches, "__raw", 8_000_000):
            rows = []
            for data in some["__raw"].to_pylist():
                frames, units, chars = pack(data, packer)
                rows.append({"frames": frames, "units": units, "chars": chars, "marked": any(m in data for m in marks)})
            yield pa.RecordBatch.from_arrays([*(some[c] for c in keep), pa.array(rows, kind)], [*keep, out])

    raw = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__raw"))
    return raw.mapInArrow(run, f"{_fields(docs, keep)}`{out}` struct<{FRAMED.replace(' ', ':').replace(',:', ', ')}>")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first 8-digit groups of the SHA-256 of ``seed:id``."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    stored: DataFrame,
    framed: str = "framed",
    doc_id: str = "doc_id",
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
    frame_bytes: int = 1 << 15,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """Stored texts cut into prefix, middle and suffix, as frames in their new order.

    Adds n (units), form (plain, spm, psm), prefix_chars, middle_chars (null if plain) and output (frames) in
    place of ``framed``. The cuts fall after h1 % (n + 1) and h2 % (n + 1) units; ``percent`` of the texts are
    transformed, ``spm_percent`` of those suffix first (see ``draws``). Empty texts and those that hold a marker stay plain.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in stored.columns if c not in (framed, *made)]
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    box = F.col(framed)
    n = F.coalesce(F.try_element_at(box.units, F.lit(-1)), F.lit(0)).cast("bigint")
    plain = (n == 0) | box.marked | (h3 % 100 >= percent)
    drawn = stored.select(
        *(F.col(f"`{c}`") for c in keep),
        n.alias("__n"),
        F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("__form"),
        F.least(h1 % (n + 1), h2 % (n + 1)).alias("__a"),
        F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("__b"),
        box.frames.alias("__frames"), box.units.alias("__units"), box.chars.alias("__chars"),
    )
    marks = [m.encode() for m in markers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(frame_bytes)
        for some in batches:
            outs, prefixes, middles = [], [], []
            columns = (some[c].to_pylist() for c in ("__form", "__a", "__b", "__frames", "__units", "__chars"))
            for form, a, b, frames, units, chars in zip(*columns):
                if form == "plain":
                    outs.append(frames)
                    prefixes.append(None)
                    middles.append(None)
                    continue
                text = FramedText(frames, units, chars)
                low = text.place(a)
                high = low if a == b else text.place(b)
                ends = {0: ((0, 0), low[:2]), 1: (high[:2], (len(frames), 0)), 2: (low[:2], high[:2])}
                for part in (0, 1, 2) if form == "psm" else (1, 0, 2):
                    packer.raw(marks[part])
                    text.copy(*ends[part], packer)
                outs.append(packer.done())
                prefixes.append(low[2])
                middles.append(high[2] - low[2])
            yield pa.RecordBatch.from_arrays(
                [
                    *(some[c] for c in keep), some["__n"], some["__form"], pa.array(prefixes, pa.int64()),
                    pa.array(middles, pa.int64()), pa.array(outs, pa.list_(pa.binary())),
                ],
                [*keep, *made],
            )

    schema = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>"
    return drawn.mapInArrow(run, _fields(stored, keep) + schema)


def with_digests(transformed: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``transformed`` with output_sha256 and restored_sha256 in place of output, streamed frame by frame."""
    made = ["output_sha256", "restored_sha256"]
    keep = [c for c in transformed.columns if c not in ("output", *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            rows = list(zip(some["output"].to_pylist(), some["form"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(some[c] for c in keep),
                    pa.array([digest(stream(frames)) for frames, _ in rows], pa.string()),
                    pa.array([digest(restored(frames, form, markers)) for frames, form in rows], pa.string()),
                ],
                [*keep, *made],
            )

    chosen = transformed.select(*(F.col(f"`{c}`") for c in keep), "output")
    return chosen.mapInArrow(run, _fields(transformed, keep) + "output_sha256 string, restored_sha256 string")


def with_text(df: DataFrame, column: str = "output", out: str = "text") -> DataFrame:
    """``df`` with the text of the frames in ``column`` as ``out``, for readers that want it whole."""
    keep = [c for c in df.columns if c not in (column, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            texts = [b"".join(stream(frames)).decode() for frames in some[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(some[c] for c in keep), pa.array(texts, pa.string())], [*keep, out])

    chosen = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`"))
    return chosen.mapInArrow(run, _fields(df, keep) + f"`{out}` string")
