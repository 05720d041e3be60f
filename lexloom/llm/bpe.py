"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Whatever follows, the merges of a text end in tokens that start at a position from which
some token could still go on. Each such position has one encoding of what lies before it; the tokens on which
all of them agree are final. So a state of the transducer is the last final token and
the bytes after it, reading a byte emits the tokens that become final, and states and transitions are made
when first met. The last token of each prefix is the one that does not merge differently with its predecessor.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import keep, slices

_CHUNK = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens by merging the neighbours of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        best = min((r for r in pairs if r is not None), default=None)
        if best is None:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class _State:
    """Bytes not yet final, the last token of each prefix of them, the open positions, the steps.

    A prefix has its last token and where that starts, or None where no token can start;
    prefix 0 has the last final token, or -1.
    """

    __slots__ = ("pending", "prefixes", "open", "steps", "end")

    def __init__(self, pending: bytes, prefixes: tuple, open_: tuple[int, ...]):
        self.pending, self.prefixes, self.open = pending, prefixes, open_
        self.steps: dict[int, tuple[_State, tuple[int, ...]]] | None = None
        self.end: tuple[int, ...] | None = None


def _path(prefixes: tuple, upto: int) -> tuple[int, ...]:
    tokens = []
    while upto > 0:
        token, upto = prefixes[upto]
        tokens.append(token)
    return tuple(reversed(tokens))


class Transducer:
    """Tokens of byte strings.

    The first ``most`` states met are kept, so the frequent ones stay and memory is bounded. Where a
    piece leaves them, its rest is read prefix by prefix in the same way without making states.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 100_000):
        self.ranks, self.most = ranks, most
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.heads = {token[:i] for token in ranks for i in range(1, len(token) + 1)}
        self.bytes = [bytes([i]) for i in range(256)]
        self.agrees: dict[int, bool] = {}
        self.states: dict[tuple[int, bytes], _State] = {}
        self.start = self._state(b"", ((-1, -1),), (0,))

    def _follows(self, last: int, token: int) -> bool:
        """Whether ``token`` after ``last`` (-1: the beginning) is what merging gives."""
        # One number per pair: tuples of two would be four times as large.
        pair = (last + 1) * len(self.tokens) + token
        known = self.agrees.get(pair)
        if known is None:
            if len(self.agrees) > 4 * self.most:
                self.agrees.clear()
            before = self.tokens[last] if last >= 0 else b""
            wanted = [last, token] if last >= 0 else [token]
            known = self.agrees[pair] = merge(before + self.tokens[token], self.ranks) == wanted
        return known

    def _state(self, pending: bytes, prefixes: tuple, open_: tuple[int, ...]) -> _State:
        key = (prefixes[0][0], pending)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = _State(pending, prefixes, open_)
        return state

    def _last(self, text: bytes, size: int, prefixes, open_) -> tuple[int, int]:
        """The last token of the first ``size`` bytes, and where it starts."""
        for start in open_:
            token = self.ranks.get(text[start:size])
            if token is not None and self._follows(prefixes[start][0], token):
                return token, start
        raise ValueError("the ranks are not those of merges over single bytes")

    def _rest(self, state: _State, rest: bytes) -> tuple[int, ...]:
        """The tokens of what is pending and ``rest``."""
        text, prefixes, open_ = state.pending + rest, list(state.prefixes), list(state.open)
        heads = self.heads
        for size in range(len(state.pending) + 1, len(text) + 1):
            prefixes.append(self._last(text, size, prefixes, open_))
            open_ = [p for p in open_ if text[p:size] in heads]
            open_.append(size)
        return _path(prefixes, len(text))

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        pending = state.pending + self.bytes[byte]
        size = len(pending)
        prefixes = (*state.prefixes, self._last(pending, size, state.prefixes, state.open))
        open_ = (*[p for p in state.open if pending[p:] in self.heads], size)
        final, emitted = 0, ()
        if open_[0]:
            # The encodings of all open positions agree up to where their paths back first meet.
            ends = set(open_)
            while len(ends) > 1:
                last = max(ends)
                ends.remove(last)
                ends.add(prefixes[last][1])
            final = ends.pop()
        if final:
            emitted = _path(prefixes, final)
            prefixes = (
                (prefixes[final][0], -1),
                *((p[0], p[1] - final) if p and p[1] >= final else None for p in prefixes[final + 1 :]),
            )
            pending, open_ = pending[final:], tuple([p - final for p in open_])
        made = (self._state(pending, prefixes, open_), emitted)
        if state.steps is None:
            state.steps = {}
        state.steps[byte] = made
        return made

    def __call__(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out = self.start, []
        for at, byte in enumerate(piece):
            made = state.steps.get(byte) if state.steps else None
            if made is None:
                if len(self.states) >= self.most:
                    out.extend(self._rest(state, piece[at:]))
                    return tuple(out)
                made = self._step(state, byte)
            state, emitted = made
            out.extend(emitted)
        if state.end is None:
            state.end = _path(state.prefixes, len(state.pending))
        out.extend(state.end)
        return tuple(out)


class _Pieces(dict):
    """Packed tokens of the pieces met lately: two generations of at most ``most`` pieces each."""

    def __init__(self, encode, most: int, kind: str):
        super().__init__()
        self.encode, self.most, self.kind, self.older = encode, most, kind, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        tokens = self.older.get(piece)
        if tokens is None:
            tokens = array(self.kind, self.encode(piece.encode())).tobytes()
        self[piece] = tokens
        return tokens


class BpeCodec:
    """Encodes texts and decodes ids with one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str, pieces: int = 300_000, states: int = 100_000):
        self.transducer = Transducer(read_ranks(path), states)
        self.find = regex.compile(pattern).findall
        self.kind = "H" if len(self.transducer.tokens) <= 1 << 16 else "I"
        self.known = _Pieces(self.transducer, pieces, self.kind)

    def encode(self, text: str) -> np.ndarray:
        """Token ids, each match of the pattern on its own."""
        known = self.known
        return np.frombuffer(b"".join([known[piece] for piece in self.find(text)]), self.kind)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes whole: an incremental decoder keeps unfinished characters.

        Bytes that are not UTF-8 come out as replacement characters.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        tokens, held = self.transducer.tokens, []
        for number in ids:
            held.append(tokens[number])
            if len(held) == _CHUNK:
                yield machine.decode(b"".join(held))
                held = []
        yield machine.decode(b"".join(held), final=True)


def encode_bpe(
    docs: DataFrame,
    path: str,
    pattern: str,
    out: str = "token_ids",
    decoded: str | None = None,
    text: str = "text",
    pieces: int = 300_000,
    states: int = 100_000,
) -> DataFrame:
    """``docs`` with ``out``: the token ids of ``text``; all other columns pass through, ``text`` goes.

    ``path`` is a rank file that every machine has. With ``decoded`` the ids are also decoded
    again, into a column of that name. Null and empty texts have no ids. Columns named as the
    new ones are replaced. Texts of any length are read once, and the tables kept by a task are bounded:
    ``pieces`` and ``states`` bound its memory against time and change no id.
    """
    others = [c for c in docs.columns if c not in (text, out, decoded)]
    read = "__text"
    while read in others:
        read += "_"
    rows = docs.select(*others, F.col(text).cast("string").alias(read))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"`{out}` array<int>"]
    names = [*others, out]
    if decoded:
        fields.append(f"`{decoded}` string")
        names.append(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("bpe", path, pattern, pieces, states)
        codec = keep(key, lambda: BpeCodec(path, pattern, pieces, states))
        for some in slices(batches, read, 2_000_000, key):
            ids = [codec.encode(t or "") for t in some[read].to_pylist()]
            sizes = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
            columns = [some[c] for c in others]
            columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)))
            if decoded:
                columns.append(pa.array(["".join(codec.decode(x.tolist())) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, ", ".join(fields))


def decode_bpe(encoded: DataFrame, path: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """``encoded`` with ``out``: the text of the token ids in ``ids``; null ids give empty text.

    All columns but an earlier ``out`` pass through.
    """
    others = [c for c in encoded.columns if c != out]
    fields = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = keep(("bpe", path, ""), lambda: BpeCodec(path, ""))
        for batch in batches:
            texts = ["".join(codec.decode(x or [])) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(texts, pa.string())], [*others, out])

    return encoded.select(*others).mapInArrow(run, ", ".join([*fields, f"`{out}` string"]))
