"""Sorted whole numbers in Elias-Fano form: low bytes as they are, high parts as one bit per step.

Element i with high part h sets bit h + i of the upper bits, so the i-th one bit gives its high part, and
the zero bits around a high part give the range of elements that share it. Every function takes arrays
of questions and works on mapped memory without unpacking it.
"""

from __future__ import annotations

import numpy as np

_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the n-th one bit of a byte, from the lowest bit.
_PLACES = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _n, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _PLACES[_byte, _n] = _bit


def _in_word(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the ``nth`` one bit of each 64-bit word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_COUNTS[parts], axis=1, dtype=np.int64)
    byte = (upto <= nth[:, None]).sum(axis=1)
    rows = np.arange(len(nth))
    before = np.where(byte > 0, upto[rows, byte - 1], 0)
    return byte * 8 + _PLACES[parts[rows, byte], nth - before]


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of ascending unsigned ``values``, to be stored and given back to ``EliasFano``."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = 0
    while width < 7 and (top >> (8 * width)) > 8 * max(n, 1):
        width += 1
    low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    high = (values >> np.uint64(8 * width)).astype(np.int64)
    size = (int(high[-1]) if n else 0) + n + 1
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))]).astype("<u4")
    return {"low": np.ascontiguousarray(low).ravel(), "upper": upper, "ones": ones, "size": np.array([n, width], "<i8")}


class EliasFano:
    """Access and search over encoded numbers."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in parts["size"])
        self.low = parts["low"].reshape(-1, self.width) if self.width else None
        self.upper, self.ones = parts["upper"], parts["ones"]
        self.zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for i in range(self.width):
            out |= self.low[at, i].astype(np.uint64) << np.uint64(8 * i)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The elements at places ``at``."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        place = word * 64 + _in_word(self.upper[word], at - self.ones[word].astype(np.int64))
        high = (place - at).astype(np.uint64) << np.uint64(8 * self.width)
        return high | self._lows(at) if self.width else high

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a high part under ``high``."""
        out = np.zeros(len(high), np.int64)
        all_zeros = int(self.zeros[-1])
        asked = np.flatnonzero((high > 0) & (high <= all_zeros))
        nth = high[asked] - 1
        word = np.searchsorted(self.zeros, nth, side="right") - 1
        place = word * 64 + _in_word(~self.upper[word], nth - self.zeros[word])
        out[asked] = place - nth
        out[high > all_zeros] = self.n
        return np.minimum(out, self.n)

    def _run(self, start: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many elements from place ``start`` on have high part ``high``: one bits in a row, at most 63 of them."""
        bit = start + high
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        inside = word < len(self.upper)
        here = np.where(inside, self.upper[np.minimum(word, len(self.upper) - 1)], np.uint64(0)) >> off
        after = np.where(word + 1 < len(self.upper), self.upper[np.minimum(word + 1, len(self.upper) - 1)], np.uint64(0))
        with np.errstate(over="ignore"):
            # A shift by 64 is left out: then the window is the word itself.
            window = here | np.where(off > 0, after << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
            lowest_zero = ~window & (window + np.uint64(1))
        out = np.full(len(bit), 64, np.int64)
        some = lowest_zero > 0
        out[some] = np.log2(lowest_zero[some].astype(np.float64)).astype(np.int64)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the elements, or -1: a successor search that must hit."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        keys = keys.astype(np.uint64)
        shifted = keys >> np.uint64(8 * self.width)
        high = np.minimum(shifted, np.uint64(1 << 62)).astype(np.int64)
        low = self._below(high)
        known = np.minimum(high, len(self.upper) * 64)
        run = self._run(low, known)
        long = np.flatnonzero(run >= 63)
        end = low + run
        if len(long):
            end[long] = self._below(high[long] + 1)
        end = np.minimum(end, self.n)
        if not self.width:
            return np.where(low < end, low, -1)
        want = keys & np.uint64((1 << (8 * self.width)) - 1)
        return search(self._lows, low, end, want)


def search(value_at, low: np.ndarray, stop: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of ``want`` within each range [low, stop), ascending under ``value_at``, or -1. Ranges that are settled drop out."""
    place = np.full(len(low), -1, np.int64)
    at = np.flatnonzero(low < stop)
    low, high, want = low[at], stop[at], want[at]
    while len(at):
        middle = (low + high) >> 1
        found = value_at(middle)
        hit = found == want
        place[at[hit]] = middle[hit]
        under = found < want
        low, high = np.where(under, middle + 1, low), np.where(under, high, middle)
        open_ = np.flatnonzero((low < high) & ~hit)
        at, low, high, want = at[open_], low[open_], high[open_], want[open_]
    return place


def successor(values: np.ndarray, low: np.ndarray, stop: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of ``want`` within each ascending range [low, stop) of ``values``, or -1."""
    return search(lambda at: values[at], low, stop, want)
