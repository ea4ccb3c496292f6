"""Many texts as one byte array: words, hashes and counts for all of them at once with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling hash, its inverse modulo 2^64, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_table(members: bytes | range, value: bool = True) -> np.ndarray:
    """256 flags that are ``value`` for the given bytes."""
    flags = np.full(256, not value)
    flags[list(members)] = value
    return flags


#: Every byte but ASCII white space: the words of documents.
WORD_BYTES = byte_table(b" \t\n\v\f\r", False)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; the longest table so far is kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(1 << max(16, int(n - 1).bit_length()), base, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


@dataclass
class Texts:
    """Texts one after another: bytes of text i are data[offsets[i]:offsets[i + 1]]. Null is empty."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if pa.types.is_null(column.type):
            return cls(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
        if column.null_count:
            column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, marks, data = column.buffers()
        offsets = np.frombuffer(marks, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
        offsets = offsets.astype(np.int64)
        if data is None:
            return cls(np.zeros(0, np.uint8), offsets - offsets[:1])
        return cls(np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """The text of each byte."""
        return np.repeat(np.arange(len(self)), self.lengths())

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.offsets))

    def pieces(self, inside: np.ndarray) -> Pieces:
        """Maximal runs of flagged bytes within a text."""
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return self.cut(starts, ends)

    def cut(self, starts: np.ndarray, ends: np.ndarray) -> Pieces:
        return Pieces(starts, ends, np.searchsorted(starts, self.offsets))

    def words(self) -> Pieces:
        return self.pieces(WORD_BYTES[self.data])

    def lines(self) -> Pieces:
        """The parts between line feeds; a text has one more than line feeds."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.offsets[1:]])
        text = np.concatenate([np.arange(len(self)), np.searchsorted(self.offsets, breaks, side="right") - 1])
        order = np.lexsort((starts, text))
        sizes = np.bincount(text, minlength=len(self))
        # Ends sorted within their text pair with the sorted starts.
        close = np.concatenate([np.searchsorted(self.offsets, breaks, side="right") - 1, np.arange(len(self))])
        return Pieces(starts[order], ends[np.lexsort((ends, close))], np.concatenate([[0], np.cumsum(sizes)]))

    def hashes(self, pieces: Pieces, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of the bytes of each piece."""
        data = self.data if data is None else data
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=total[1:])
        value = (total[pieces.ends] - total[pieces.starts]) * powers(INVERSE, len(data) + 1)[pieces.starts]
        return mix(value + (pieces.ends - pieces.starts).astype(np.uint64))


@dataclass
class Pieces:
    """Parts of texts: bytes starts[k]:ends[k]; those of text i are marks[i]:marks[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    marks: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.marks)

    def owner(self) -> np.ndarray:
        """The text of each piece."""
        return np.repeat(np.arange(len(self.marks) - 1), self.counts())

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value of each piece by text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[self.marks])


def windows(values: np.ndarray, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` values within a text, and the index of its first value."""
    if len(values) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(values) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out + values[k:k + n] * np.uint64(2 * k + 3)) if size > 2 else out + values[k:k + n] * np.uint64(0xD1342543DE82EF95 + 2 * k * k + 4 * k)
    owner = np.repeat(np.arange(len(marks) - 1), np.diff(marks))
    first = np.flatnonzero(owner[:n] == owner[size - 1:])
    return mix(out[first]), first
