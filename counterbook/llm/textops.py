"""Vectorised text primitives over Arrow string columns.

A column is worked on in slices of a few MB, so a task's memory depends on
the slice (or on the one longest text), not on its partition. Texts are seen as
UTF-8 bytes; word and line hashes come from prefix sums of a polynomial hash,
so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def byte_table(seed: int = 11) -> np.ndarray:
    """A random 64-bit value per byte value."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


#: The white space of the word pattern [^\x20\x09-\x0D]+
SPACE = class_table(b" \t\n\x0b\x0c\r")


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (in place where possible)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            m = max(n + 1, SLICE_BYTES)
            inverse = np.uint64(pow(int(BASE), -1, 2**64))
            for name, base in (("up", BASE), ("down", inverse)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up, self.down


def strings(col: pa.Array) -> pa.Array:
    """A plain string array; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with
    about ``limit`` bytes of text together; a longer text is a slice of its own."""
    col = strings(col)
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, whole[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Hasher:
    """64-bit hashes of byte ranges of one slice."""

    def __init__(self, data: np.ndarray, table: np.ndarray, powers: Powers):
        self.powers = powers
        up, self.down = powers.upto(len(data))
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        t = table[data]
        t *= up[: len(data)]
        np.cumsum(t, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end]
        h -= self.sums[start]
        h *= self.down[start]
        h += (end - start).astype(np.uint64)
        return mix(h)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of True bytes that do not cross text borders: (start, end,
    first range of each text, one more than texts)."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[1:n] = ~inside[:-1]
    first[offsets] = True
    start = np.flatnonzero(first[:n] & inside)
    last = np.ones(n, bool)
    if n:
        last[:-1] = ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        last[inner - 1] = True
        last[n - 1] = True
    end = np.flatnonzero(last & inside) + 1
    return start, end, np.searchsorted(start, offsets)


def counts(mask: np.ndarray) -> np.ndarray:
    """Prefix counts of a byte mask, to be differenced at range borders."""
    out = np.empty(len(mask) + 1, np.int64)
    out[0] = 0
    np.cumsum(mask, out=out[1:])
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each range, from ``runs``' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def lower_az(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def line_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Lines of ``text.split("\n")``, empty ones and the last included: (start, end, first line of each text)."""
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], cut]), kind="stable")
    per_text = 1 + np.diff(np.searchsorted(cut, offsets))
    return start, end, np.concatenate([[0], np.cumsum(per_text)])
