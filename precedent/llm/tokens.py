"""Words and their 64-bit hashes straight from Arrow string buffers.

A batch of texts is one byte buffer with offsets. Words are found with byte
masks and hashed with prefix sums of a polynomial over random byte values, so
no Python object is made per word. All functions work on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time (one longer text is handled alone).
SLICE = 4 << 20
_PIECE = 1 << 19  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

#: White space as the contracts define it: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters, digits and non-ASCII bytes.
NOT_ALNUM = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
#: All but ASCII letters and non-ASCII bytes.
NOT_LETTER = np.array([not (b >= 128 or chr(b).isalpha()) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Hasher:
    """Hashes byte spans; keeps its tables of powers."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_PIECE + 1)

    def spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span buf[start:end]; starts and ends ascend."""
        out = np.empty(len(starts), _U)
        i, n = 0, len(starts)
        while i < n:
            first = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, first + _PIECE, "right")))
            last = int(ends[j - 1])
            if last - first >= len(self.up):
                self.up, self.down = _powers(last - first + 1)
            sums = np.empty(last - first + 1, _U)
            sums[0] = 0
            np.cumsum(_BYTES[buf[first:last]] * self.up[: last - first], out=sums[1:])
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = mix((sums[b] - sums[a]) * self.down[a] + (b - a).astype(_U))
            i = j
        return out


class Texts(NamedTuple):
    """Some rows of a batch: bytes of their texts, and offsets of each."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def lower(self) -> Texts:
        """A-Z in lower case; nothing else changes."""
        return self._replace(buf=_LOWER[self.buf])


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    bound: np.ndarray  # words bound[i]:bound[i + 1] belong to text i

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))


def texts(col: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """Slices of a string column of at most ``limit`` bytes (or one text). A
    null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Texts(i, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def words(t: Texts, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators, inside each text."""
    if not len(t.buf):
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(t.n + 1, np.int64))
    sep = separator[t.buf]
    inside = ~sep
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= sep[:-1]
    closes[:-1] &= sep[1:]
    full = t.off[1:] > t.off[:-1]
    a, b = t.off[:-1][full], t.off[1:][full] - 1
    opens[a], closes[b] = inside[a], inside[b]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, t.off))


def per_doc(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums of values[bound[i]:bound[i + 1]]; 0 for empty ranges."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[bound[1:]] - sums[bound[:-1]]


def doc_keys(ids: np.ndarray) -> np.ndarray:
    """A 64-bit key per id."""
    return mix(ids.astype(np.int64).view(_U) + _U(_BASE))


def id_array(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 (0 where null) and the null mask."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.fill_null(0)).astype(np.int64), np.asarray(col.is_null())
