"""Vectorised text primitives over Arrow buffers: words, hashes and ragged gathers, without Python strings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE = 1 << 18

_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POW.get(base)
    if got is None or len(got[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        got = _POW[base] = (pair[0], pair[1])
    return got


class Rolling:
    """Hashes of any span of a sequence of hashes: prefix sums of x[i] * base**i, modulo 2**64.

    For spans of up to a few dozen elements that are spread over 64 bits themselves (phrases of words). Long sequences
    over few values have collisions whatever the base; spans() is for those.
    """

    def __init__(self, x: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(x)
        up, self.down = _powers(base, n + 1)
        self.sums = np.zeros(n + 1, U)
        y = x.astype(U)
        y += U(1)
        y *= up[:n]
        np.cumsum(y, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= self.down[start]
        return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def _keys(place: np.ndarray, lane: int) -> np.ndarray:
    return mix((place.astype(U) * U(2) + U(lane + 1)) * U(0x9E3779B97F4A7C15)) | U(1)


#: Keys of the first places of a span, and what stands for each byte, by lane.
_KEYS = [_keys(np.arange(1 << 12), lane) for lane in (0, 1)]
_BYTES = [mix(np.arange(1, 257, dtype=U) * U(0xC2B2AE3D27D4EB4F) + U(lane)) for lane in (0, 1)]


def spans(x: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of spans that follow one another without overlap, of any length and any values (bytes, or 64-bit hashes).

    Multilinear: the sum, modulo 2**64, of each value by a pseudo-random key of its place in the span. Unlike powers of
    a base, keys have no relation among each other, so that no arrangement of few values makes sums agree. Two lanes.
    """
    if not len(start):
        return np.zeros(0, U)
    lo = start[0]
    x = x[lo : end[-1]]
    own, size = start - lo, end - start
    place = np.arange(len(x), dtype=np.int64)
    place -= np.repeat(own, np.diff(np.append(own, len(x))))
    # what is between spans has places too, which don't count
    y = _KEYS[lane][np.minimum(place, 4095, out=place)] if size.max() <= 4096 else _keys(place, lane)
    y *= _BYTES[lane][x] if x.dtype.itemsize == 1 else x
    sums = np.zeros(len(y) + 1, U)
    np.cumsum(y, out=sums[1:])
    return mix(sums[end - lo] - sums[own] + size.astype(U) * U(0xD6E8FEB86659FD93))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and the offset of each row and of the end; null is as empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows, in slices of about ``limit`` bytes of text."""
    for batch in batches:
        _, off = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ as start and end bytes, and the index of each row's first word (and the end)."""
    full = ~(((data - np.uint8(9)) < 5) | (data == 32))
    starts = full.copy()
    starts[1:] &= ~full[:-1]
    ends = full.copy()
    ends[:-1] &= ~full[1:]
    edge = off[(off > 0) & (off < len(data))]
    starts[edge] = full[edge]
    ends[edge - 1] = full[edge - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def ngrams(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, the row's first shingle, and the words' start of each shingle.

    A row with fewer words, but one at least, has its whole sequence as its only shingle.
    """
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(m, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1], m) + np.repeat(first[:-1], m)
    end = np.minimum(at + k, np.repeat(first[1:], m))
    return Rolling(w, 0xC2B2AE3D27D4EB4F).spans(at, end), out, at


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + length[i] - 1, for all i one after another."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)
