"""Vectorised text primitives shared by the corpus operators.

Documents arrive as Arrow string columns. All work is done on the UTF-8 bytes
of many documents at once with numpy: splitting into words, hashing words and
runs of words, and picking content-determined anchors. Nothing here depends
on the process, so a task that is run again gives the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
M1, M2, M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
#: Text is handled in blocks of about this many bytes, so that temporaries stay small.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x *= M1
    x ^= x >> U64(27)
    x *= M2
    x ^= x >> U64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair (a, b)."""
    return mix(a * M3 + (b ^ (b >> U64(32))) * M2 + M1)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    else:
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes; a longer document is a range of its own."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def byte_set(pattern: str) -> np.ndarray:
    """Membership table of the bytes that a class of latin-1 characters holds."""
    table = np.zeros(256, bool)
    table[list(pattern.encode("latin-1"))] = True
    return table


#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = byte_set(" \t\n\x0b\x0c\r")
#: Bytes outside [0-9A-Za-z] and below 0x80.
NOT_ALNUM = np.array([not (b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a block of documents: byte spans, and for document d the words first[d] to first[d + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def split_words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes outside `gap`; none crosses from one document to the next."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offs), np.int64))
    word = ~gap[buf]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    cuts = offs[1:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    begin[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(start, end, np.searchsorted(start, offs))


def load64(buf: np.ndarray) -> np.ndarray:
    """At each byte, the 8 bytes that start there as one integer; zeros follow the end."""
    x = np.zeros(len(buf) + 8, U64)
    x[: len(buf)] = buf
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << U64(8 * step)
    return x[: len(buf)]


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    if not len(start):
        return np.zeros(0, U64)
    eight, size = load64(buf), end - start
    h = mix(size.astype(U64) * M3 + U64(1))
    h = pair(h, eight[start] & _MASK[np.minimum(size, 8)])
    at, more = start + 8, np.flatnonzero(size > 8)
    while len(more):
        h[more] = pair(h[more], eight[at[more]] & _MASK[np.minimum(end[more] - at[more], 8)])
        at = at + 8
        more = more[end[more] > at[more]]
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols from each position on; the last n - 1 positions are left out."""
    if len(h) < n:
        return np.zeros(0, U64)
    parts, size, done, out = h, 1, 0, None
    while True:
        if n & size:
            out = parts[: len(h) - n + 1].copy() if out is None else pair(out, parts[done : done + len(h) - n + 1])
            done += size
        size *= 2
        if size > n:
            return out
        parts = pair(parts[: -(size // 2)], parts[size // 2 :])


def byte_grams(buf: np.ndarray, n: int) -> np.ndarray:
    """grams() of single bytes for n a multiple of 8."""
    if len(buf) < n:
        return np.zeros(0, U64)
    eight, size = load64(buf), len(buf) - n + 1
    h = mix(eight[:size] + M3)
    for at in range(8, n, 8):
        h = pair(h, eight[at : at + size])
    return h


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def inside(first: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask over `total` symbols: does a window of `length` symbols that starts here stay in its document?"""
    ok = np.zeros(total + 1, np.int32)
    n = np.diff(first)
    has = n >= length
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[1:][has] - length + 1, -1)
    return np.cumsum(ok[:total]) > 0


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def covered(start: np.ndarray, end: np.ndarray, total: int) -> np.ndarray:
    """Mask of the positions that lie in any span [start, end)."""
    depth = np.zeros(total + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:total]) > 0


def order_key(doc_id: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Document ids as integers; a null id comes after all others."""
    if isinstance(doc_id, pa.ChunkedArray):
        doc_id = doc_id.combine_chunks()
    return pc.fill_null(doc_id.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def fits_column(size: int) -> None:
    """Arrow's strings hold 2 GB a chunk; rather an error than offsets that wrap."""
    if size >= 1 << 31:
        raise OverflowError("a chunk's texts exceed 2 GB; give a smaller chunk_bytes")


def pack(values: np.ndarray, width: int) -> bytes:
    """Integers as their `width` low bytes, byte planes apart, so that equal high bytes compress well."""
    v = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return v[:, :width].T.tobytes()


def unpack(data: bytes | memoryview, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()
