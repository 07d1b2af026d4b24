"""Vectorised text primitives over Arrow string columns.

A chunk is ``(lo, hi, buf, offs)``: rows ``lo:hi`` of a record batch as one uint8 buffer whose row i
covers ``offs[i]:offs[i + 1]``.  Nulls read as empty texts.  Words are maximal runs of bytes other than
space and 0x09-0x0D, so they equal the code-point definition on UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 18


_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back, so that a waiting worker doesn't hold what its last batch needed."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: What operators keep in a worker from one task to the next.
KEPT: list[dict] = []


def forget() -> None:
    """Drop what other operators kept in this worker: it may have gone on to another stage."""
    for kept in KEPT:
        kept.clear()
    trim()


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return filled(batch.column(batch.schema.get_field_index(name)))


def filled(column: pa.Array) -> pa.Array:
    """A text column as large_string, nulls as empty texts."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a large_string array."""
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes; a longer row comes alone, whole."""
    data, offs = as_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    trim()


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        x = np.full(size, base, U64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=U64))
    return out[0], out[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x + U64(salt * 0x632BE59BD9B4E019 % (1 << 64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial sums; with :func:`span_hash` any substring hashes in constant time."""
    size = 1 << max(19, int(len(buf) + 1).bit_length())
    up, _ = _powers(size)
    acc = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=acc[1:])
    return acc


def span_hash(acc: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    size = 1 << max(19, int(len(acc)).bit_length())
    _, down = _powers(size)
    raw = (acc[end] - acc[start]) * down[start]
    return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93), salt)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word index (length rows + 1)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    at = offs[:-1][offs[:-1] < len(buf)]
    begin[at] = inside[at]
    finish[offs[1:] - 1] = inside[offs[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offs)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive hashes (ignoring row ends)."""
    if len(h) < width:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - width + 1, U64)
    for j in range(width):
        out = out * U64(0xFF51AFD7ED558CCD) + h[j : j + len(out)]
    return mix(out)


def per_row_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[offs[1:]] - acc[offs[:-1]]


def row_of(first: np.ndarray) -> np.ndarray:
    """Row index of every item, from each row's first item index."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows equal in ``keys`` (numbers without nulls) from batches sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(len(t), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != x for c, x in zip(cols, last))
        last = [c[-1] for c in cols]
        at = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > at:
                held.append(t.slice(at, cut - at))
            yield pa.concat_tables(held)
            held, at = [], cut
        held.append(t.slice(at))
    if held:
        yield pa.concat_tables(held)
        held.clear()
    trim()


def binary_array(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
