"""Words, hashes and shingles of whole Arrow batches of text, vectorised over all documents of a batch.

NULL texts count as empty. A batch is cut at document borders into pieces of about ``PIECE`` bytes, so that memory does
not follow the number of rows in a batch; a single longer document is a piece of its own and never cut.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

#: ASCII white space as in the pattern [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same, and ASCII punctuation.
BREAK = SPACE.copy()
BREAK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS: dict = {}


def _powers(n: int):
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if _POWERS.get("n", 0) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    size = max(n, PIECE + 64)
    up, down = np.full(size, _ODD), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= 8 * PIECE:     # those of a very long text go with it
        _POWERS.update(n=size, up=up, down=down)
    return up[:n], down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for every span; the same content hashes alike wherever it stands."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return what earlier tasks of this Python worker have freed to the system; workers live on through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):      # other C libraries
        pass


def pieces(batches, text: str = "text", limit: int = PIECE):
    """``(batch, bytes, offsets)`` with about ``limit`` bytes of text or 4096 rows each, whole documents only."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), first + 4096, batch.num_rows)
            low, high = offsets[first], offsets[last]
            yield batch.slice(first, last - first), data[low:high], offsets[first:last + 1] - low
            first = last
    give_back()


class Words:
    """Words of some documents: ``start``, ``end`` (bytes), ``doc`` (row), ``hash``; ``first`` and ``count`` per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE):
        rows = len(offsets) - 1
        inside = ~breaks[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = np.diff(offsets) > 0
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = span_hashes(_BYTE[LOWER[data]], self.start, self.end)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of ``n`` words; of a shorter text, the whole sequence as one."""
        return window_shingles(self.hash, self.doc, self.count, self.first, n)


def window_shingles(hashes, group, count, first, n):
    """Shingles of words that belong to consecutive ``group`` numbers with ``count`` words from ``first`` on."""
    total = len(hashes)
    place = np.arange(total) - first[group]
    size = count[group]
    keep = np.flatnonzero((place + n <= size) | ((place == 0) & (size < n)))
    out = np.zeros(len(keep), np.uint64)
    for k in range(n):
        at = keep + k
        inside = place[keep] + k < size[keep]
        word = np.where(inside, hashes[np.minimum(at, total - 1)], np.uint64(0))
        out = out * np.uint64(0xD6E8FEB86659FD93) + word
        out ^= out >> np.uint64(32)
    return mix(out), keep


def distinct_sets(hashes: np.ndarray, group: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every group, one after another, with ``rows + 1`` offsets. ``group`` ascends."""
    borders = np.searchsorted(group, np.arange(rows + 1))
    parts = [np.unique(hashes[a:b]) for a, b in zip(borders[:-1], borders[1:])]
    sizes = np.fromiter((len(p) for p in parts), np.int64, rows)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Row i holds the raw bytes of ``values[offsets[i]:offsets[i + 1]]``."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer((offsets * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
