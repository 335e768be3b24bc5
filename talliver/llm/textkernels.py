"""Vectorised text helpers that run inside Arrow tasks.

All functions look at a batch of texts as one UTF-8 byte buffer plus document
offsets.  Separators of every tokenisation used here are ASCII, so splitting
the bytes gives the same words as splitting the code points.  A null text is
an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled on its own.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_STEPS = [(0xD6E8FEB86659FD93 * (2 * j + 1) ^ (0xA0761D6478BD642E * j << 1)) & (2**64 - 1) | 1 for j in range(64)]
_powers: dict[str, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def separator_table(pattern_bytes: bytes) -> np.ndarray:
    """A 256-entry table that is 1 for the bytes which separate words."""
    table = np.zeros(256, np.uint8)
    table[list(pattern_bytes)] = 1
    return table


#: Words are [^\x20\x09-\x0D]+
SPACE = separator_table(b" \t\n\v\f\r")
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = separator_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied to an uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Give freed memory back to the system: workers are used again, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)
    trim()


class Words:
    """Words of a batch: hash, document and byte span of each.

    ``hash`` uint64, ``doc`` int64 row in the batch, ``start`` and ``end``
    bytes in ``raw``, ``first`` the word index where each document begins
    (n + 1 entries).
    """

    def __init__(self, column: pa.Array, separators: np.ndarray, lower: bool):
        raw, offsets = text_buffer(column)
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        used = LOWER[raw] if lower else raw
        inside = separators[used] == 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        prev = np.zeros(n, bool)
        prev[1:] = inside[:-1]
        nxt = np.zeros(n, bool)
        nxt[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~prev | edge[:-1]))
        self.end = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
        up, down = _power_tables(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((used.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * down[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(_STEPS[40]))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        return self.raw[self.start[i] : self.end[j - 1]].tobytes()


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and the index of their first word."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words.hash[: n - k + 1] * np.uint64(_STEPS[0])
        for j in range(1, k):
            h += words.hash[j : n - k + 1 + j] * np.uint64(_STEPS[j])
        h = mix(h)
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    return h[at], at


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole word sequence (as ``windows`` gives for k = its length)."""
    with np.errstate(over="ignore"):
        total = np.uint64(len(hashes))
        for j, x in enumerate(hashes):
            total += x * np.uint64(_STEPS[j % 64])
        return mix(np.array([total]))[0]


class KeyLines:
    """Lines of a batch (split at LF) and their keys: stripped of ``spaces``, A-Z in lower case.

    ``hash`` uint64, ``length`` code points and ``doc`` of each key, ``first``
    the line index where each text begins (n + 1 entries).  A null or empty
    text is one empty line.
    """

    def __init__(self, column: pa.Array, spaces: np.ndarray):
        raw, offsets = text_buffer(column)
        n = len(raw)
        feed = np.flatnonzero(raw == 10)
        # Every text has one line more than feeds; lines of all texts in order.
        per = np.searchsorted(feed, offsets)
        self.first = per + np.arange(len(offsets))
        counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        total = int(self.first[-1])
        starts, ends = np.zeros(total, np.int64), np.zeros(total, np.int64)
        inner = np.ones(total, bool)
        inner[self.first[:-1]] = False
        starts[inner], starts[self.first[:-1]] = feed + 1, offsets[:-1]
        last = np.ones(total, bool)
        last[self.first[1:] - 1] = False
        ends[last], ends[self.first[1:] - 1] = feed, offsets[1:]
        self.raw, self.low = raw, LOWER[raw]
        self.starts, self.ends = starts, ends
        solid = spaces[raw] == 0
        at = np.flatnonzero(solid)
        a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
        some = b > a
        self.start, self.end = starts.copy(), starts.copy()
        self.start[some], self.end[some] = at[a[some]], at[b[some] - 1] + 1
        points = np.zeros(n + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        self.length = points[self.end] - points[self.start]
        up, down = _power_tables(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * down[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(_STEPS[41]))

    def key(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def kept(self, text: int, keep: np.ndarray) -> str:
        """The lines of a text whose ``keep`` is set."""
        lo, hi = self.first[text], self.first[text + 1]
        if keep[lo:hi].all():
            return self.raw[self.starts[lo] : self.ends[hi - 1]].tobytes().decode()
        return b"\n".join(self.raw[self.starts[i] : self.ends[i]].tobytes() for i in range(lo, hi) if keep[i]).decode()
