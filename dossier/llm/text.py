"""Whole texts as flat byte arrays: words, hashes and n-grams without a Python loop over words.

A block is a run of documents whose UTF-8 bytes lie one after another.  A word is a maximal run of
``[^\\x20\\x09-\\x0D]+``.  Null texts count as empty.  All hashes are 64 bits wide: a polynomial over a
fixed random byte table modulo 2**64, then mixed, so a false match needs about 2**32 different values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U64) | U64(1)
_BASE = int(_RNG.integers(0, 2**64, dtype=U64)) | 5
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = int(_RNG.integers(0, 2**64, dtype=U64)) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 20), base, U64)
        out[0] = 1
        have = _POWERS[base] = np.cumprod(out, dtype=U64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def raw_strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and where each value starts (one more than there are values)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = arr.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``most`` bytes of text each; a longer text comes alone and whole."""
    for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        _, offsets = raw_strings(part.column(column))
        i, n = 0, len(part)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield part.slice(i, j - i)
            i = j


class Block:
    """Documents laid end to end, with their words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.raw, self.offsets = raw_strings(texts)
        self.n = len(self.offsets) - 1
        if lower:
            self.raw = _LOWER[self.raw]
        raw, size = self.raw, len(self.raw)
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        word = ~_SPACE[raw]
        before = np.empty(size, bool)
        if size:
            before[0] = False
            before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (edge[:size] | ~before))
        after = np.empty(size, bool)
        if size:
            after[-1] = False
            after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each document, its first word
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One hash per word."""
        return self.hash_spans(self.starts, self.ends)

    def prefix(self) -> np.ndarray:
        if not hasattr(self, "_prefix"):
            self._prefix = np.zeros(len(self.raw) + 1, U64)
            np.cumsum(_BYTE[self.raw] * powers(_BASE, len(self.raw)), dtype=U64, out=self._prefix[1:])
        return self._prefix

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per byte span; equal bytes have equal hashes in every block."""
        p = self.prefix()
        h = (p[ends] - p[starts]) * powers(_BASE_INV, len(self.raw) + 1)[starts]
        return mix(h + (ends - starts).astype(U64))

    def owner(self) -> np.ndarray:
        """Of each word, the place of its document in the block."""
        return np.repeat(np.arange(self.n), self.counts)

    def grams(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (places of words) and hashes of all windows of ``size`` words inside one document."""
        total = len(hashes) - size + 1
        if total <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        last = np.repeat(self.first[1:], self.counts)
        ok = np.flatnonzero(np.arange(total) + size <= last[:total])
        return ok, window_hash(hashes, size)[ok]


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` neighbouring values."""
    total = len(hashes) - size + 1
    out, times = np.zeros(total, U64), 1
    for j in range(size):
        out += hashes[j : j + total] * U64(times)
        times = times * _STEP % 2**64
    return mix(out)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a window of ``length`` places that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1) if len(starts) < 64 else edge.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32)[: n + 1])
    stop = np.minimum(starts + length, n)
    edge -= np.bincount(stop, minlength=n + 1).astype(np.int32)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Valid UTF-8 bytes and where each value starts, as a string array."""
    kind, width = (pa.string(), np.int32) if len(data) < 2**31 - 1 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(width))), pa.py_buffer(np.ascontiguousarray(data))])


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true flags that don't cross ``offsets``: start, end, and the number of runs per part."""
    n = len(flags)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
    prev[1:], nxt[:-1] = flags[:-1], flags[1:]
    start = np.flatnonzero(flags & (edge[:n] | ~prev))
    end = np.flatnonzero(flags & (edge[1:] | ~nxt)) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


SPANS_SQL = "array<struct<start:int,length:int>>"


def spans(start: np.ndarray, end: np.ndarray, counts: np.ndarray, base: np.ndarray) -> pa.Array:
    """Runs as one list of (start, length) per part, counted from the part's ``base``."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array((start - np.repeat(base, counts)).astype(np.int32)), pa.array((end - start).astype(np.int32))], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(at), items)
