"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``block`` words, which form the index; every rolling
window of ``block`` words probes it.  A window of ``window`` = 2 * block - 1 words holds a whole block of
whatever document it comes from, so no repeat is missed.  Probes that hit are extended: the full windows
around hits are compared by a 64-bit hash, the smallest document with each window is found, and neighbouring
repeated windows join into maximal repeats.

The index is dealt into buckets by hash (see exchange.py).  First exchange: distinct probes of a chunk, four
bytes each, come back with one bit each (is there such a block, and another occurrence?).  Second exchange:
only windows around hits, with the smallest document of the chunk, come back with one bit each (has any
smaller document this window?).

Defined results: a null text has no words; a document shorter than the window keeps all its words; rows with
the same doc_id are one another's equals, so neither removes words from the other; a null doc_id neither
removes nor loses words; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import CHUNK_BYTES, answered, ask, bodies, bucket_edges, deal, materialize, messages, read_back, sizes_for
from .text import SPANS_SQL, U64, Block, covered, runs, spans, strings

SCHEMA = f"doc_id long, n_words long, n_removed long, kept_text string, removed {SPANS_SQL}"
_LOW = U64(0xFFFFFFFF)


def _bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _unbits(raw: memoryview, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).view(bool)


class _Chunk:
    """The documents of one chunk, their probes and, once replies are there, their windows."""

    def __init__(self, table: pa.Table, block: int, buckets: int):
        self.table = table.combine_chunks()
        self.chunk = self.table.column("chunk")[0].as_py()
        self.text = Block(self.table.column("text"))
        ids = self.table.column("doc_id")
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.words = self.text.hashes()
        self.block, self.window = block, 2 * block - 1
        self.owner = self.text.owner()
        at, grams = self.text.grams(self.words, block)
        long = (self.text.counts >= self.window) & self.known
        ok = long[self.owner[at]]
        self.at, grams = at[ok], grams[ok]
        self.keys, self.which, self.times = np.unique(grams, return_inverse=True, return_counts=True)
        self.edges = bucket_edges(self.keys, buckets)

    def probes(self) -> pa.Table:
        aligned = (self.at - self.text.first[self.owner[self.at]]) % self.block == 0
        indexed = np.zeros(len(self.keys), bool)
        indexed[self.which[aligned]] = True
        low, many = (self.keys & _LOW).astype(np.uint32), self.times > 1
        return messages(self.chunk, self.edges, lambda a, b: np.uint32(b - a).tobytes() + low[a:b].tobytes() + _bits(indexed[a:b]) + _bits(many[a:b]))

    def windows(self, replies: pa.Table, buckets: int) -> None:
        """The full windows that hold a probe which hit."""
        hit = np.zeros(len(self.keys), bool)
        for b, _, body in bodies(replies):
            a, e = self.edges[b], self.edges[b + 1]
            hit[a:e] = _unbits(body, e - a)
        n = len(self.words)
        live = np.zeros(n + 1, np.int32)
        live[1 + self.at[hit[self.which]]] = 1
        live = np.cumsum(live)
        at, grams = self.text.grams(self.words, self.window)
        ok = live[np.minimum(at + self.block, n)] > live[at]
        self.at2, grams = at[ok], grams[ok]
        self.docs2 = self.ids[self.owner[self.at2]]
        self.keys2, self.which2 = np.unique(grams, return_inverse=True)
        self.least = np.full(len(self.keys2), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which2, self.docs2)
        self.edges2 = bucket_edges(self.keys2, buckets)

    def candidates(self) -> pa.Table:
        return messages(self.chunk, self.edges2, lambda a, b: np.uint32(b - a).tobytes() + self.keys2[a:b].tobytes() + self.least[a:b].tobytes())

    def result(self, replies: pa.Table) -> pa.Table:
        earlier = np.zeros(len(self.keys2), bool)
        for b, _, body in bodies(replies):
            a, e = self.edges2[b], self.edges2[b + 1]
            earlier[a:e] = _unbits(body, e - a)
        gone = earlier[self.which2] | (self.docs2 > self.least[self.which2])
        t = self.text
        removed = covered(len(self.words), self.at2[gone], self.window)
        size = len(t.raw)
        kept = np.flatnonzero(~removed)
        byte = np.zeros(size + 1, np.int8)
        byte[t.starts[kept]] += 1
        byte[t.ends[kept]] -= 1
        mask = np.cumsum(byte)[:size] > 0
        follows = kept[:-1][self.owner[kept[:-1]] == self.owner[kept[1:]]] if len(kept) else kept  # kept words with another kept one behind
        raw = t.raw.copy()
        raw[t.ends[follows]] = 32
        mask[t.ends[follows]] = True
        out = np.concatenate([[0], np.cumsum(mask)])[t.offsets]
        start, end, counts = runs(removed, t.first)
        gone_per = np.diff(np.concatenate([[0], np.cumsum(removed)])[t.first])
        columns = [self.table.column("doc_id").combine_chunks(), pa.array(t.counts), pa.array(gone_per), strings(raw[mask], out), spans(start, end, counts, t.first[:-1])]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])


def _index(table: pa.Table) -> pa.Table:
    """For one bucket: which probes meet an indexed block and occur more than once."""
    keys, indexed, many, parts = [], [], [], []
    for b, c, body in bodies(table):
        n = int(np.frombuffer(body, np.uint32, 1)[0])
        w = (n + 7) // 8
        keys.append(np.frombuffer(body, np.uint32, n, 4))
        indexed.append(_unbits(body[4 + 4 * n : 4 + 4 * n + w], n))
        many.append(_unbits(body[4 + 4 * n + w :], n))
        parts.append((b, c, n))
    u, which, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    block, often = np.zeros(len(u), bool), times > 1
    block[which[np.concatenate(indexed)]] = True
    often[which[np.concatenate(many)]] = True
    return _replies(parts, (block & often)[which])


def _first(table: pa.Table) -> pa.Table:
    """For one bucket: which windows a smaller document of another chunk has."""
    keys, least, parts = [], [], []
    for b, c, body in bodies(table):
        n = int(np.frombuffer(body, np.uint32, 1)[0])
        keys.append(np.frombuffer(body, U64, n, 4))
        least.append(np.frombuffer(body, np.int64, n, 4 + 8 * n))
        parts.append((b, c, n))
    own = np.concatenate(least)
    u, which = np.unique(np.concatenate(keys), return_inverse=True)
    first = np.full(len(u), np.iinfo(np.int64).max)
    np.minimum.at(first, which, own)
    return _replies(parts, first[which] < own)


def _replies(parts: list[tuple[int, int, int]], flags: np.ndarray) -> pa.Table:
    ends = np.cumsum([n for _, _, n in parts])
    return pa.table({"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "chunk": pa.array([c for _, c, _ in parts], pa.int32()), "body": pa.array([_bits(flags[e - n : e]) for e, (_, _, n) in zip(ends, parts)], pa.binary())})


def substring_dedup(docs: DataFrame, *, block: int = 7, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Words left of every document once repeats of 2 * block - 1 words from smaller documents are gone.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and removed (maximal removed
    runs as word start and length).
    """
    n, m = sizes_for(docs, per=chunk_bytes)
    dealt = deal(docs, n, "doc_id", "text")

    def second(table: pa.Table, replies: pa.Table) -> _Chunk:
        c = _Chunk(table, block, m)
        c.windows(replies, m)
        return c

    probes = materialize(ask(dealt, n, m, lambda t: _Chunk(t, block, m).probes(), _index))  # a bit per key; both later steps read it
    sent = read_back(dealt, probes, n, lambda t, r: second(t, r).candidates() if len(t) else _none(), "bucket int, chunk int, body binary")
    firsts = answered(sent, n, m, _first)
    both = probes.unionByName(firsts.selectExpr("-1 - bucket as bucket", "chunk", "body"))

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.combine_chunks()
        b = replies.column("bucket").to_numpy()
        late = pa.table({"bucket": pa.array(-1 - b[b < 0], pa.int32()), "chunk": replies.column("chunk").filter(pa.array(b < 0)), "body": replies.column("body").filter(pa.array(b < 0))})
        return second(table, replies.filter(pa.array(b >= 0))).result(late)

    return read_back(dealt, both, n, finish, SCHEMA)


def _none() -> pa.Table:
    return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
