"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item leaks into a document if some run of the document's words is within floor(``rate`` * words) word edits of
the item (rate 0.2: a similarity of 0.8 or more).  The CGK random walk copies a word of the sequence again and
again until a random bit, drawn from step and word, moves it on; sequences at small edit distance then differ in few
places.  Windows of an item's size are embedded by ``walks`` shared walks; each of ``rounds`` hash tables samples
``sampled`` places of one walk, and a window that agrees with the item in any table is a candidate.  Candidates
are verified by the exact edit distance of the item to the best run of words there (bit-parallel).

Windows are not taken everywhere: with at most t edits, one of t + 1 equal pieces of an item survives unchanged
(pigeonhole), so only windows within t words of such a piece, in place, can match, and only those are embedded.
The benchmark is a stated set of queries: it goes to all tasks in blocks of at most ``item_bytes``.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  Defined results: null texts and items have no words and
match nothing; equal rows give equal results; of several matches of an item in a document the closest, then the first
is told; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, Block, mix, slices, window_hash

#: Embedded words at a time.
PORTION = 1 << 21
LEAKS = "doc_id long, item_id long, word_start long, word_end long, edits int, item_words int"


def cgk(words: np.ndarray, sizes: np.ndarray, steps: int, salt: int) -> np.ndarray:
    """Embed each row (word hashes, ``sizes`` of them in use) as ``steps`` hashes; 0 once the row is used up."""
    n, width = words.shape
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.zeros((n, steps), U64)
    for j in range(steps):
        on = at < sizes
        w = np.where(on, words[rows, np.minimum(at, width - 1)], U64(0))
        out[:, j] = w
        at += on & ((mix(w ^ U64((salt * 0x9E3779B97F4A7C15 + j * 0xD1B54A32D192ED03) % 2**64)) >> U64(63)) == 1)
    return out


def edit_search(item: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Least edits from the item to any run of ``text`` and where the first such run ends; (most + 1, 0) if none."""
    m, masks = len(item), {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, most + 1, 0
    if m <= most:
        best, end = m, 0
    for k, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


def _begin(item: list[int], text: list[int], end: int, edits: int) -> int:
    """The last start of a run that ends at ``end`` and is ``edits`` away from the item."""
    if not edits:
        return end - len(item)
    row = list(range(len(item) + 1))  # edits between the item's last i words and the run so far, read backwards
    if row[-1] == edits:
        return end
    for k in range(1, end + 1):
        w, last, row[0] = text[end - k], row[0], k
        for i in range(1, len(item) + 1):
            keep = row[i]
            row[i] = min(last + (item[-i] != w), row[i] + 1, row[i - 1] + 1)
            last = keep
        if row[-1] == edits:
            return end - k
    return 0


class _Items:
    """Benchmark items with their pieces and embeddings."""

    def __init__(self, rows: list[tuple[int, str]], rate: float, walks: int, rounds: int, sampled: int):
        block = Block(pa.array([t for _, t in rows], pa.string()), lower=True)
        h = block.hashes()
        self.ids = [i for i, _ in rows]
        self.words = [h[a:b] for a, b in zip(block.first[:-1], block.first[1:])]
        self.size = block.counts
        self.most = np.floor(self.size * rate + 1e-9).astype(np.int64)
        self.walks, self.rounds, self.sampled = walks, rounds, sampled
        pieces: dict[int, list[tuple[int, int, int]]] = {}  # by length of piece: hash, item, offset
        for i, w in enumerate(self.words):
            if len(w):
                cuts = np.linspace(0, len(w), int(self.most[i]) + 2).astype(int)
                q = int(np.diff(cuts).min())
                pieces.setdefault(q, []).extend((int(window_hash(w[a : a + q], q)[0]), i, int(a)) for a in cuts[:-1])
        self.pieces = {}
        for q, found in pieces.items():
            found.sort()
            key = np.array([f[0] for f in found], U64)
            seen = np.zeros(1 << 20, bool)
            seen[(key >> U64(44)).astype(np.int64)] = True
            self.pieces[q] = key, np.array([f[1] for f in found]), np.array([f[2] for f in found]), seen
        self.embedded: dict[int, list[np.ndarray]] = {}

    def sample(self, item: int) -> list[np.ndarray]:
        """The places that each table looks at, and there the item's own embedding."""
        if item not in self.embedded:
            m, w = int(self.size[item]), self.words[item][None]
            own = [cgk(w, np.array([m]), 3 * m, s)[0] for s in range(self.walks)]
            rng = np.random.Generator(np.random.PCG64(m))
            places = [rng.integers(0, 2 * m, self.sampled) for _ in range(self.rounds)]
            self.embedded[item] = [own, places]
        return self.embedded[item]

    def near(self, item: int, words: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which of the windows at ``starts`` (inside documents lo..hi) share a table entry with the item."""
        m = int(self.size[item])
        step = max(1, PORTION // (2 * m))
        if len(starts) > step:  # an item of many words that hits a text often: by portions, so that memory stays bounded
            parts = [slice(i, i + step) for i in range(0, len(starts), step)]
            return np.concatenate([self.near(item, words, starts[p], lo[p], hi[p]) for p in parts])
        own, places = self.sample(item)
        at = np.clip(starts, lo, np.maximum(lo, hi - 1))
        size = np.minimum(m, hi - at)
        grid = words[np.minimum(at[:, None] + np.arange(m), len(words) - 1)]
        ok = np.zeros(len(starts), bool)
        for s in range(self.walks):
            walk = cgk(grid, size, 2 * m, s)
            for p in places[s :: self.walks]:
                ok |= (walk[:, p] == own[s][p]).all(1)
        return ok


def _blocks(benchmark: DataFrame, item_bytes: int, how: tuple) -> Iterator[_Items]:
    """The benchmark in blocks of about ``item_bytes`` of text."""
    items = benchmark.select("item_id", "text").dropna()
    blocks = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield _Items(sorted((r[0], r[1]) for r in part.collect()), *how)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.2, walks: int = 4, rounds: int = 32, sampled: int = 2, item_bytes: int = 4 << 20) -> DataFrame:
    """One row per document and item that leaks into it: the closest run of words and its edits."""
    found = []
    for held in _blocks(benchmark, item_bytes, (rate, walks, rounds, sampled)):

        def search(batches: Iterator[pa.RecordBatch], held: _Items = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, "text"):
                    rows = _search(piece, held)
                    ids = piece.column("doc_id").to_pylist()
                    c = list(zip(*((ids[r[0]], *r[1:]) for r in rows))) or [()] * 6
                    yield pa.record_batch([*(pa.array(v, pa.int64()) for v in c[:4]), *(pa.array(v, pa.int32()) for v in c[4:])], names=["doc_id", "item_id", "word_start", "word_end", "edits", "item_words"])

        found.append(docs.select("doc_id", "text").mapInArrow(search, LEAKS))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.2, walks: int = 4, rounds: int = 32, sampled: int = 2, item_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without the rows that an item leaks into; all columns stay."""
    for held in _blocks(benchmark, item_bytes, (rate, walks, rounds, sampled)):

        def clean(batches: Iterator[pa.RecordBatch], held: _Items = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, "text"):
                    keep = np.ones(len(piece), bool)
                    keep[[r[0] for r in _search(piece, held)]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def _search(part: pa.RecordBatch, held: _Items) -> list[tuple[int, int, int, int, int, int]]:
    """Leaks into the rows of a batch, by place of the row."""
    block = Block(part.column("text"), lower=True)
    words, n = block.hashes(), len(block.starts)
    hits: dict[int, set[tuple[int, int]]] = {}
    owner = block.owner()
    for q, (key, item, offset, seen) in held.pieces.items():
        if n < q:
            continue
        g = window_hash(words, q)
        at = np.flatnonzero(seen[(g >> U64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(key, g[at]), np.searchsorted(key, g[at], "right")
        times = hi - lo
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(lo, times) + nth
        start = np.repeat(at, times) - offset[entry]
        for i, s, d in zip(item[entry].tolist(), start.tolist(), owner[np.repeat(at, times)].tolist()):
            hits.setdefault(i, set()).add((s, d))
    rows: dict[tuple[int, int], tuple[int, int, int]] = {}
    data = None
    for i, starts in hits.items():
        m, t = int(held.size[i]), int(held.most[i])
        s, d = np.array(sorted(starts)).T
        lo, hi = block.first[d], block.first[d + 1]
        shift = np.arange(-t, t + 1)
        near = held.near(i, words, (s[:, None] + shift).ravel(), np.repeat(lo, len(shift)), np.repeat(hi, len(shift))).reshape(len(s), -1).any(1)
        data = words.tolist() if data is None and near.any() else data
        for k in np.flatnonzero(near).tolist():
            a, b = max(int(lo[k]), int(s[k]) - t), min(int(hi[k]), int(s[k]) + m + t)
            own, text = held.words[i].tolist(), data[a:b]
            edits, end = edit_search(own, text, t)
            if edits <= t:
                new = (edits, a + _begin(own, text, end, edits) - int(lo[k]), a + end - int(lo[k]))
                key = (int(d[k]), i)
                rows[key] = min(rows.get(key, new), new)
    return [(d, held.ids[i], b, e, x, int(held.size[i])) for (d, i), (x, b, e) in rows.items()]
