"""Language-model scoring by a weighted backoff automaton.

Training documents give counts of all n-grams up to ``order``.  The model interpolates from short to long contexts:
p(w) = (c(w) + 1) / (N + V + 1), one share being left for unknown words, and
p(w | h) = (c(hw) + mu * p(w | h')) / (c(h) + mu), where h' is h without its first token; each p sums to 1.
As an automaton: states are the contexts of up to ``order`` - 1 tokens seen in training, numbered, the empty one first.
From a state an arc leads for each token seen behind it to the state of the longest seen context that ends there, with
log10 of the above as weight; a failure arc of weight log10(mu / (c(h) + mu)) leads to the state of the shorter context.
A text is read once from left to right: the carried state takes the next token's arc, or failure arcs until one of its
states has such an arc, and their weights add up.  Several strengths mu are carried at once (the states are the same, the weights
are not), and a text's probability is the mean of those it has under each.

Many texts step side by side, as arrays of states.  A long text is cut into segments of SEGMENT tokens, each entered ``order`` - 1
tokens early: as a state reaches back no further, the state is then the one that the whole text would have carried there.

The automaton of a whole corpus fits nowhere, so each chunk builds the part that its own texts can reach: it sends its
distinct n-grams with their counts to buckets, which add the counts of all chunks and reply with the sums (see
exchange.py).  All counts cover all training documents, none is pruned.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end token per document.  Defined results: a null
text is an empty one (its only token is the end); a null doc_id is held in training as crc32 of an empty string; rows
with equal doc_id are scored each; without any training document every token has probability 1 / 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import CHUNK_BYTES, MESSAGE, ask, bodies, bucket_edges, deal, materialize, read_back, sizes_for
from .text import U64, Block, mix

_END, _START = U64(0x6C8E9CF570932BD5), U64(0xB5297A4D3F84D5A1)
_STEP = U64(0xD6E8FEB86659FD93)
SEGMENT = 128
#: In place of a chunk in the reply that holds a bucket's tokens and distinct words.
TOTALS = -1
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pack(counts: np.ndarray) -> bytes:
    """Counts in the smallest whole bytes that hold them, width first."""
    top = int(counts.max()) if len(counts) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _unpack(raw: memoryview, n: int) -> tuple[np.ndarray, int]:
    kind = np.dtype(f"u{raw[0]}")
    return np.frombuffer(raw[1 : 1 + n * kind.itemsize], kind), 1 + n * kind.itemsize


class _Chunk:
    """A chunk's tokens and its distinct n-grams by length."""

    def __init__(self, table: pa.Table, order: int, buckets: int):
        self.table = table = table.combine_chunks()
        self.chunk = table.column("chunk")[0].as_py()
        self.order = order
        block = Block(table.column("text"), lower=True)
        self.held = table.column("held_out").to_numpy()
        size = block.counts + 2  # with start and end
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.doc = np.repeat(np.arange(block.n), size)
        self.first = self.at[:-1]
        token = np.empty(int(self.at[-1]), U64)
        inner = np.ones(len(token), bool)
        inner[self.first] = inner[self.at[1:] - 1] = False
        token[self.first], token[self.at[1:] - 1] = _START, _END
        token[inner] = block.hashes()
        self.scored = np.ones(len(token), bool)
        self.scored[self.first] = False
        train = ~self.held[self.doc]
        nth = np.arange(len(token)) - self.first[self.doc]
        self.where, self.which, self.keys, self.own, self.edges = [], [], [], [], []
        gram = token
        for k in range(order):
            if k:
                gram = mix(gram[:-1] * _STEP + token[k:])  # an n-gram's hash from that of its first n - 1 tokens and the last
            ok = nth[k:] >= k
            where = np.flatnonzero(ok) + k
            keys, which = np.unique(gram[ok], return_inverse=True)
            self.where.append(where)
            self.which.append(which)
            self.keys.append(keys)
            self.own.append(np.bincount(which[train[where]], minlength=len(keys)))
            self.edges.append(bucket_edges(keys, buckets))

    def gram_at(self, k: int, ends: np.ndarray) -> np.ndarray:
        """Which of the distinct (k+1)-grams ends at each place; there must be one."""
        return self.which[k][np.searchsorted(self.where[k], ends)]

    def send(self) -> pa.Table:
        def body(b: int) -> bytes:
            out = b""
            for keys, own, edges in zip(self.keys, self.own, self.edges):
                k = keys[edges[b] : edges[b + 1]]
                out += np.uint32(len(k)).tobytes() + (k & U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((k >> U64(32)) & U64(0xFFFF)).astype(np.uint16).tobytes() + _pack(own[edges[b] : edges[b + 1]])
            return out

        live = np.flatnonzero(np.sum([np.diff(e) for e in self.edges], axis=0)).tolist()
        return pa.table([pa.array(live, pa.int32()), pa.array([self.chunk] * len(live), pa.int32()), pa.array([body(b) for b in live], pa.binary())], schema=MESSAGE)

    def score(self, replies: pa.Table, tokens: int, types: int, strengths: tuple[float, ...]) -> pa.Table:
        counts = [np.zeros(len(k), np.int64) for k in self.keys]
        for b, _, raw in bodies(replies):
            raw, at = memoryview(raw), 0
            for c, edges in zip(counts, self.edges):
                got, used = _unpack(raw[at:], int(edges[b + 1] - edges[b]))
                c[edges[b] : edges[b + 1]] = got
                at += used
        root = np.log10((counts[0] + 1) / (tokens + types + 1))
        lanes, totals = _Automaton(self, counts, root, strengths).read(self)
        n = len(self.first)
        per_doc = lambda x: np.bincount(self.doc, np.where(self.scored, x, 0), minlength=n)
        totals = [np.bincount(lanes, t, minlength=n) for t in totals]
        top = np.max(totals, axis=0)
        score = top + np.log10(np.mean([10.0 ** (t - top) for t in totals], axis=0))
        size, which = np.diff(self.at) - 1, self.which[0]
        columns = [self.table.column("doc_id").combine_chunks(), pa.array(self.held), pa.array(size), pa.array(per_doc(counts[0][which] > 0).astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(per_doc(root[which])), pa.array(score)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


class _Automaton:
    """The states and arcs that a chunk's texts can reach.

    State 0 is the empty context; a seen context of k tokens is first[k] plus its place among the chunk's seen k-grams.
    Arcs are sorted by state * V + token; the empty context has one for every token, whether seen or not.
    """

    def __init__(self, chunk: _Chunk, counts: list[np.ndarray], root: np.ndarray, strengths: tuple[float, ...]):
        order, words = chunk.order, len(chunk.keys[0])
        state: list[np.ndarray] = []  # of each k-gram, k from 1: its state, or -1
        self.fail, size = [np.zeros(1, np.int64)], 1
        fail_weight = [np.zeros((len(strengths), 1))]
        one: list[np.ndarray] = []  # of each k-gram, a place where it ends
        for k in range(order):
            at = np.zeros(len(counts[k]), np.int64)
            at[chunk.which[k]] = chunk.where[k]
            one.append(at)
        for k in range(order - 1):
            seen = np.flatnonzero(counts[k] > 0)
            ids = np.full(len(counts[k]), -1)
            ids[seen] = size + np.arange(len(seen))
            state.append(ids)
            self.fail.append(state[k - 1][chunk.gram_at(k - 1, one[k][seen])] if k else np.zeros(len(seen), np.int64))
            fail_weight.append(np.array([np.log10(mu / (counts[k][seen] + mu)) for mu in strengths]))
            size += len(seen)
        self.fail, self.fail_weight = np.concatenate(self.fail), np.concatenate(fail_weight, axis=1)

        def target(k: int, grams: np.ndarray) -> np.ndarray:
            """State behind a (k+1)-gram: of the longest seen context, of order - 1 tokens at most, that ends there."""
            out = np.zeros(len(grams), np.int64)
            for j in range(min(k, order - 2) + 1):
                own = state[j][grams if j == k else chunk.gram_at(j, one[k][grams])]
                out = np.where(own >= 0, own, out)
            return out

        arcs, to = [np.arange(words)], [target(0, np.arange(words)) if order > 1 else np.zeros(words, np.int64)]
        weights = [np.repeat(root[None, :], len(strengths), axis=0)]
        below = weights[0]  # of every k-gram, the weight of the arc for its last token
        for k in range(1, order):
            seen = np.flatnonzero(counts[k] > 0)
            end = one[k][seen]
            context = chunk.gram_at(k - 1, end - 1)
            lower = below[:, chunk.gram_at(k - 1, end)]
            c, h = counts[k][seen], counts[k - 1][context]
            own = np.array([np.log10((c + mu * 10.0**w) / (h + mu)) for mu, w in zip(strengths, lower)]).reshape(len(strengths), len(seen))
            arcs.append(state[k - 1][context] * words + chunk.gram_at(0, end))
            to.append(target(k, seen))
            weights.append(own)
            below = np.zeros((len(strengths), len(counts[k])))
            below[:, seen] = own
        arc = np.concatenate(arcs)
        by = np.argsort(arc, kind="stable")
        self.arcs, self.to, self.weights, self.words, self.order = arc[by], np.concatenate(to)[by], np.concatenate(weights, axis=1)[:, by], words, order

    def read(self, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment its document, and under each strength the sum of weights of its tokens."""
        size = np.diff(chunk.at)
        pieces = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), pieces)
        begin = chunk.first[doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + SEGMENT, chunk.at[doc + 1])
        early = np.maximum(begin - (self.order - 1), chunk.first[doc])
        by = np.argsort(early - end, kind="stable")  # the longest first, so that those still read stand in front
        doc, begin, end, early = doc[by], begin[by], end[by], early[by]
        length, total = end - early, np.zeros((len(self.weights), len(doc)))
        token, state, places = chunk.which[0], np.zeros(len(doc), np.int64), np.arange(len(doc))
        last = len(self.arcs) - 1
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step))  # segments longer than step
            at = early[:n] + step
            counted = np.flatnonzero((at >= begin[:n]) & chunk.scored[at])
            paid = np.zeros((len(self.weights), n))
            now, word, open_ = state[:n], token[at], places[:n]
            while len(open_):
                want = now[open_] * self.words + word[open_]
                arc = np.minimum(np.searchsorted(self.arcs, want), last)
                found = self.arcs[arc] == want
                done = open_[found]
                paid[:, done] += self.weights[:, arc[found]]
                now[done] = self.to[arc[found]]
                open_ = open_[~found]
                paid[:, open_] += self.fail_weight[:, now[open_]]
                now[open_] = self.fail[now[open_]]
            total[:, counted] += paid[:, counted]
        return doc, total


def _add(order: int):
    def add(table: pa.Table) -> pa.Table:
        """For one bucket: counts of each n-gram over all chunks, and the bucket's tokens and distinct words."""
        keys, own, parts = [[] for _ in range(order)], [[] for _ in range(order)], []
        for b, c, raw in bodies(table):
            raw, at, sizes = memoryview(raw), 0, []
            for k in range(order):
                n = int(np.frombuffer(raw[at : at + 4], np.uint32)[0])
                at += 4
                low, high = np.frombuffer(raw[at : at + 4 * n], np.uint32), np.frombuffer(raw[at + 4 * n : at + 6 * n], np.uint16)
                got, used = _unpack(raw[at + 6 * n :], n)
                at += 6 * n + used
                keys[k].append(low.astype(U64) | high.astype(U64) << U64(32))
                own[k].append(got.astype(np.int64))
                sizes.append(n)
            parts.append((b, c, sizes))
        sums, head = [], b""
        for k in range(order):
            u, which = np.unique(np.concatenate(keys[k]), return_inverse=True)
            total = np.bincount(which, np.concatenate(own[k]), minlength=len(u)).astype(np.int64) if len(u) else np.zeros(0, np.int64)
            if not k:
                word = u != (_START & U64(0xFFFFFFFFFFFF))
                head = np.array([total[word].sum(), (total[word] > 0).sum()], np.int64).tobytes()
            sums.append(total[which])
        at, out = [0] * order, [(parts[0][0], TOTALS, head)]
        for b, c, sizes in parts:
            body = b""
            for k in range(order):
                body += _pack(sums[k][at[k] : at[k] + sizes[k]])
                at[k] += sizes[k]
            out.append((b, c, body))
        return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], schema=MESSAGE)

    return add


def lm_score(docs: DataFrame, *, folds: int = 7, held_fold: int = 2, order: int = 2, strengths: tuple[float, ...] = (32.0, 1024.0, 32768.0), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of all documents under a model of those whose crc32(doc_id as text) modulo ``folds`` isn't ``held_fold``."""
    n, m = sizes_for(docs, per=chunk_bytes)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    dealt = deal(docs, n, "doc_id", held.alias("held_out"), "text")
    replies = materialize(ask(dealt, n, m, lambda t: _Chunk(t, order, m).send(), _add(order)))
    totals = [np.frombuffer(r.body, np.int64) for r in replies.where(F.col("chunk") == TOTALS).select("body").collect()]  # 16 bytes a bucket
    tokens, types = (int(sum(t[i] for t in totals)) for i in (0, 1))
    return read_back(dealt, replies.where(F.col("chunk") != TOTALS), n, lambda t, r: _Chunk(t, order, m).score(r, tokens, types, strengths), SCORES)
