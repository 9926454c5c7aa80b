"""Suffix-array dedup: bytes inside strings of ``length`` bytes that also start anywhere else, by deep-shallow sorting.

Sorting every suffix of a corpus moves many times its size, so the array is sparse: its suffixes begin at anchors.
The anchor of a window of ``length`` bytes is the leftmost smallest hash among its ``gram``-byte strings, which
depends on nothing but the window; equal windows hold equal anchors at equal places, so no repeat is missed.
About one byte in (length - gram) / 2 is an anchor, and only anchors that occur twice go on.  Occurrences with
the same context (all bytes that any window around the anchor can reach) are one class: they repeat each other
wholly, and just one of them is compared with other classes.

Two lengths are served at once: strings of ``length`` bytes are removed, strings of ``passage`` bytes (no longer)
are counted.  An anchor of a long window is one of a short window inside it, so the long windows' anchors are
some of the short ones' and only they carry the wide context.

An anchor with many classes is dealt apart: a match of ``passage`` bytes reaches half of that to its left or to its
right, so the classes meet by the half they share on one side, and again by the other.

The suffixes of an anchor's classes are ordered by deep-shallow sorting: multikey quicksort down to a shallow
depth, then blind tries for groups with a longer common prefix.  Neighbours' common prefixes, merged from the longest
down (smaller set into larger), give each class its longest match to the left for every length of match to the
right: O(m log m) comparisons for m classes, never all pairs.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes; equal rows are two documents
and so repeat each other; rows with a null doc_id take part; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import chunks_for, drop, materialize
from .text import SPANS_SQL, U64, Block, mix, powers, raw_strings, runs, slices, spans, strings
from .text import _BASE_INV

SHALLOW = 48
TRIE = 6  # groups with fewer suffixes are put in order by insertion


def common(a: bytes, b: bytes, from_: int = 0) -> int:
    """Length of the common prefix, at least ``from_``."""
    hi = min(len(a), len(b))
    if a[from_:hi] == b[from_:hi]:
        return hi
    lo, step = from_, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(hi, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(items: list[int], texts: list[bytes], depth: int) -> list[int]:
    """Order of texts with a common prefix of ``depth`` bytes: a trie that keeps branching bytes only, and text at its leaves."""
    root: list | int = items[0]
    for new in items[1:]:
        t, node = texts[new], root
        while isinstance(node, list):  # blind search: compare branching bytes, skip all others
            key = t[node[0]] if node[0] < len(t) else -1
            node = node[1].get(key, next(iter(node[1].values())))
        n = common(t, texts[node], depth)
        key, old = (t[n] if n < len(t) else -1), (texts[node][n] if n < len(texts[node]) else -1)
        parent, at, node = None, None, root
        while isinstance(node, list) and node[0] < n:
            parent, at = node, t[node[0]] if node[0] < len(t) else -1
            node = node[1][at]
        if isinstance(node, list) and node[0] == n:
            if key in node[1]:  # equal texts end in the same leaf
                node[1][-2 - new] = new
            else:
                node[1][key] = new
            continue
        branch = [n, {old: node, key: new} if old != key else {old: node, -2 - new: new}]
        if parent is None:
            root = branch
        else:
            parent[1][at] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow(texts: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Places of the texts in sorted order; all have a common prefix of ``depth`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(texts))), depth)]
    while stack:
        items, d = stack.pop()
        if len(items) < TRIE:
            out += sorted(items, key=lambda i: texts[i][d:])
        elif d >= depth + shallow:
            out += blind_trie(items, texts, d)
        else:
            byte = [texts[i][d] if d < len(texts[i]) else -1 for i in items]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            less, same, more = ([i for i, b in zip(items, byte) if b < pivot], [i for i, b in zip(items, byte) if b == pivot], [i for i, b in zip(items, byte) if b > pivot])
            if more:
                stack.append((more, d))
            stack.append((same, d + 1 if pivot >= 0 else depth + shallow))  # texts that end here are equal
            if less:
                stack.append((less, d))
    return out


def reaches(lefts: list[bytes], rights: list[bytes], lengths: tuple[int, ...], depth: int) -> list[tuple[int, ...]]:
    """Of each context (bytes before the anchor, last first; bytes from it on): how far matches reach left and right, for each of ``lengths`` that they have at least."""
    m, far = len(lefts), [[0, 0] * len(lengths) for _ in lefts]

    def meet(i: int, j: int, r: int) -> None:
        l = common(lefts[i], lefts[j])
        for x, length in enumerate(lengths):
            if l + r >= length:
                for k in (i, j):
                    far[k][2 * x] = max(far[k][2 * x], l)
                    far[k][2 * x + 1] = max(far[k][2 * x + 1], r)

    if m == 2:
        meet(0, 1, common(rights[0], rights[1], depth))
        return [tuple(x) for x in far]
    order = deep_shallow(rights, depth)
    by_left = deep_shallow(lefts)
    rank = [0] * m
    for k, i in enumerate(by_left):
        rank[i] = k
    near = [common(rights[order[k]], rights[order[k + 1]], depth) for k in range(m - 1)]
    home, sets = list(range(m)), [[rank[i]] for i in order]

    def find(k: int) -> int:
        while home[k] != k:
            home[k] = home[home[k]]
            k = home[k]
        return k

    for k in sorted(range(m - 1), key=lambda k: -near[k]):
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, r = sets[a], near[k]
        fresh = []
        for x in sets[b]:
            at = bisect_left(large, x)
            if at:
                meet(by_left[x], by_left[large[at - 1]], r)
            if at < len(large):
                meet(by_left[x], by_left[large[at]], r)
            fresh.append(x)
        if len(fresh) == 1:
            large.insert(bisect_left(large, fresh[0]), fresh[0])
        else:
            large += fresh
            large.sort()
        home[b] = a
        sets[b] = []
    return [tuple(x) for x in far]


def _least(key: np.ndarray, n: int, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbouring keys, from minima ahead of and behind each block's edge."""
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    full[:n] = key
    ahead = np.minimum.accumulate(full.reshape(rows, width), axis=1).ravel()
    back = np.minimum.accumulate(full.reshape(rows, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(block: Block, lengths: tuple[int, int], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in the block) and hashes of the anchors of the shorter length's windows, and which are anchors of the longer's too."""
    n, size = len(block.raw) - gram + 1, np.diff(block.offsets)
    found: list[np.ndarray] = []
    h = low = key = None
    for length in sorted(lengths):
        long, width = np.flatnonzero(size >= length), length - gram + 1
        if not len(long):
            found.append(np.zeros(0, np.int64))
            continue
        if h is None:
            p = block.prefix()
            h = mix((p[gram:] - p[:-gram]) * powers(_BASE_INV, len(block.raw) + 1)[:n])
            low = U64((1 << max(20, n.bit_length())) - 1)
            key = (h & ~low) | np.arange(n, dtype=U64)
        least = _least(key, n, width)  # of the window that starts here
        ok = np.zeros(len(least) + 1, np.int32)
        ok[block.offsets[long]] += 1
        ok[block.offsets[long + 1] - length + 1] -= 1
        at = (least[np.cumsum(ok)[:-1] > 0] & low).astype(np.int64)
        found.append(at[np.concatenate([[True], np.diff(at) != 0])] if len(at) else at)
    at = found[0]
    return at, (h[at] if h is not None else np.zeros(0, U64)), np.isin(at, found[-1], assume_unique=True)


def _bounds(offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, wide: np.ndarray, lengths: tuple[int, int], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the contexts of anchors begin and end."""
    reach = np.where(wide, max(lengths), min(lengths))
    return np.maximum(offsets[doc], at - (reach - gram)), np.minimum(offsets[doc + 1], at + reach)


OUT = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, removed {SPANS_SQL}, n_repeated long"
#: Classes of one anchor that are compared in one group; more are dealt apart by the halves that they share.
MANY = 1_000


def suffix_array_filter(docs: DataFrame, *, length: int = 400, gram: int = 32) -> DataFrame:
    """``docs`` with repeated strings cut out of their texts (whole characters only) and n_chars counted anew."""
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    found = suffix_array_dedup(docs, length=length, passage=length, gram=gram, whole_characters=True, carry=tuple(c for c in docs.columns if c not in now))
    return found.select([(now[c] if c in now else F.col(f"_{c}")).alias(c) for c in docs.columns])


def suffix_array_dedup(docs: DataFrame, *, length: int = 400, passage: int | None = None, gram: int = 32, whole_characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), removed (start and length in bytes) and n_repeated of every document.

    n_repeated counts the bytes covered by strings of ``passage`` bytes (``length`` if none is given) that also start
    anywhere else; only those covered by strings of ``length`` bytes are removed.
    With ``whole_characters`` removed runs shrink to whole characters and kept_text holds the text that is left;
    else kept_text is null, as a run may begin or end inside a character.  Columns named in ``carry`` are returned
    as well, with an underscore before their names.
    """
    passage = length if passage is None else passage
    if not gram <= passage <= length:
        raise ValueError("gram, passage and length must be in ascending order")
    lengths = (length,) if passage == length else (length, passage)
    both, half = (passage, length), passage // 2
    n = chunks_for(docs)
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("row"), "doc_id", "text")
    also = [F.col(c).alias(f"_{c}") for c in carry]
    dealt = docs.select(F.pmod(key, F.lit(n)).cast("int").alias("chunk"), key.alias("row"), "doc_id", "text", *also).repartition(n, "chunk")
    out = T.StructType([*T.StructType.fromDDL(OUT).fields, *(T.StructField(f"_{c}", docs.schema[c].dataType) for c in carry)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(part.column("text"))
                at, h, wide = anchors(block, both, gram)
                doc = np.searchsorted(block.offsets, at, "right") - 1
                a, b = _bounds(block.offsets, doc, at, wide, both, gram)
                around = mix(block.hash_spans(a, b) + (at - a).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
                row = part.column("row").to_numpy()[doc]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(row), pa.array((at - block.offsets[doc]).astype(np.int32)), pa.array(wide)], names=["anchor", "context", "row", "at", "wide"])

    found = materialize(keyed.select("row", "text").mapInArrow(find, "anchor long, context long, row long, at int, wide boolean"))
    twice = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1").drop("n")
    twice = materialize(twice)  # an aggregate right below a join would keep Spark from splitting hot anchors
    live = materialize(found.join(twice, "anchor"))
    drop(found, twice)
    classes = live.groupBy("anchor", "context", "mixed", "wide").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("one"))
    classes = materialize(classes.select("anchor", "context", "mixed", "wide", "n", "one.row", "one.at"))
    mixed = classes.where("mixed")
    many = materialize(mixed.groupBy("anchor").count().where(F.col("count") > MANY).select("anchor", F.lit(True).alias("many")))
    wanted = mixed.join(many, "anchor", "left").select(F.pmod("row", F.lit(n)).cast("int").alias("chunk"), "anchor", "context", "row", "at", "wide", F.coalesce("many", F.lit(False)).alias("many")).repartition(n, "chunk")
    piece = pa.schema([("key", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary())])

    def cut_out(table: pa.Table, asked: pa.Table) -> pa.Table:
        """The contexts of a chunk's documents that are to be compared, with the key of the group that compares them."""
        if not len(asked) or not len(table):
            return piece.empty_table()
        block = Block(table.column("text"))
        rows = table.column("row").to_numpy()
        order = np.argsort(rows, kind="stable")
        doc = order[np.searchsorted(rows[order], asked.column("row").to_numpy())]
        at = block.offsets[doc] + asked.column("at").to_numpy()
        a, b = _bounds(block.offsets, doc, at, asked.column("wide").to_numpy(zero_copy_only=False), both, gram)
        many, anchor = asked.column("many").to_numpy(zero_copy_only=False), asked.column("anchor").to_numpy()
        left, right = np.flatnonzero(many & (at - a >= half)), np.flatnonzero(many & (b - at >= half))
        salted = anchor.view(U64)
        pick = np.concatenate([np.flatnonzero(~many), left, right])
        keys = np.concatenate([anchor[~many].view(U64), mix(block.hash_spans(at[left] - half, at[left]) ^ salted[left]), mix(block.hash_spans(at[right], at[right] + half) + salted[right])])
        data = block.raw.tobytes()
        cut = pa.array([data[x:y] for x, y in zip(a[pick].tolist(), b[pick].tolist())], pa.binary())
        return pa.table([pa.array(keys.view(np.int64)), pa.array(anchor[pick]), asked.column("context").take(pa.array(pick)), pa.array((at - a)[pick].astype(np.int32)), cut], schema=piece)

    groups = max(64, -(-mixed.count() // 10_000))
    pieces = dealt.select("chunk", "row", "text").groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(cut_out, "key long, anchor long, context long, before int, bytes binary")
    far_names = ["l", "r"] if len(lengths) == 1 else ["l", "r", "pl", "pr"]

    def compare(table: pa.Table) -> pa.Table:
        group = table.column("key").to_numpy()
        order = np.argsort(group, kind="stable")
        group = group[order]
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        body, before = table.column("bytes").to_pylist(), table.column("before").to_pylist()
        far = np.zeros((len(order), len(far_names)), np.int32)
        places = order.tolist()
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = places[x:y]
            if len(own) > 1:
                far[x:y] = reaches([body[i][: before[i]][::-1] for i in own], [body[i][before[i] :] for i in own], lengths, gram)
        ok = far[:, -1] > 0  # the shorter length's, which every match has
        kept = pa.array(order[ok])
        return pa.table([table.column("anchor").take(kept), table.column("context").take(kept), *(pa.array(far[ok, x]) for x in range(len(far_names)))], names=["anchor", "context", *far_names])

    dealt_out = pieces.select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("bucket"), "*").repartition(groups, "bucket")
    compared = dealt_out.groupBy("bucket").applyInArrow(compare, "anchor long, context long, " + ", ".join(f"{x} int" for x in far_names))
    reach_of = {"l": F.when(F.col("wide"), length - gram).otherwise(0), "r": F.when(F.col("wide"), length).otherwise(0), "pl": F.when(F.col("wide"), length - gram).otherwise(passage - gram), "pr": F.when(F.col("wide"), length).otherwise(passage)}
    whole = classes.where("n > 1").select("anchor", "context", *(reach_of[x].cast("int").alias(x) for x in far_names))
    reach = materialize(whole.unionByName(compared).groupBy("anchor", "context").agg(*(F.max(x).alias(x) for x in far_names)))
    drop(classes, many)
    shifted = [(F.col("at") + (F.col(x) if x.endswith("r") else -F.col(x))).alias(x) for x in far_names]
    hits = live.select("anchor", "context", "row", "at").join(reach, ["anchor", "context"]).select(F.pmod("row", F.lit(n)).cast("int").alias("chunk"), "row", *shifted)

    def finish(table: pa.Table, hits: pa.Table) -> pa.Table:
        raw, offsets = raw_strings(table.column("text"))
        covers = [np.zeros(len(raw) + 1, np.int32) for _ in lengths]
        if len(hits) and len(table):
            rows = table.column("row").to_numpy()
            order = np.argsort(rows, kind="stable")
            want = hits.column("row").to_numpy()
            lo, hi = np.searchsorted(rows[order], want), np.searchsorted(rows[order], want, "right")
            times = hi - lo  # equal rows all get the hits of each
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            doc = order[np.repeat(lo, times) + nth]
            for x, cover in enumerate(covers):
                a = np.maximum(offsets[doc], offsets[doc] + np.repeat(hits.column(far_names[2 * x]).to_numpy(), times))
                b = np.minimum(offsets[doc + 1], offsets[doc] + np.repeat(hits.column(far_names[2 * x + 1]).to_numpy(), times))
                cover += np.bincount(a, minlength=len(raw) + 1).astype(np.int32)
                cover -= np.bincount(b, minlength=len(raw) + 1).astype(np.int32)
        flags = np.cumsum(covers[0])[:-1] > 0
        repeated = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(covers[-1])[:-1] > 0)])[offsets])
        start, end, counts = runs(flags, offsets)
        if whole_characters and len(start):
            begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            doc = np.repeat(np.arange(len(counts)), counts)
            start, end = begins[np.searchsorted(begins, start)], begins[np.searchsorted(begins, end, "right") - 1]
            ok = end > start
            start, end, counts = start[ok], end[ok], np.bincount(doc[ok], minlength=len(counts))
            edge = np.zeros(len(raw) + 1, np.int32)
            edge[start] += 1
            edge[end] -= 1
            flags = np.cumsum(edge)[:-1] > 0
        kept = np.concatenate([[0], np.cumsum(~flags)])[offsets]
        texts = strings(raw[~flags], kept)
        size = np.diff(offsets)
        columns = [table.column("doc_id").combine_chunks(), pa.array(size), pa.array(size - np.diff(kept)), pa.array(counts), texts.cast(pa.binary()), texts if whole_characters else pa.nulls(len(size), pa.string()), spans(start, end, counts, offsets[:-1]), pa.array(repeated)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "removed", "n_repeated"]
        return pa.table([*columns, *(table.column(f"_{c}") for c in carry)], names=[*names, *(f"_{c}" for c in carry)])

    return dealt.groupBy("chunk").cogroup(hits.repartition(n, "chunk").groupBy("chunk")).applyInArrow(finish, out)
