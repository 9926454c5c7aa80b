"""Near copies by exact Jaccard similarity of word shingles; SimHash fingerprints and MinHash bands propose the pairs.

Two texts link if their sets of 5-word shingles (ASCII lower case) have a Jaccard similarity of 0.8 or more.
First the SimHash search of simhash.py, by the generalised pigeonhole principle, joins fingerprints of 3 or fewer differing
bits; what it joins is verified and, where it holds, linked.  It can't propose all: at 0.8 two 64-bit SimHashes differ by about
10 bits, some by more than 16, and a pigeonhole search at such distances compares a fixed share of all pairs.  So MinHash bands
propose the pairs beyond.  Of BANDS x ROWS minima each band is a key;
a pair at exactly 0.8 has no key in common with probability (1 - 0.8**6)**40 = 5e-6, at 0.85 with 3e-9.  Every
proposed pair is verified on the whole sets, so nothing below the similarity links.

Equal sets are joined first, so copies cost nothing.  First every set is compared with one centre of its keys, then with
those of its other keys that are in another component, both linear in the keys' members.  Keys whose members are then still
in different components are joined into groups that share any key, and each group's sets are compared by blocks of BLOCK:
a set goes to as many tasks as its group has blocks, overlaps of a pair of blocks are counted there as matrix products, and only
edges that connect anything come out.  No row is made per pair, no group is gathered in one task.

Defined results: a text without words (or null) has the empty set, all of them link; with fewer words than a shingle
the whole sequence is the one shingle.  Shingles are compared by 64-bit hashes, no text compare follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, forest
from .exchange import drop, materialize, small
from .simhash import fingerprints, near_links
from .text import U64, Block, mix, slices, window_hash

BANDS, ROWS = 40, 6
#: Sets in a block, and bytes of their shingles.
BLOCK, BLOCK_BYTES = 2_048, 16 << 20
#: In place of a null doc_id.
LAST = 2**63 - 1
_RNG = np.random.Generator(np.random.PCG64(8))
_FLIP = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=U64)
_TIMES = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=U64) | U64(1)


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (one more than there are texts)."""
    block = Block(texts, lower=True)
    words = block.hashes()
    where, keys = block.grams(words, size)
    owner = block.owner()[where]
    for k in np.unique(block.counts[(block.counts > 0) & (block.counts < size)]).tolist():
        short = np.flatnonzero(block.counts == k)
        keys = np.concatenate([keys, window_hash(words, k)[block.first[short]]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.searchsorted(owner[new], np.arange(block.n + 1))


def set_ids(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per set, zero for the empty one."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys), dtype=U64)])
    return mix(total[at[1:]] - total[at[:-1]])


def bands(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS keys of each set that isn't empty, by set."""
    begin = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(begin), BANDS), U64)
    if len(begin):
        for b in range(BANDS):
            key = np.full(len(begin), b + 1, U64)
            for i in range(b * ROWS, (b + 1) * ROWS):
                key = mix(key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat((keys ^ _FLIP[i]) * _TIMES[i], begin))
            out[:, b] = key
    return out


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with ``_set``, the id of their shingle set, ``_bands`` and ``_fp``, their SimHash fingerprint, written once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, at = shingle_sets(part.column("text"), shingle)
                own, has = iter(bands(keys, at)), (np.diff(at) > 0).tolist()
                part = part.append_column("_set", pa.array(set_ids(keys, at).view(np.int64)))
                part = part.append_column("_bands", pa.array([next(own).tobytes() if h else b"" for h in has], pa.binary()))
                yield part.append_column("_fp", pa.array(fingerprints(part.column("text")).view(np.int64)))

    extra = [T.StructField("_set", T.LongType()), T.StructField("_bands", T.BinaryType()), T.StructField("_fp", T.LongType())]
    return materialize(docs.mapInArrow(sign, T.StructType([*docs.schema.fields, *extra])))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``texts`` (_set, text) as _set and keys, its sorted shingle hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, at = shingle_sets(part.column("text"), shingle)
                yield pa.record_batch([part.column("_set"), pa.array([keys[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["_set", "keys"])

    return texts.mapInArrow(sets, "_set long, keys binary")


def _verified(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: set ids) that link; ``known`` has their sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                small, large = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small / large >= similarity else 0
                ok.append(both / (small + large - both) >= similarity)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = known.toDF("a", "x"), known.toDF("b", "y")
    pairs = materialize(pairs)
    out = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    drop(pairs)
    return out


def overlaps(keys: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` (places in keys) shares with each of ``right``: rare shingles pair by pair, frequent ones as matrix products."""
    row, column = np.full(len(keys), -1), np.full(len(keys), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    which = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat, of = np.unique(np.concatenate([np.zeros(0, U64), *keys]), return_inverse=True)
    in_left, in_right = row[which] >= 0, column[which] >= 0
    n, m = np.bincount(of[in_left], minlength=len(flat)), np.bincount(of[in_right], minlength=len(flat))
    out = np.zeros((len(left), len(right)), np.float32)
    both = (n > 0) & (m > 0)
    rare = both & (n * m <= 64)
    a = np.flatnonzero(in_left & rare[of])
    order = np.argsort(of, kind="stable")
    order = order[in_right[order]]
    begin = np.searchsorted(of[order], of[a])
    times = m[of[a]]
    for i in range(0, len(a), 1 << 16):
        t = times[i : i + (1 << 16)]
        nth = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        x, y = np.repeat(row[which[a[i : i + (1 << 16)]]], t), column[which[order[np.repeat(begin[i : i + (1 << 16)], t) + nth]]]
        out += np.bincount(x * len(right) + y, minlength=out.size).reshape(out.shape).astype(np.float32)
    often = np.flatnonzero(both & ~rare)
    place = np.full(len(flat), -1)
    place[often] = np.arange(len(often))
    at = place[of]
    for i in range(0, len(often), 2_048):
        here = (at >= i) & (at < i + 2_048)
        x, y = np.zeros((len(left), 2_048), np.float32), np.zeros((len(right), 2_048), np.float32)
        p, q = here & in_left, here & in_right
        x[row[which[p]], at[p] - i] = 1
        y[column[which[q]], at[q] - i] = 1
        out += x @ y.T
    return out


def _compare_blocks(similarity: float):
    def compare(table: pa.Table) -> pa.Table:
        """Edges that connect the sets of two blocks (or of one) that are similar enough."""
        table = table.combine_chunks()
        sets, own = table.column("a").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        one = len(table) > 0 and table.column("x")[0].as_py() == table.column("y")[0].as_py()
        keys = [np.frombuffer(k.as_buffer(), U64) for k in table.column("keys")]
        left = np.arange(len(keys)) if one else np.flatnonzero(own)
        right = left if one else np.flatnonzero(~own)
        size = np.array([len(k) for k in keys])
        ends: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
        if len(left) and len(right):
            both = overlaps(keys, left, right)
            i, j = np.nonzero(both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-6)
            exact = both[i, j] / (size[left[i]] + size[right[j]] - both[i, j]) >= similarity
            i, j = left[i[exact]], right[j[exact]]
            if len(i):
                ends = list(forest(sets[i], sets[j]))
        return pa.table([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

    return compare


def simhash_pairs(signed: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b: set ids) that connect all sets whose fingerprints differ by ``distance`` bits or fewer, in any of their texts."""
    of = materialize(signed.select("_set", "_fp").distinct())
    first = materialize(of.groupBy("_fp").agg(F.min("_set").alias("b")))
    same = of.join(first, "_fp").select(F.col("_set").alias("a"), "b")
    left, right = first.toDF("a", "x"), first.toDF("b", "y")
    near = near_links(first.select(F.col("_fp").alias("fp")), distance).distinct().join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = materialize(same.union(near).where("a <> b").distinct())
    drop(of, first)
    return pairs


def _links(signed: DataFrame, found: DataFrame, shingle: int, similarity: float, distance: int) -> DataFrame:
    """Edges (a, b: set ids) that connect what links connect; ``found`` has each set once."""
    close = simhash_pairs(signed, distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("_bands")]
            keys = np.concatenate([np.zeros(0, np.int64), *own])
            yield pa.record_batch([pa.array(keys), pa.array(np.repeat(batch.column("_set").to_numpy(), [len(x) for x in own]))], names=["key", "a"])

    dealt = found.select("_set", "_bands").mapInArrow(deal, "key long, a long")
    centres = dealt.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    live = materialize(dealt.join(centres, "key"))
    either = live.select("a").union(close.select("a")).union(close.select("b")).toDF("_set").distinct()
    wanted = materialize(found.select("_set", "_id").join(either, "_set"))
    texts = signed.select("_set", "text", F.coalesce("doc_id", F.lit(LAST)).alias("_id")).join(small(wanted), ["_set", "_id"], "left_semi").select("_set", "text")
    known = materialize(_sets(texts, shingle).dropDuplicates(["_set"]))
    drop(wanted)

    def labelled(roots: DataFrame, name: str, to: str) -> DataFrame:
        return roots.select(F.col("node").alias(name), F.col("root").alias(to))

    # What SimHash joins; each set with its least centre; then centres still in another component; then groups whose keys still hold several.
    centre = live.where("a <> b").groupBy("a").agg(F.min("b").alias("b"))
    edges = _verified(close.union(centre).distinct(), known, similarity)
    drop(close)
    roots = components(edges)
    apart = live.where("a <> b").select("a", "b").distinct().join(labelled(roots, "a", "ra"), "a", "left").join(labelled(roots, "b", "rb"), "b", "left")
    edges = edges.union(_verified(apart.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"), known, similarity))
    drop(roots)
    roots = components(edges)
    of = materialize(live.select("key", "a").join(labelled(roots, "a", "root"), "a", "left").select("key", "a", F.coalesce("root", "a").alias("root")))
    drop(live, roots)
    keys = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("a").alias("b")).where("lo <> hi").select("key", "b")
    mixed = materialize(of.join(keys, "key").select("a", "b").distinct())
    drop(of)
    groups = components(mixed)
    sized = known.select(F.col("_set").alias("a"), F.octet_length("keys").alias("bytes"))
    members = materialize(groups.select(F.col("node").alias("a"), F.col("root").alias("g")).join(sized, "a"))
    counted = members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    placed = members.join(counted, "g").select("g", "a", block.alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("g", "a", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), (F.col("at") <= F.col("other")).alias("own"))
    sets = placed.join(known.withColumnRenamed("_set", "a"), "a")
    found = materialize(sets.groupBy("g", "x", "y").applyInArrow(_compare_blocks(similarity), "a long, b long"))
    drop(known, mixed, groups, members)
    return edges.union(found)


def near_copy_filter(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest doc_id (a null one only if there is no other)."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # no name can clash with ours
    signed = _signed(docs.withColumnsRenamed(names), shingle)
    rows = signed.withColumn("_id", F.coalesce("doc_id", F.lit(LAST)))
    found = materialize(rows.groupBy("_set").agg(F.min("_id").alias("_id"), F.first("_bands").alias("_bands")))
    links = _links(signed, found, shingle, similarity, distance)
    roots = components(links).withColumnRenamed("node", "_set")
    firsts = found.select("_set", "_id").join(roots, "_set", "left").groupBy(F.coalesce("root", "_set").alias("root")).agg(F.min(F.struct("_id", "_set")).alias("one"))
    # Only what goes, or comes twice, is looked up, as that is little: texts that stay needn't be shuffled.
    own = ["_id", "_set"]
    counted = materialize(rows.groupBy(own).agg(F.count("*").alias("n")))
    gone = materialize(counted.select(own).join(firsts.select("one._id", "one._set"), own, "left_anti"))
    twice = materialize(counted.where("n > 1").select(own).join(gone, own, "left_anti"))
    drop(counted, found)
    kept = rows.drop("_bands").join(small(gone), own, "left_anti")
    again = rows.drop("_bands").join(small(twice), own, "left_semi").dropDuplicates(own)
    return kept.join(small(twice), own, "left_anti").unionByName(again).select([F.col(names.get(c, c)).alias(c) for c in docs.columns])
