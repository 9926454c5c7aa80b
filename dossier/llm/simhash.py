"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint bit is 1 if it is set in more than half of the XXH64 hashes (seed 42) of a text's 3-word
shingles.  Two of the 64-bit fingerprints link at ``distance`` = 3 or fewer differing bits.

Search: the bits are grouped into parts, correlated bits together.  If thresholds t_i of the parts satisfy
sum(t_i + 1) = distance + 1, two linked fingerprints differ by at most t_i bits in some part i (t_i = -1: part
unused).  Dynamic programming picks the t_i, and the number of parts, with the least estimated cost: signatures to
send plus candidates to compare, from bit frequencies and correlations of all distinct fingerprints.
Every fingerprint is indexed by its value in each part and probes all values within t_i; candidates are verified on
all 64 bits.

Equal fingerprints are joined first, so copies cost nothing.  A bucket reports only a spanning forest of its links,
never pairs; the fingerprints of an overfull key are cut into blocks, and pairs of blocks are dealt to other tasks.

Defined results: a text without words (or null) has fingerprint zero, linked like any other; with fewer words than a
shingle the whole sequence is the one shingle; rows with a null doc_id get a component by their fingerprint and
name none; rows with equal doc_id keep their own fingerprints and get the component of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, forest
from .exchange import bucket_edges, materialize
from .text import U64, Block, mix, slices

BITS = 64
#: Signatures in a bucket, fingerprints in a block of an overfull key, comparisons at once.
PER_BUCKET, BLOCK, AT_ONCE = 1_000_000, 4096, 1 << 21


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """One 64-bit fingerprint per text."""
    block = Block(texts, lower=True)
    out = np.zeros(block.n, U64)
    if not len(block.starts):
        return out
    size = block.ends - block.starts  # words laid end to end with one blank between: a shingle is a slice
    edge = np.zeros(len(block.raw) + 1, np.int8)
    edge[block.starts] = 1
    edge[block.ends] -= 1
    flat = np.full(int(size.sum()) + len(size), 32, np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    flat[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = block.raw[np.cumsum(edge)[:-1] > 0]
    stop = begin + size
    count = np.where(block.counts > 0, np.maximum(block.counts - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(block.n), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = block.first[doc] + nth
    last = np.minimum(first + shingle, block.first[doc + 1]) - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], 42) for a, b in zip(begin[first].tolist(), stop[last].tolist())], U64)
    has = np.flatnonzero(count)
    at = (np.cumsum(count) - count)[has]
    for k in range(0, len(has), 2048):  # bits take 64 times a hash's room
        lo, hi = at[k], at[k + 2048] if k + 2048 < len(has) else len(h)
        sums = _bit_sums(h[lo:hi], at[k : k + 2048] - lo)
        out[has[k : k + 2048]] = np.packbits(2 * sums > count[has[k : k + 2048]][:, None], axis=1).view(">u8")[:, 0]
    return out


def _bit_sums(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each run of hashes that begins at ``at``: how many have each bit, highest first."""
    total = np.zeros((len(at), BITS), np.int64)
    step = 1 << 18
    for lo in range(0, len(h), step):
        part = h[lo : lo + step]
        i, j = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, lo + len(part))
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total[i:j] += np.add.reduceat(bits, np.maximum(at[i:j] - lo, 0), axis=0, dtype=np.int64)
    return total


def bit_groups(together: np.ndarray, n: int, parts: int) -> list[np.ndarray]:
    """Bits in ``parts`` groups of almost equal size; each takes a bit and those most correlated with it."""
    p = np.diag(together) / n
    cov = together / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(cov / np.outer(sd, sd))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        group = [free.pop(int(np.argmin(p[free] * (1 - p[free]))))]
        while len(group) < size:
            group.append(free.pop(int(np.argmax(like[np.ix_(free, group)].mean(1)))))
        groups.append(np.array(sorted(group)))
    return groups


def thresholds(together: np.ndarray, n: int, groups: list[np.ndarray], distance: int) -> tuple[float, list[int]]:
    """Least estimated cost and the threshold of each part, by dynamic programming over parts and threshold sums."""
    p = np.diag(together) / n
    differ = 2 * p * (1 - p)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        near = np.zeros(distance + 2)
        near[0] = 1.0
        for q in differ[g]:
            near[1:] = near[1:] * (1 - q) + near[:-1] * q
            near[0] *= 1 - q
        cost = [0.0] + [n * (1 + sum(math.comb(len(g), d) for d in range(t + 1))) + 0.5 * n * n * near[: t + 1].sum() for t in range(distance + 1)]
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, distance + 1):
                k = used + t + 1
                if k <= distance + 1 and (k not in step or c + cost[t + 1] < step[k][0]):
                    step[k] = (c + cost[t + 1], [*ts, t])
        best = step
    return best[distance + 1]


def flips(bits: np.ndarray, threshold: int) -> np.ndarray:
    """Masks of at most ``threshold`` of the given bits (place 0 is the lowest)."""
    masks, last = [0], [(0, -1)]
    for _ in range(threshold):
        last = [(m | 1 << int(bits[j]), j) for m, i in last for j in range(i + 1, len(bits))]
        masks += [m for m, _ in last]
    return np.array(masks, U64)


def link(a: np.ndarray, b: np.ndarray, ai: np.ndarray, bi: np.ndarray, an: np.ndarray, bn: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare runs a[ai:ai+an] with b[bi:bi+bn]; a spanning forest of the links."""
    out_a, out_b, held = [np.zeros(0, U64)], [np.zeros(0, U64)], 0

    def shrink() -> None:
        nonlocal out_a, out_b, held
        x, y = forest(np.concatenate(out_a), np.concatenate(out_b))
        out_a, out_b, held = [x], [y], 0

    size = an * bn
    for lo, hi in _portions(size):
        if hi == lo + 1 and size[lo] > AT_ONCE:
            x, y = a[ai[lo] : ai[lo] + an[lo]], b[bi[lo] : bi[lo] + bn[lo]]
            step = max(1, AT_ONCE // len(y))
            pairs = ((i, *np.nonzero(np.bitwise_count(x[i : i + step, None] ^ y) <= distance)) for i in range(0, len(x), step))
            found = ((x[i + r], y[c]) for i, r, c in pairs)
        else:
            s = size[lo:hi]
            run = np.repeat(np.arange(lo, hi), s)
            nth = np.arange(len(run)) - np.repeat(np.cumsum(s) - s, s)
            x, y = a[ai[run] + nth // bn[run]], b[bi[run] + nth % bn[run]]
            ok = np.bitwise_count(x ^ y) <= distance
            found = [(x[ok], y[ok])]
        for x, y in found:
            ok = x != y
            out_a.append(x[ok])
            out_b.append(y[ok])
            held += int(ok.sum())
            if held > AT_ONCE:
                shrink()
    shrink()
    return out_a[0], out_b[0]


def _portions(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of entries with AT_ONCE comparisons at most, or one larger entry."""
    total, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + AT_ONCE, "right")) - 1)
        yield i, j
        i = j


def near_links(found: DataFrame, distance: int = 3) -> DataFrame:
    """``found`` has distinct fingerprints as ``fp`` (long); edges (a, b) that connect what links connect."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(U64)
            bits = ((fp[:, None] >> np.arange(BITS, dtype=U64)) & U64(1)).astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        yield pa.record_batch([pa.array(range(8), pa.int32()), pa.array([n] * 8), pa.array([total[k * 8 : k * 8 + 8].tobytes() for k in range(8)], pa.binary())], names=["block", "n", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for b, n, body in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("body")):
                x = total.setdefault(b, [0, np.zeros(8 * BITS)])
                x[0], x[1] = x[0] + n, x[1] + np.frombuffer(body.as_buffer())
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1].tobytes() for x in total.values()], pa.binary())], names=["block", "n", "body"])

    kind = "block int, n long, body binary"
    rows = sorted(found.mapInArrow(together, kind).repartition(8, "block").mapInArrow(add, kind).collect())  # 8 rows, 32 KB in all
    n = rows[0]["n"] if rows else 0
    if n < 2:
        return found.sparkSession.createDataFrame([], "a long, b long")
    matrix = np.concatenate([np.frombuffer(r["body"]).reshape(8, BITS) for r in rows])
    plans = [(*thresholds(matrix, n, g, distance), g) for parts in range(1, distance + 2) for g in [bit_groups(matrix, n, parts)]]
    _, limits, groups = min(plans, key=lambda x: x[0])
    used = [(i, g, flips(g, t), t) for i, (g, t) in enumerate(zip(groups, limits)) if t >= 0]
    per = sum(1 + len(f) for _, _, f, _ in used)
    buckets = max(8, -(-n * per // PER_BUCKET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(U64)
            for lo in range(0, len(every), max(1, 200_000 // per)):
                fp = every[lo : lo + max(1, 200_000 // per)]
                keys, who, indexed = [], [], []
                for i, g, f, _ in used:
                    mask = U64(sum(1 << int(b) for b in g))
                    salt = U64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)
                    keys += [mix((fp & mask) ^ salt), mix((((fp & mask)[:, None] ^ f).ravel()) ^ salt)]
                    who += [fp, np.repeat(fp, len(f))]
                    indexed += [np.ones(len(fp), bool), np.zeros(len(fp) * len(f), bool)]
                keys, who, indexed = np.concatenate(keys), np.concatenate(who), np.concatenate(indexed)
                order = np.argsort(keys)
                keys, who, indexed = keys[order], who[order], indexed[order]
                edges = bucket_edges(keys, buckets)
                low = (keys & U64(0xFFFFFFFF)).astype(np.uint32)
                live = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                body = [np.uint32(edges[b + 1] - edges[b]).tobytes() + who[edges[b] : edges[b + 1]].tobytes() + low[edges[b] : edges[b + 1]].tobytes() + np.packbits(indexed[edges[b] : edges[b + 1]]).tobytes() for b in live]
                yield pa.record_batch([pa.array(live, pa.int32()), pa.array(body, pa.binary())], names=["bucket", "body"])

    out = "nth long, left binary, right binary"

    def probe(table: pa.Table) -> pa.Table:
        who, low, indexed = [], [], []
        for body in table.column("body"):
            raw = body.as_buffer()
            k = int(np.frombuffer(raw, np.uint32, 1)[0])
            who.append(np.frombuffer(memoryview(raw)[4 : 4 + 8 * k], U64))
            low.append(np.frombuffer(memoryview(raw)[4 + 8 * k : 4 + 12 * k], np.uint32))
            indexed.append(np.unpackbits(np.frombuffer(memoryview(raw)[4 + 12 * k :], np.uint8), count=k).view(bool))
        who, low, indexed = np.concatenate(who), np.concatenate(low), np.concatenate(indexed)
        order = np.lexsort((low, ~indexed))
        who, low, split = who[order], low[order], int(indexed.sum())
        key, ai, an = np.unique(low[:split], return_index=True, return_counts=True)
        probes = low[split:]
        bi, bj = np.searchsorted(probes, key), np.searchsorted(probes, key, "right")
        bn = bj - bi
        a, b = who[:split], who[split:]
        heavy = (an > BLOCK) | (bn > BLOCK)
        x, y = link(a, b, ai[~heavy], bi[~heavy], an[~heavy], bn[~heavy], distance)
        rows = [(-1, x.tobytes(), y.tobytes())] if len(x) else []
        for k in np.flatnonzero(heavy).tolist():
            left, right = a[ai[k] : ai[k] + an[k]], b[bi[k] : bi[k] + bn[k]]
            for i in range(0, len(left), BLOCK):
                for j in range(0, len(right), BLOCK):
                    rows.append((int(low[ai[k]]) * 7919 + i * 31 + j, left[i : i + BLOCK].tobytes(), right[j : j + BLOCK].tobytes()))
        c = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary())], names=["nth", "left", "right"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth, left, right in zip(batch.column("nth").to_pylist(), batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(left.as_buffer(), U64), np.frombuffer(right.as_buffer(), U64)
                if nth >= 0:
                    one = np.zeros(1, np.int64)
                    x, y = link(x, y, one, one, np.array([len(x)]), np.array([len(y)]), distance)
                yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    probed = found.mapInArrow(send, "bucket int, body binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(probe, out)
    return probed.repartition(buckets, F.xxhash64("nth", F.length("left"), F.length("right"), F.substring("left", 1, 8))).mapInArrow(finish, "a long, b long")


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with their fingerprint as ``_fp``, written once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.append_column("_fp", pa.array(fingerprints(part.column("text"), shingle).view(np.int64)))

    return materialize(docs.mapInArrow(sign, T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType())])))


def _grouped(signed: DataFrame, distance: int) -> DataFrame:
    """Every distinct fingerprint: its smallest doc_id and the root of its component."""
    found = materialize(signed.groupBy("_fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(found.select(F.col("_fp").alias("fp")), distance)).withColumnRenamed("node", "_fp")
    return found.join(roots, "_fp", "left").select("_fp", "least", F.coalesce("root", "_fp").alias("root"))


def simhash_near_dedup(docs: DataFrame, *, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), pa.array(fingerprints(part.column("text"), shingle).view(np.int64))], names=["doc_id", "_fp"])

    signed = materialize(docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, _fp long"))
    grouped = _grouped(signed, distance)
    firsts = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of = grouped.join(firsts, "root").select("_fp", "component_id")
    return signed.join(of, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_filter(docs: DataFrame, *, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest doc_id (a null one only if there is no other)."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # no name can clash with ours
    signed = _signed(docs.withColumnsRenamed(names), shingle)
    last = F.lit(2**63 - 1)
    firsts = _grouped(signed.select("doc_id", "_fp"), distance).groupBy("root").agg(F.min(F.struct(F.coalesce("least", last).alias("_id"), "_fp")).alias("one"))
    kept = signed.withColumn("_id", F.coalesce("doc_id", last)).join(firsts.select("one._id", "one._fp"), ["_id", "_fp"], "left_semi")
    return kept.dropDuplicates(["_id", "_fp"]).select([F.col(names.get(c, c)).alias(c) for c in docs.columns])
