"""Quality rules: a base of plain counts, then a log-likelihood ratio between trusted and raw text.

Features are hashed n-grams of ``gram`` = 4 neighbouring bytes of a text, in 2**16 buckets.  The raw multinomial
counts every n-gram of every document; the trusted one those of all documents that labels
call good (quality 1, not toxic).  A document's score is the sum of log(trusted / raw) over its n-grams,
divided by their number.  Weights are rounded to integers first, so sums don't depend on the order of rows.
The threshold is fixed from the scores of all labelled documents, a good document's without its own share in the trusted
counts: the cut that parts good from bad labels best among those that lose at most ``loss`` of the good ones.  Every document is then held against it.

Defined results: a null text has no words and fails the base; without usable labels every document that
passes the base is kept; a document with fewer bytes than an n-gram scores 0; labels with nulls are left out;
a doc_id that labels name twice counts as good only if all its labels do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import drop, materialize, small
from .text import _SPACE, U64, Block, mix, slices, window_hash

BUCKETS = 1 << 16
UNIT = 1 << 20
BLOCKS = 16
#: Ranges in which scores are counted for a median.
RANGES = 4_096
#: Share of the distance from the cut to the median good score by which the cut is lowered.
SLACK = 0.05
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_grams long, weight long, label int, fair long"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _bucket_ids(block: Block, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram inside a document, and of each document where its n-grams begin (one more)."""
    raw = block.raw
    n = max(0, len(raw) - gram + 1)
    key = np.zeros(n, np.uint32)
    for j in range(gram):
        key = key * np.uint32(257) + raw[j : j + n]
    key = (key * np.uint32(2654435761)) >> np.uint32(16)
    size = np.diff(block.offsets)
    ok = np.ones(n, bool)
    for j in range(1, gram):
        stop = block.offsets[1:-1] - j
        ok[stop[(stop >= 0) & (stop < n)]] = False
    count = np.maximum(0, size - gram + 1)
    if (size < gram).any():  # short documents: windows that run over more than one edge
        owner = np.searchsorted(block.offsets, np.arange(n), "right") - 1
        ok = np.arange(n) + gram <= block.offsets[owner + 1]
    return key[ok], np.concatenate([[0], np.cumsum(count)])


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """Per document: words, characters in words, symbols, repeated lines, words in repeated 3-word windows."""
    raw, off = block.raw, block.offsets
    out = {"n_words": block.counts, "word_chars": _sums(~_SPACE[raw] & ((raw & 0xC0) != 0x80), off), "n_symbols": _sums(_SYMBOL[raw], off)}
    edge = np.zeros(len(raw) + 1, bool)
    edge[np.flatnonzero(raw == 10) + 1] = True
    edge[off[:-1]] = True
    start = np.flatnonzero(edge[: len(raw)])
    end = np.append(start[1:], len(raw)) if len(start) else start
    end = end - (raw[end - 1] == 10) if len(start) else end
    worded = np.searchsorted(block.starts, end) > np.searchsorted(block.starts, start)
    start, end = start[worded], end[worded]
    doc = np.searchsorted(off, start, "right") - 1
    once = np.unique(mix(block.hash_spans(start, end) + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(doc, minlength=block.n) - np.bincount(doc[once], minlength=block.n)
    words, owner = block.hashes(), block.owner()
    flags = np.zeros(len(words) + 1, np.int32)
    if len(words) > 2:
        ok = np.flatnonzero(owner[2:] == owner[:-2])
        key = mix(window_hash(words, 3)[ok] + owner[ok].astype(U64) * U64(0x9E3779B97F4A7C15))
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = ok[times[which] > 1]
        flags[twice] += 1
        flags[twice + 1] += 1
        flags[twice + 2] += 1
    out["n_repeat_words"] = _sums(flags[:-1] > 0, block.first)
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out


def quality_rules(docs: DataFrame, labels: DataFrame | None, *, gram: int = 4, loss: float = 0.001, slack: float = SLACK) -> DataFrame:
    """Counts, score and verdict for every document; every usable label counts."""
    scored, _, cut = _fit(docs, labels, gram, loss, slack)
    return scored.withColumn("threshold", F.lit(cut)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut))).drop("weight", "label", "fair")


def quality_filter(docs: DataFrame, labels: DataFrame | None, *, gram: int = 4, loss: float = 0.001, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with all their columns, by another pass instead of a join."""
    _, weights, cut = _fit(docs, labels, gram, loss, slack)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(part.column("text"))
                total, n = _weigh(block, gram, weights)
                score = np.divide(total / UNIT, n, out=np.zeros(len(n)), where=n > 0)
                yield part.filter(pa.array(~base_counts(block)["base_failed"] & (score >= cut)))

    return docs.mapInArrow(keep, docs.schema)


def _weigh(block: Block, gram: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weights and number of n-grams per document."""
    key, at = _bucket_ids(block, gram)
    total = np.concatenate([[0], np.cumsum(weights[key])])
    return total[at[1:]] - total[at[:-1]], np.diff(at)


def _fit(docs: DataFrame, labels: DataFrame | None, gram: int, loss: float, slack: float) -> tuple[DataFrame, np.ndarray, float]:
    """All documents with counts and score, the weights, and the threshold."""
    texts = docs.select("doc_id", "text")
    if labels is None:
        texts = texts.withColumn("label", F.lit(-1))
    else:  # 1 good, 0 bad, -1 without a label
        usable = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
        texts = texts.join(small(materialize(usable)), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(-1)).alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                key, at = _bucket_ids(Block(part.column("text")), gram)
                raw += np.bincount(key, minlength=BUCKETS)
                ok = np.repeat(part.column("label").to_numpy() == 1, np.diff(at))
                trusted += np.bincount(key[ok], minlength=BUCKETS)
        step = BUCKETS // BLOCKS
        both = [np.concatenate([raw[b : b + step], trusted[b : b + step]]).tobytes() for b in range(0, BUCKETS, step)]
        yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array(both, pa.binary())], names=["block", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                x = np.frombuffer(body.as_buffer(), np.int64)
                total[b] = total[b] + x if b in total else x
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "body"])

    summed = texts.mapInArrow(count, "block int, body binary").repartition(BLOCKS, "block").mapInArrow(add, "block int, body binary").collect()  # BLOCKS rows, 1 MB in all
    step = BUCKETS // BLOCKS
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in summed:
        x = np.frombuffer(r["body"], np.int64)
        raw[r["block"] * step : (r["block"] + 1) * step], trusted[r["block"] * step : (r["block"] + 1) * step] = x[:step], x[step:]
    # The trusted multinomial backs off to the raw one where it has seen little.
    share = (raw + 1) / (raw.sum() + BUCKETS)
    weights = np.rint(np.log((trusted + 8 * share * BUCKETS) / (trusted.sum() + 8 * BUCKETS) / share) * UNIT).astype(np.int64)

    def fair(key: np.ndarray) -> int:
        """Weight of a trusted document under counts that leave it out."""
        k, c = np.unique(key, return_counts=True)
        w = np.log((trusted[k] - c + 8 * share[k] * BUCKETS) / (trusted.sum() - len(key) + 8 * BUCKETS) / share[k])
        return int((np.rint(w * UNIT).astype(np.int64) * c).sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block(part.column("text"))
                c, (total, n), called = base_counts(block), _weigh(block, gram, weights), part.column("label").to_numpy()
                alone = total.copy()
                if (called == 1).any():
                    key, at = _bucket_ids(block, gram)
                    for d in np.flatnonzero(called == 1).tolist():
                        alone[d] = fair(key[at[d] : at[d + 1]])
                columns = {"doc_id": part.column("doc_id"), **{k: pa.array(v) for k, v in c.items()}, "n_grams": pa.array(n), "weight": pa.array(total), "label": part.column("label"), "fair": pa.array(alone)}
                yield pa.record_batch(list(columns.values()), names=list(columns))

    scored = materialize(texts.mapInArrow(score, SCORED)).withColumn("score", F.when(F.col("n_grams") > 0, F.col("weight") / UNIT / F.col("n_grams")).otherwise(0.0))
    cut = threshold(scored, loss, slack) if labels is not None else float("-inf")
    return scored, weights, cut


def ranked(scores: DataFrame, rank: int) -> float:
    """The value of that rank (from 0) in the only column: tasks count their values in RANGES ranges, and the one that has the rank is cut again until it has one value."""
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    while lo < hi:
        edges, ends = np.linspace(lo, hi, RANGES + 1)[1:-1], (lo, hi)

        def count(batches: Iterator[pa.RecordBatch], edges: np.ndarray = edges, ends: tuple[float, float] = ends) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.sort(batch.column("s").to_numpy())
                x = x[(x >= ends[0]) & (x <= ends[1])]
                at, first, times = np.unique(np.searchsorted(edges, x, "right"), return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(at, pa.int64()), pa.array(times, pa.int64()), pa.array(x[first]), pa.array(x[first + times - 1])], names=["at", "n", "lo", "hi"])

        counted = scores.mapInArrow(count, "at long, n long, lo double, hi double").groupBy("at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        for r in sorted(counted.collect()):
            if rank < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo


def threshold(scored: DataFrame, loss: float, slack: float = SLACK) -> float:
    """From all labelled documents: below it lie as many bad and as few good (at most ``loss``) as can be.

    A document that stands in several rows counts once, with its smallest score.  The driver gets the lowest scores of good documents that
    ``loss`` allows, one in a thousand, and how many bad ones lie between them; the median is found by counts of ranges.
    Good documents without a label may score a little less than any with one: the cut is lowered by ``slack`` of its distance to the median good score.
    """
    labelled = scored.where("label >= 0 and not base_failed and n_grams > 0").groupBy("doc_id").agg(F.min(F.col("fair") / UNIT / F.col("n_grams")).alias("s"), F.max("label").alias("label"))
    own = materialize(labelled.select("s", "label"))
    n = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return float("-inf")
    low = np.array([r[0] for r in own.where("label = 1").orderBy("s").select("s").limit(int(n[1] * loss) + 1).collect()])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many scores have so many of ``low`` at or below them."""
        for batch in batches:
            at, times = np.unique(np.searchsorted(low, batch.column("s").to_numpy(), "right"), return_counts=True)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(times, pa.int64())], names=["at", "times"])

    bad = np.zeros(len(low) + 1, np.int64)
    for r in own.where("label = 0").select("s").mapInArrow(place, "at long, times long").groupBy("at").agg(F.sum("times").alias("times")).collect():
        bad[r["at"]] = r["times"]
    gain = np.cumsum(bad)[:-1] / n[0] - np.searchsorted(low, low) / n[1]
    top = float(low[int(np.argmax(gain))])
    best = own.where("label = 1").select("s")
    middle = (ranked(best, (n[1] - 1) // 2) + ranked(best, n[1] // 2)) / 2 if n[1] % 2 == 0 else ranked(best, n[1] // 2)
    drop(own)
    return top - slack * (middle - top)
