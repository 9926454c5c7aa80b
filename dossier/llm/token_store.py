"""Token ids in a content-addressed store.

Each document's ids, with an end id, are cut into chunks where a rolling hash over the last ``WINDOW`` ids meets a
pattern, so equal passages give equal chunks wherever they stand.  A chunk's address is the SHA-256 of its bytes; each
address is stored once.  A document is a recipe: the addresses of its chunks in order.  The store has three tables
under its folder, written by Spark's own writer, so any file system that Spark knows will do:

    chunks/    address, ids (little-endian, 2 bytes each, or 4 if one doesn't fit), width, n
    recipes/   part, nth, doc_id, n_tokens, chunks (addresses): parts hold ascending ranges of doc_id, rows ascend by nth
    manifest/  part, first and last doc_id, documents, tokens, root (Merkle root over the part's recipes)

Reading verifies: each chunk's bytes against its address, each part's recipes against its root.  A document's checksum
is put together from those of its chunks (checksums of parts combine), so chunks are read where they lie and
never gathered by document.  Copies of a chunk are dropped in each task first and then by address, so a
document that a third of all rows repeat sends one chunk per task.

Defined results: a null text is an empty one and holds just the end id; rows with equal doc_id follow each other in
any order, each with its own start; a null doc_id stands first; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import shared_dir
from .text import U64, mix, slices, window_hash
from .tokens import open_tokenizer

WINDOW, LEAST, MEAN, MOST = 16, 256, 1024, 8192
RAW = "kind int, address binary, ids binary, width int, n int, doc_id long, n_tokens long, chunks array<binary>"


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document: from LEAST to MOST ids each (the last may be shorter)."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    marks = np.flatnonzero(window_hash(mix(ids.astype(U64)), WINDOW) % U64(MEAN) == 0) + WINDOW if n >= WINDOW else np.zeros(0, int)
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST and m < n:
            last = m
            ends.append(m)
    return ends + [n] * (last < n)


def _bytes(ids: np.ndarray) -> tuple[bytes, int]:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return ids.astype(f"<u{width}").tobytes(), width


def _address(body: bytes, width: int) -> bytes:
    return hashlib.sha256(bytes([width]) + body).digest()


def encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Recipes (kind 0) and, once per task, each chunk (kind 1)."""
    tokens, sent = open_tokenizer(tokenizer), set()
    kind = pa.schema([("kind", pa.int32()), ("address", pa.binary()), ("ids", pa.binary()), ("width", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.binary()))])
    for batch in batches:
        for part in slices(batch, "text"):
            ids, at = tokens.encode(part.column("text"))
            rows = []
            for d, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own, recipe, last = np.append(ids[a:b], np.uint32(end_id)), [], 0
                for e in cut_points(own):
                    body, width = _bytes(own[last:e])
                    address = _address(body, width)
                    recipe.append(address)
                    if address not in sent:
                        sent.add(address)
                        rows.append((1, address, body, width, e - last, None, None, None))
                    last = e
                rows.append((0, None, None, None, None, d, len(own), recipe))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], schema=kind)


def _merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _leaf(doc_id: int | None, n: int, chunks: list[bytes]) -> bytes:
    return b"".join([repr((doc_id, n)).encode(), *chunks])


MANIFEST = "part int, first_id long, last_id long, documents long, tokens long, root binary"


def _roots(table: pa.Table) -> pa.Table:
    """The manifest row of one part."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("nth", "doc_id", "n_tokens", "chunks"))))
    ids = [r[1] for r in rows if r[1] is not None]
    root = _merkle([_leaf(d, n, c) for _, d, n, c in rows])
    return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([min(ids, default=None)], pa.int64()), pa.array([max(ids, default=None)], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([sum(r[2] for r in rows)], pa.int64()), pa.array([root], pa.binary())], names=["part", "first_id", "last_id", "documents", "tokens", "root"])


def write_store(docs: DataFrame, tokenizer: str, *, end_id: int = 2, folder: str | None = None, per_part: int = 20_000, per_part_chunks: int = 400_000) -> str:
    """Write the store and return its folder (a new one in the shared folder unless named)."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"
    found = docs.select("doc_id", "text").mapInArrow(lambda it: encode(it, tokenizer, end_id), RAW)
    # One exchange: chunks by address, recipes anywhere.
    by = F.when(F.col("kind") == 1, F.xxhash64("address")).otherwise(F.xxhash64("doc_id", "n_tokens"))
    spread = found.repartition(max(8, docs.rdd.getNumPartitions()), by).sortWithinPartitions("kind", "address")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            address = batch.column("address").to_pylist()
            keep = [a is None or a != b for a, b in zip(address, [last, *address])]
            last = address[-1] if address else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    spread.mapInArrow(once, RAW).write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/raw")
    raw = docs.sparkSession.read.schema(RAW).parquet(f"{folder}/raw")
    recipes = raw.where("kind = 0").select("doc_id", "n_tokens", "chunks")
    size = recipes.agg(F.count("*").alias("n"), F.sum(F.size("chunks")).alias("chunks")).first()
    parts = max(1, -(-size["n"] // per_part), -(-(size["chunks"] or 0) // per_part_chunks))
    ranged = recipes.repartitionByRange(parts, "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "chunks").withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id() % F.lit(1 << 33))
    ranged.select("part", "nth", "doc_id", "n_tokens", "chunks").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _recipes(docs.sparkSession, folder).groupBy("part").applyInArrow(_roots, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, nth long, doc_id long, n_tokens long, chunks array<binary>").parquet(f"{folder}/recipes")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RAW).parquet(f"{folder}/raw").where("kind = 1").select("address", "ids", "width", "n")


def verify(spark: SparkSession, folder: str) -> None:
    """Raise unless the manifest describes the recipes."""
    now = _recipes(spark, folder).groupBy("part").applyInArrow(_roots, MANIFEST)
    then = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if not now.exceptAll(then).isEmpty() or not then.exceptAll(now).isEmpty():
        raise ValueError("recipes and manifest differ")


# Checksums of two runs of bytes give that of both: multiplication of polynomials over GF(2), bits reversed.
_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the CRC-32 polynomial, elementwise."""
    out, b = np.zeros(len(a), np.uint32), b.copy()
    for i in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


def combine_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of first + second, where the second parts have ``size`` bytes."""
    shift, power = np.full(len(first), 1 << 31, np.uint32), np.full(len(first), 1 << 23, np.uint32)  # 1, and x**8
    size = size.copy()
    while size.any():
        shift = np.where(size & 1, _times(shift, power), shift)
        power, size = _times(power, power), size >> 1
    return _times(shift, first.astype(np.uint32)) ^ second.astype(np.uint32)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (ids as little-endian 32 bits) of each document, from the files alone."""
    verify(spark, folder)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            address, crc, n = batch.column("address").to_pylist(), [], []
            for a, body, w in zip(address, batch.column("ids").to_pylist(), batch.column("width").to_pylist()):
                if _address(body, w) != a:
                    raise ValueError(f"chunk {a.hex()} is damaged")
                ids = np.frombuffer(body, f"<u{w}").astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
            yield pa.record_batch([batch.column("address"), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["address", "crc", "n"])

    checked = read_chunks(spark, folder).select("address", "ids", "width").mapInArrow(sums, "address binary, crc long, n long")
    recipes = _recipes(spark, folder)
    pieces = recipes.select("part", "nth", F.posexplode("chunks").alias("at", "address")).join(checked, "address")
    whole = pieces.groupBy("part", "nth").agg(F.sort_array(F.collect_list(F.struct("at", "crc", "n"))).alias("parts"))
    joined = whole.select("part", "nth", "parts.crc", "parts.n")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, n = batch.column("crc"), batch.column("n")
            at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(crc).to_numpy())]).astype(np.int64)
            c, k = crc.flatten().to_numpy().astype(np.uint32), n.flatten().to_numpy()
            out, step = c[at[:-1]].copy(), 1
            while (live := np.flatnonzero(at[:-1] + step < at[1:])).size:
                out[live] = combine_crc(out[live], c[at[live] + step], 4 * k[at[live] + step])
                step += 1
            size = np.add.reduceat(k, at[:-1]) if len(out) else k[:0]
            yield pa.record_batch([batch.column("part"), batch.column("nth"), pa.array(out.astype(np.int64)), pa.array(size)], names=["part", "nth", "ids_crc32", "held"])

    read = joined.mapInArrow(total, "part int, nth long, ids_crc32 long, held long")
    # Starts: sums of the parts before (a row per part), then a running sum inside each part.
    sums_of = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = sums_of.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = recipes.select("part", "nth", "doc_id", inner.alias("inner"), "n_tokens").join(before, "part").join(read, ["part", "nth"])
    damaged = F.raise_error(F.concat(F.lit("chunks of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" don't add up")))
    return rows.select("doc_id", (F.col("before") + F.col("inner")).alias("start"), F.when(F.col("held") == F.col("n_tokens"), F.col("n_tokens")).otherwise(damaged.cast("long")).alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of each document, put together from its chunks."""
    pieces = _recipes(spark, folder).select("part", "nth", "doc_id", F.posexplode("chunks").alias("at", "address")).join(read_chunks(spark, folder), "address")
    whole = pieces.groupBy("part", "nth", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "width"))).alias("parts"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["ids"], f"<u{p['width']}").astype(np.int64) for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return whole.select("doc_id", "parts").mapInArrow(put, "doc_id long, ids array<long>")
