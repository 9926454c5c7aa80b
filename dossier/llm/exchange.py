"""Count or compare keys over the whole corpus and bring each answer back to the chunk that asked.

A chunk is a set of documents small enough for one task; a bucket is a range of key hashes.  Each chunk
sends each bucket in which it has keys one packed message with them, the bucket answers each message with
one packed reply, and the chunk reads the replies beside its own documents.  Nothing but these two
exchanges moves, no key or document set is ever gathered on the driver, and as a chunk sends each of its
keys once, a key that a third of all documents share costs no bucket more than one entry per chunk.

Messages number chunks times buckets at most, as blocks of any shuffle do.  Buckets are as many as their memory
asks for, not as there are chunks, and beyond CHUNKS chunks a chunk grows with the input up to MOST_CHUNK_BYTES:
up to a GB of text messages are in proportion to it, and at a TB there are 20,000 chunks and 63,000 buckets.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import U64

#: Bytes of text in a chunk: its arrays of 64-bit numbers must fit into one Python worker.
CHUNK_BYTES = 4 << 20
#: Chunks of that size at most; with more text each is larger, up to so many bytes (then a worker needs about 1 GB).
CHUNKS, MOST_CHUNK_BYTES = 8_192, 64 << 20
#: Buckets at least, and bytes of text whose keys one bucket takes.
LEAST_BUCKETS, BUCKET_BYTES = 64, 16 << 20
MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary())])
MESSAGE_SQL = "bucket int, chunk int, body binary"
#: Rows of two numbers that may go to every task: 120 MB.
SENT = 2_000_000
_MADE: list[str] = []
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by one scan that keeps nothing."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def chunks_for(df: DataFrame, column: str = "text", per: int = CHUNK_BYTES) -> int:
    return sizes_for(df, column, per)[0]


def sizes_for(df: DataFrame, column: str = "text", per: int = CHUNK_BYTES) -> tuple[int, int]:
    """How many chunks and how many buckets."""
    total = text_bytes(df, column)
    size = max(per, min(total // CHUNKS, MOST_CHUNK_BYTES))
    return max(1, -(-total // size)), max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))


def chunk_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias("chunk")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or that of checkpoint().

    In local mode one of our own is made where none is named; on a cluster that would be a folder that no other machine sees, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dossier-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: a lost executor then costs no recomputation.

    The shuffle files of the job go as it ends, as nothing reads them again; else they'd lie there until the driver collects its garbage.
    """
    conf = df.sparkSession.conf
    path, was = f"{shared_dir(df.sparkSession)}/dossier-{uuid.uuid4().hex}", conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEAN_UP, was)
    _MADE.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._made_at = path
    return out


def small(table: DataFrame) -> DataFrame:
    """A materialized table of a few numbers a row, sent to every task if it has at most SENT rows (about 60 bytes each there), else as it is."""
    return F.broadcast(table) if table.count() <= SENT else table


def made() -> list[str]:
    """The folders of all tables that this driver has materialized and not deleted, in order."""
    return list(_MADE)


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that no frame in use reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_made_at", None)
        if path in _MADE:
            forget(t.sparkSession, [path])


def forget(spark: SparkSession, paths: list[str] | None = None, keep: DataFrame | None = None) -> int:
    """Delete materialized tables (all of this driver's, or those in ``paths``) but for what ``keep`` reads; how many.

    Only for tables that no frame in use reads.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    used = {f for name in keep.inputFiles() for f in re.findall(r"dossier-[0-9a-f]{32}", name)} if keep is not None else set()
    gone = [p for p in (made() if paths is None else paths) if p in _MADE and p.rsplit("/", 1)[1] not in used]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _MADE.remove(p)
    return len(gone)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted 64-bit hashes fall into equal ranges; where each bucket begins among them (one more than there are)."""
    scaled = ((sorted_hashes >> U64(32)) * U64(buckets)) >> U64(32)
    return np.searchsorted(scaled, np.arange(buckets + 1, dtype=U64))


def messages(chunk: int, edges: np.ndarray, body: Callable[[int, int], bytes]) -> pa.Table:
    """One message per bucket that has keys; ``body`` makes that of the keys from one place to another."""
    live = [b for b in range(len(edges) - 1) if edges[b] < edges[b + 1]]
    return pa.table([pa.array(live, pa.int32()), pa.array([chunk] * len(live), pa.int32()), pa.array([body(int(edges[b]), int(edges[b + 1])) for b in live], pa.binary())], schema=MESSAGE)


def ask(docs: DataFrame, chunks: int, buckets: int, send: Callable[[pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``docs`` are dealt by chunk; ``send`` makes a chunk's messages, ``answer`` the replies to one bucket's messages."""
    return answered(docs.groupBy("chunk").applyInArrow(send, MESSAGE_SQL), chunks, buckets, answer)


def answered(sent: DataFrame, chunks: int, buckets: int, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return sent.repartition(min(chunks, buckets), "bucket").groupBy("bucket").applyInArrow(answer, MESSAGE_SQL)


def deal(df: DataFrame, chunks: int, *columns: Column | str) -> DataFrame:
    """Documents with their chunk, all of a chunk in one partition."""
    return df.select(chunk_of("doc_id", chunks), *columns).repartition(chunks, "chunk")


def read_back(docs: DataFrame, replies: DataFrame, chunks: int, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each chunk's documents beside the replies it got."""
    back = replies.repartition(chunks, "chunk")
    return docs.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(f, schema)


def bodies(table: pa.Table) -> Iterator[tuple[int, int, memoryview]]:
    """Bucket, chunk and body of each message, by bucket and chunk."""
    table = table.combine_chunks()
    b, c = table.column("bucket").to_numpy(), table.column("chunk").to_numpy()
    col = table.column("body")
    for i in np.lexsort((c, b)):
        yield int(b[i]), int(c[i]), col[int(i)].as_buffer()
