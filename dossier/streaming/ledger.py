"""The append-only ledger as a stream: parsed events, latest attempt per paper, appends that happen once.

Batch and stream share their operators; a stream adds a schema, a watermark-free running state per paper and
idempotent batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def read_ledger(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Files of attempts as they land."""
    return spark.readStream.schema(schema).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of event files as they land; broken or half-written lines are no objects and drop out."""
    v = spark.readStream.text(path).withColumn("v", F.try_parse_json("value")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return v.select("value", F.expr("try_variant_get(v, '$.type', 'string')").alias("kind"))


def latest(attempts: DataFrame) -> DataFrame:
    """Running latest attempt per paper; state is one row per paper."""
    top = F.max(F.struct("attempt", "started_at", "event_id", "failure_kind")).alias("top")
    return attempts.where("coalesce(paper_id, '') <> ''").groupBy("paper_id").agg(top).select("paper_id", "top.*")


def token_totals(replies: DataFrame) -> DataFrame:
    """Running totals with the number of replies that report nothing; those are not counted as zero."""
    cost = F.sum(F.col("cost")) if "cost" in replies.columns else F.lit(None).cast("double")
    return replies.groupBy("task").agg(F.sum("billed_input").alias("billed_input"), F.count("*").alias("replies"), F.count(F.when(F.col("billed_input").isNull(), 1)).alias("unreported"), cost.alias("cost"))


PARTS = 64


def append_once(stream: DataFrame, path: str, checkpoint: str, *key: str) -> DataStreamWriter:
    """Append rows whose key was never written, each batch to folders by part of the key and number of the batch.

    A batch reads the earlier rows of those parts only in which it has keys, and of them the keys; its own folders it writes anew, so
    a batch that runs again changes nothing, wherever the run before it stopped.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int").alias("part")

    def write(batch: DataFrame, number: int) -> None:
        from dossier.sources.tables import exists

        spark = batch.sparkSession
        rows = batch.dropDuplicates(list(key)).withColumn("part", part).withColumn("batch", F.lit(number).cast("long"))
        if exists(spark, path):
            own = [r["part"] for r in rows.select("part").distinct().collect()]  # PARTS at most
            done = spark.read.option("basePath", path).schema(rows.schema).parquet(path).where(F.col("part").isin(own) & (F.col("batch") != number))
            rows = rows.join(done.select(*key), list(key), "left_anti")
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_to_end(writer: DataStreamWriter, after: Callable[[], None] | None = None) -> None:
    """Process what is there, then stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if after:
        after()
