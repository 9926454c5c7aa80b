"""The training-data pipeline over ``documents``: each stage works on all that the one before kept.

Quality rules drop rejected documents; near-dedup keeps one document of each group of near
copies (5-word Jaccard of 0.8 or more, proposed by the SimHash search and, beyond its 3 bits, by MinHash); suffix-array dedup cuts
repeated passages out of texts (whole characters only, a text may end up empty); decontamination drops documents
that a benchmark item leaks into; packing places what is left.  The first four return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.decontamination import decontaminate
from dossier.llm.exchange import forget, made, materialize
from dossier.llm.near_copies import near_copy_filter
from dossier.llm.packing import best_fit_packing
from dossier.llm.quality import quality_filter
from dossier.llm.queries import tokenizer_path
from dossier.llm.suffix_dedup import suffix_array_filter

#: A passage of over 50 words is to be cut wherever it repeats; one of 51 short words has well over 200 bytes and often fewer than 400.
PASSAGE_BYTES = 200


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage that first deletes the tables which the stage before left in the shared folder, but for those that ``docs`` reads.

    What a stage returns is to be written before the next stage is called, as run() does: then nothing reads those tables any more.
    """

    def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _LEFT, keep=docs)
        before = set(made())
        out = f(spark, docs, sf_dir)
        _LEFT[:] = [t for t in made() if t not in before]
        return out

    clean.__name__, clean.__doc__ = f.__name__, f.__doc__
    return clean


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copy_filter(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_array_filter(docs, length=PASSAGE_BYTES)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]
#: No SQL can express these stages; tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each keeps is written to the shared folder and read again, then the table before it is deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, f) in enumerate(STAGES):
        out = f(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        before = set(made())
        docs = materialize(out)
        forget(spark, last)
        last = [t for t in made() if t not in before]
    return docs
