"""Readers and writers of a corpus' files: strict and lenient CSV, JSON lines, upserts by staging, versions, LaTeX tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.citations import strip_latex
from dossier.operators.corpus import upsert


def exists(spark: SparkSession, path: str) -> bool:
    """Asked through Spark's own file systems, so any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, columns: list[str], strict: bool = False) -> DataFrame:
    """All columns as text under the given names, blank cells as blank texts; a missing file is an empty table, or refused if ``strict``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"').fillna("")


def read_map(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """A CSV table with one row per key, the last of the file; a missing file is empty."""
    if not exists(spark, path):
        return read_csv(spark, path, columns)
    rows = read_csv(spark, path, columns).withColumn("_nth", F.monotonically_increasing_id())
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), "_nth").alias("r")).select(key, "r.*").select(*columns)


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """One object per line, blank lines skipped; with a key the last line of each key wins; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("nth", F.monotonically_increasing_id())
    rows = lines.select("nth", F.from_json("value", schema).alias("r")).select("nth", "r.*")
    if key is None:
        return rows.drop("nth")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "nth")]), "nth").alias("r")).select(key, "r.*")


def _fs(spark: SparkSession, path: str):  # noqa: ANN202  a JVM object
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a versioned table's newest complete version; null if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    done = [x.getPath().getName() for x in fs.listStatus(p) if re.fullmatch(r"v[0-9]{8}", x.getPath().getName()) and exists(spark, f"{x.getPath()}/_SUCCESS")]
    return f"{path}/{max(done)}" if done else None


def write_version(rows: DataFrame, path: str, form: str = "parquet", keep: int = 2) -> str:
    """Write a table's next version and return its folder.

    Each version is a folder of its own that counts from the moment its job has committed (its _SUCCESS file), so at any time
    readers find a whole version, the one before until then.  Of older ones the last ``keep`` stay for readers that are under way.
    """
    spark = rows.sparkSession
    fs, p = _fs(spark, path)
    names = sorted(n for n in ([x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []) if re.fullmatch(r"v[0-9]{8}", n))
    target = f"{path}/v{int(names[-1][1:]) + 1 if names else 1:08d}"
    rows.write.format(form).mode("errorifexists").save(target)
    for n in names[: -keep or None]:
        fs.delete(_fs(spark, f"{path}/{n}")[1], True)
    return target


def write_upsert(new: DataFrame, path: str, key: str, form: str = "parquet", keep: int = 2) -> str:
    """Merge rows into a versioned table by key: its next version has all rows with new keys replaced or added."""
    at = current(new.sparkSession, path)
    merged = upsert(new.sparkSession.read.schema(new.schema).format(form).load(at), new, key) if at else new
    return write_version(merged, path, form, keep)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet") -> DataFrame:
    """The newest version of a table that write_upsert makes; empty if there is none."""
    at = current(spark, path)
    return spark.read.schema(schema).format(form).load(at) if at else spark.createDataFrame([], schema)


def append_new(rows: DataFrame, path: str, *key: str) -> None:
    """Append rows whose key the table doesn't hold yet."""
    if exists(rows.sparkSession, path):
        rows = rows.join(rows.sparkSession.read.parquet(path).select(*key).distinct(), list(key), "left_anti")
    rows.write.mode("append").parquet(path)


def add_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive migration: columns of ``schema`` that are missing come as nulls; none is taken away."""
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns))


def newest(names: DataFrame, pattern: str) -> DataFrame:
    """Of file names with a number in them (first group), the one with the highest."""
    n = F.regexp_extract("name", pattern, 1)
    return names.where(n != "").agg(F.max_by("name", n.cast("long")).alias("name"), F.max(n.cast("long")).alias("version"))


def read_latex_table(lines: DataFrame, least: int = 20, width: int = 22) -> DataFrame:
    """(file, nth, value) lines of tables -> one row per ``% Entry N note`` comment: the next line with at least ``least`` ampersands, as ``width`` fields.

    Rule lines and comments are no rows.  A file's lines have one order; the window runs inside one file.
    """
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(""))
    line = F.trim("value")
    entry = F.regexp_extract(line, r"^%\s*Entry\s+([0-9]+)", 1)
    note = F.regexp_replace(F.regexp_extract(line, r"^%\s*Entry\s+[0-9]+(.*)$", 1), r"^[ -]+|[ -]+$", "")
    rule = line.rlike(r"^\\\\?(?:hline|toprule|midrule|bottomrule|cline)") | line.startswith("%")
    order = Window.partitionBy("file").orderBy("nth")
    x = lines.withColumn("head", F.when(entry != "", F.struct("nth", entry.cast("int").alias("entry"), note.alias("note"))))
    x = x.withColumn("head", F.last("head", ignorenulls=True).over(order)).where(F.col("head").isNotNull() & ~rule & (F.regexp_count("value", F.lit("&")) >= least))
    first = x.groupBy("file", "head").agg(F.min_by(line, "nth").alias("row"))
    fields = F.transform(F.split(strip_latex(F.col("row")), "&"), lambda x: F.trim(x))
    padded = F.slice(F.concat(fields, F.array_repeat(F.lit(""), width)), 1, width)
    return first.select("file", F.col("head.entry").alias("entry"), F.col("head.note").alias("note"), F.regexp_extract("row", r"\\cite\{([^}]+)\}", 1).alias("cite_key"), padded.alias("fields"))


def read_exclusions(rows: DataFrame, file: str) -> DataFrame:
    """Rows of a list of exclusions that has identifiers -> label rows cited as ``author (year)``."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    cited = F.when(text("year") != "", F.concat(text("first_author"), F.lit(" ("), text("year"), F.lit(")"))).otherwise(text("first_author"))
    return rows.select(F.lit(file).alias("source_file"), cited.alias("citation_raw"), text("citation_key").alias("cite_key"), text("exclusion_reason").alias("exclusion_reason_raw"), text("doi").alias("source_doi"), text("pmid").alias("source_pmid"))


TASKS = ("exclusion", "power_analysis", "data_analysis")


def partition_of(path: str) -> dict[str, str]:
    """Task, version and round of a file name ``<task>[_v<n>]_r<n>``."""
    m = re.search(rf"(?:^|/)({'|'.join(TASKS)})(?:_(v[0-9]+))?_r([0-9]+)(?:\.[a-z]+)?$", path)
    if not m:
        raise ValueError(f"no task and round in {path}")
    return {"task": m[1], "version": m[2] or "", "round": m[3]}


def discover(paths: list[str]) -> list[tuple[str, dict[str, str]]]:
    """All paths whose name says task and round, by task, round and version."""
    found = []
    for p in paths:
        try:
            found.append((p, partition_of(p)))
        except ValueError:
            continue
    return sorted(found, key=lambda x: (x[1]["task"], int(x[1]["round"]), x[1]["version"]))


def locate(paths: list[str], task: str, round_: int, version: str | None = None) -> str:
    """The one path of a task and round (and version); none or several are refused."""
    own = [p for p, m in discover(paths) if m["task"] == task and int(m["round"]) == round_ and version in (None, m["version"])]
    if len(own) != 1:
        raise ValueError(f"{len(own)} files for {task} round {round_}: {own}")
    return own[0]


__all__ = ["add_columns", "append_new", "current", "discover", "exists", "locate", "newest", "partition_of", "read_csv", "read_exclusions", "read_json_lines", "read_latex_table", "read_map", "read_table", "write_upsert", "write_version"]
