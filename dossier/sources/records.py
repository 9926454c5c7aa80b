"""Files of one record each, run records, promptbooks, logs, reports, and SQLite databases."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dossier.operators.corpus import upsert

from .tables import _fs, exists, read_table, write_version


def read_papers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file -> rows with paper_id, the file's name; broken bytes become U+FFFD, broken files null fields."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.json)?$", 1)
    body = F.from_json(F.make_valid_utf8(F.col("content").cast("string")), schema)
    return files.select(name.alias("paper_id"), body.alias("r")).select("paper_id", "r.*")


def write_papers(rows: DataFrame, path: str, key: str = "paper_id") -> None:
    """One JSON object per row in a folder of its key, written anew: ``<path>/<key>=<value>/``."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    rows.select(key, body.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; an empty file makes no row."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def read_environment(spark: SparkSession, path: str) -> dict:
    """A run's record; without one, or with a broken one, nothing of that run may be scored."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: nothing records the conditions of this run")
    try:
        return json.loads(read_text(spark, path))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from e


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's own file systems: written beside its place, then renamed; a failed rename raises."""
    fs, target = _fs(spark, path)
    _, staged = _fs(spark, f"{path}.partial")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(staged, target):
        raise OSError(f"{path} can't be replaced")


def write_environment(spark: SparkSession, path: str, record: dict) -> None:
    write_text(spark, path, json.dumps(record, indent=2, sort_keys=True) + "\n")


def resolve_promptbook(spark: SparkSession, root: str, task: str, version: str | None = None) -> tuple[str, str]:
    """Version and text of the promptbook in force, which the file CURRENT names, or of a version; each step may refuse."""
    if version is None:
        if not exists(spark, f"{root}/CURRENT"):
            raise FileNotFoundError(f"{root}/CURRENT: nothing names the promptbook in force")
        version = read_text(spark, f"{root}/CURRENT").strip()
        if not version:
            raise ValueError(f"{root}/CURRENT is empty")
    if not exists(spark, f"{root}/{version}"):
        raise FileNotFoundError(f"{root}/{version} does not exist")
    if not exists(spark, f"{root}/{version}/{task}.md"):
        raise FileNotFoundError(f"{version} has no {task} promptbook")
    return version, read_text(spark, f"{root}/{version}/{task}.md")


def write_projection(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A CSV table with these columns in this order; others are left out, missing ones are blank."""
    have = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    rows.select(*have).fillna("").write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def complete_log(new: DataFrame, path: str, manifest: DataFrame, reason: str, key: str = "paper_id") -> DataFrame:
    """A log that tells of every paper dropped for ``reason``: old rows and new ones, without papers that are back."""
    spark = new.sparkSession
    merged = upsert(read_table(spark, path, new.schema), new, key)
    still = manifest.where((F.col("verdict") == "DROPPED") & (F.col("verdict_reason") == reason)).select(key)
    at = write_version(merged.join(still, key, "left_semi").select(*new.columns), path)
    return spark.read.schema(new.schema).parquet(at)


def json_report(metrics: DataFrame, **tables: DataFrame) -> dict:
    """One row of metrics per task with the tables about it, as nested records; all of them are small aggregates."""
    out = {r["task"]: r.asDict(recursive=True) for r in metrics.collect()}
    for name, rows in tables.items():
        for r in rows.collect():
            out[r["task"]].setdefault(name, []).append({k: v for k, v in r.asDict(recursive=True).items() if k != "task"})
    return out


def markdown_report(title: str, sections: Sequence[tuple[str, DataFrame]], most: int = 1_000) -> str:
    """Sections with a table each; a report holds aggregates, so more than ``most`` rows are an error."""
    cell = lambda v: "\u2014" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    parts = [f"# {title}"]
    for name, rows in sections:
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{name} is no summary: over {most} rows")
        lines = [f"## {name}", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in found)]
        parts.append("\n".join(lines))
    return "\n\n".join(parts) + "\n"


def html_report(title: str, sections: Sequence[tuple[str, DataFrame]], most: int = 1_000) -> str:
    """The same as a page: every cell escaped, so nothing in a table can become markup."""
    parts = [f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, rows in sections:
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{name} is no summary: over {most} rows")
        line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
        show = lambda v: "\u2014" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
        parts.append(f"<h2>{escape(name)}</h2><table>{line(rows.columns, 'th')}{''.join(line(map(show, r), 'td') for r in found)}</table>")
    return "".join(parts) + "</body></html>\n"


def output_name(split: str, version: str | None, stamp: str) -> str:
    """Folder of an evaluation: ``<split>_<version>_<stamp>``."""
    return "_".join((split, version or "latest_any_version", stamp))


def latex_table(rows: DataFrame, most: int = 1_000) -> str:
    """A small aggregate as a tabular, with the characters escaped that LaTeX reserves."""
    escaped = str.maketrans({c: "\\" + c for c in "&%$#_{}"})
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows")
    body = [" & ".join("" if v is None else str(v).translate(escaped) for v in r) + r" \\" for r in [rows.columns, *found]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", *body, r"\end{tabular}"]) + "\n"


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.count = path, table, columns, parts

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.count))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as con:
            yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class Sqlite(DataSource):
    """``spark.read.format("dossier_sqlite").option("path", file).option("table", name).load()``: read by ranges of rowid.

    The file must lie where every machine finds it.  Register with spark.dataSource.register(Sqlite).
    """

    _KINDS = (("INT", T.LongType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("BLOB", T.BinaryType()))

    @classmethod
    def name(cls) -> str:
        return "dossier_sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            found = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], next((t for k, t in self._KINDS if k in (r[2] or "").upper()), T.StringType())) for r in found])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"], self.options["table"], schema.fieldNames(), int(self.options.get("parts", "8")))


def write_sqlite(rows: DataFrame, path: str, table: str, key: Sequence[str] = ()) -> int:
    """Insert rows into a table of a database in one transaction, replacing those with the same key; how many there were.

    A database of this kind has one writer, so rows stream through the driver, a partition at a time.
    """
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB", "boolean": "INTEGER"}
    columns = ", ".join(f'"{n}" {kinds.get(t, "TEXT")}' for n, t in rows.dtypes)
    primary = f", PRIMARY KEY ({', '.join(key)})" if key else ""
    con, n = sqlite3.connect(path), 0
    try:
        with con:
            con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({columns}{primary})')
            marks = ", ".join("?" * len(rows.columns))
            for r in rows.toLocalIterator():
                con.execute(f'INSERT OR REPLACE INTO "{table}" VALUES ({marks})', tuple(r))
                n += 1
    finally:
        con.close()
    return n
