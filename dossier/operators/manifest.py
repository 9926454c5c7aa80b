"""Manifest filters, coverage, extraction flags, resuming, fingerprints and registration of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.columns import blank_to_null, count_if, ladder, ratio
from dossier.functions.text import is_correction

KNOWN_VERDICTS = ("VERIFIED", "WEAK", "DROPPED", "MISMATCH", "PDF_UNREADABLE")


def active(papers: DataFrame) -> DataFrame:
    return papers.where("verdict <> 'DROPPED'")


def extractable(papers: DataFrame) -> DataFrame:
    """Papers to extract; an unknown verdict is an error, not a paper to skip."""
    known = F.when(F.col("verdict").isin(*KNOWN_VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit("null")))).cast("string"))
    return papers.withColumn("verdict", known).where(F.col("verdict").isin("VERIFIED", "WEAK"))


def extraction_flag(method: Column, title: Column, chars: Column) -> Column:
    return ladder([(method == "none", "FAILED"), (is_correction(title), "CORRECTION"), ((method == "ocr") | (chars < 3000), "THIN")], "OK")


def sparse(chars: Column, pages: Column, least: int = 200) -> Column:
    return F.when(pages > 0, chars / F.nullif(pages, F.lit(0)) < least).otherwise(True)


def outstanding(wanted: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """What is still to be done: inputs without a finished output under the same key and content hash."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def coverage(papers: DataFrame, *names: str) -> DataFrame:
    return papers.agg(F.count("*").alias("n"), *(ratio(count_if(blank_to_null(F.col(c)).isNotNull()), F.count("*")).alias(f"{c}_share") for c in names))


def histogram(rows: DataFrame, *fields: str) -> DataFrame:
    """How often each value of each field stands there, blanks under one name."""
    items = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(blank_to_null(F.col(f)), F.lit("(blank)")).alias("value")) for f in fields))
    return rows.select(F.explode(items).alias("i")).groupBy("i.field", "i.value").agg(F.count("*").alias("n"))


def label_counts(labels: DataFrame) -> DataFrame:
    has = lambda c: blank_to_null(F.col(c)).isNotNull()
    return labels.agg(F.count("*").alias("n"), count_if(has("exclusion_reason")).alias("excluded"), count_if(has("power")).alias("with_power"), count_if(has("stats")).alias("with_stats"), count_if(F.col("split") == "build").alias("build"), count_if(F.col("split") == "holdout").alias("holdout"))


def describe(row_reason: Column, power: Column, stats: Column, category: Column | None = None) -> Column:
    """One line for people about a row's answer."""
    reason = blank_to_null(row_reason)
    kind = F.lit(None).cast("string") if category is None else blank_to_null(category)
    kept = F.concat_ws(" ", F.concat(F.lit("kept, power="), F.coalesce(blank_to_null(power), F.lit("?"))), F.concat(F.lit("data="), F.coalesce(blank_to_null(stats), F.lit("?"))), F.concat(F.lit("category="), kind))
    return F.when(reason.isNotNull(), F.concat(F.lit("excluded ("), reason, F.lit(")"))).otherwise(kept)


def format_tokens(n: Column) -> Column:
    """184000 -> 184k, 2500000 -> 2.5M, smaller as they are."""
    return ladder([(n.isNull(), "unknown"), (n >= 1_000_000, F.format_string("%.1fM", n / 1e6)), (n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k")))], n.cast("string"))


def fingerprint(*fields: str) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; nulls leave no trace, as absent settings do."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def run_id(task: Column, number: Column, environment: Column) -> Column:
    return F.concat(F.lit("run-"), task, F.lit("-r"), number.cast("string"), F.lit("-"), F.substring(F.sha2(environment, 256), 1, 20))


def snapshot_id(rows: DataFrame, order: str, *fields: str) -> DataFrame:
    """One hash per group over its rows in order; a group is one run's index.

    Rows are hashed one by one and their hashes gathered in order: 64 characters a row, whatever a row holds.
    """
    each = F.sha2(F.to_json(F.struct(order, *fields)), 256)
    items = F.transform(F.sort_array(F.collect_list(F.struct(order, each.alias("h")))), lambda x: x["h"])
    return rows.groupBy("task").agg(F.sha2(F.array_join(items, "\n"), 256).alias("snapshot"), F.count("*").alias("n"))


def registration(old: DataFrame, new: DataFrame, key: str, *fields: str) -> DataFrame:
    """Registering a run again: new, the same (nothing to do) or a conflict in named fields."""
    was = old.select(key, F.lit(True).alias("known"), *(F.col(f).alias(f"was_{f}") for f in fields))
    j = new.join(was, key, "left")
    differs = F.array_join(F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"was_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), ";")
    state = ladder([(F.col("known").isNull(), "new"), (differs == "", "same")], "conflict")
    return j.select(key, state.alias("state"), F.when(state == "conflict", differs).otherwise("").alias("fields"))


def mixed_preparation(rows: DataFrame, group: str, method: str) -> DataFrame:
    """Groups whose texts were prepared in more than one way (blank: not at all) are refused."""
    m = F.coalesce(blank_to_null(F.col(method)), F.lit("unprepared"))
    return rows.groupBy(group).agg(F.countDistinct(m).alias("methods"), F.array_join(F.array_sort(F.collect_set(m)), ";").alias("names")).withColumn("refused", F.col("methods") > 1)


def leaked_ids(replies: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of other papers that a reply names: words of the reply joined to the ids, not every id searched in every reply."""
    words = replies.select("paper_id", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"\w+"), F.lit(0)))).alias("named"))
    return words.join(known.select(F.col("paper_id").alias("named")), "named").where("named <> paper_id").groupBy("paper_id").agg(F.count("*").alias("n_leaked"), F.min("named").alias("first_leaked"))


def severity(attempts: DataFrame) -> DataFrame:
    """Failures of each round by kind; one FATAL attempt (tools, provenance, leaked ids, a foreign token) voids the whole round."""
    kinds = ("process", "parse", "semantic", "truncation", "incomplete", "FATAL")
    g = attempts.groupBy("round").agg(F.count("*").alias("n"), *(count_if(F.col("failure_kind") == k).alias(f"n_{k.lower()}") for k in kinds))
    return g.withColumn("discarded", F.col("n_fatal") > 0)


def rule_texts(lines: DataFrame) -> DataFrame:
    """(book, nth, value) lines of a promptbook -> its rules: a list item ``N. **E5.`` begins one, a heading or unindented line ends it.

    A promptbook is a page or two; the window runs inside one book.
    """
    begin = F.regexp_extract("value", r"^\s*[0-9]+\.\s+\*\*([EPD][0-9]{1,2})\.", 1)
    ends = F.col("value").rlike(r"^(#|\S)") & (begin == "")
    order = Window.partitionBy("book").orderBy("nth")
    x = lines.withColumn("mark", F.when(begin != "", begin).when(ends, "-"))
    x = x.withColumn("rule", F.last("mark", ignorenulls=True).over(order)).withColumn("part", F.count("mark").over(order))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("nth", F.trim("value").alias("v")))), lambda p: p["v"])
    g = x.where("rule <> '-' and trim(value) <> ''").groupBy("book", "rule", "part").agg(F.array_join(parts, " ").alias("text"))
    return g.select("book", "rule", F.regexp_replace("text", r"^[0-9]+\.\s+", "").alias("text"))
