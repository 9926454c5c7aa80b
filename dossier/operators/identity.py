"""Is a file the paper it should be?  Signals from the head of its text, then an ordered verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ladder
from dossier.functions.similarity import normalized, similarity
from dossier.functions.text import is_administrative, other_dois

# Scores out of 100, a share of authors, characters of a head, characters of a title that are looked for.
TITLE_SURE, TITLE_NEAR, AUTHORS_NEAR, LEAST_HEAD, PROBE = 95, 85, 0.5, 200, 45


def compact(c: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")


def doi_in_text(doi: Column, text: Column) -> Column:
    return (compact(doi) != "") & F.contains(compact(text), compact(doi))


def title_position(title: Column, text: Column) -> Column:
    """Where a title's beginning stands, as a share of the text; -1 if nowhere.  Both are folded already."""
    at = F.instr(text, F.substring(title, 1, PROBE)) - 1
    return F.when((title == "") | (text == "") | (at < 0), F.lit(-1.0)).otherwise(F.round(at / F.length(text), 3))


def surname_present(surname: Column, text: Column) -> Column:
    """Does a folded surname of two letters or more stand in the folded text, without a letter on either side?

    Digits on a side are fine, as marks of an affiliation stick to names.
    """
    return (F.length(surname) > 1) & F.rlike(text, F.concat(F.lit("(?<![a-z])"), surname, F.lit("(?![a-z])")))


def signals(rows: DataFrame) -> DataFrame:
    """paper_id, head, doi, title, surnames, year, journal -> twelve signals."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    x = rows.withColumn("head", blank("head")).withColumn("_text", normalized("head")).withColumn("_title", normalized("title")).withColumn("_journal", normalized("journal"))
    x = x.withColumn("_names", F.filter("surnames", lambda s: F.coalesce(s, F.lit("")) != ""))
    # All names of a row are folded in one call: a character that folds to itself parts them.
    x = x.withColumn("_folded", normalized(F.array_join("_names", " 0 ")))
    names = F.transform(F.split("_folded", " 0 "), lambda s: F.trim(s))
    hits = F.filter(names, lambda s: surname_present(s, F.col("_text")))
    x = x.withColumn("author_count", F.size("_names")).withColumn("author_hits", F.size(hits)).withColumn("first_author_hit", F.coalesce(surname_present(F.get(names, F.lit(0)), F.col("_text")), F.lit(False)))
    return x.select(
        "paper_id", F.length("head").alias("head_chars"), is_administrative(F.col("head")).alias("admin_doc"), doi_in_text(F.col("doi"), F.col("head")).alias("doi_hit"), other_dois(F.coalesce("doi", F.lit("")), F.col("head")).alias("other_dois"),
        F.round(similarity(F.col("title"), F.col("head")), 1).alias("title_score"), title_position(F.col("_title"), F.col("_text")).alias("title_pos"), "first_author_hit", "author_hits", "author_count",
        F.when(F.col("author_count") > 0, F.round(F.col("author_hits") / F.col("author_count"), 3)).otherwise(0.0).alias("author_frac"), ((blank("year") != "") & F.contains("head", blank("year"))).alias("year_hit"),
        ((F.col("_journal") != "") & F.contains("_text", "_journal")).alias("journal_hit"),
    )


def verdict() -> Column:
    """struct(verdict, verdict_reason): the first rule that holds, strongest evidence first."""
    rules = [
        (F.col("head_chars") < LEAST_HEAD, "PDF_UNREADABLE", "NO_TEXT"), (F.col("admin_doc"), "MISMATCH", "ADMIN_DOCUMENT"), (F.col("doi_hit"), "VERIFIED", "DOI_MATCH"),
        ((F.col("title_score") >= TITLE_SURE) & F.col("first_author_hit"), "VERIFIED", "TITLE_AUTHOR_MATCH"), (F.col("title_score") >= TITLE_NEAR, "WEAK", "TITLE_NEAR_MATCH"),
        (F.col("first_author_hit") & (F.col("author_frac") >= AUTHORS_NEAR), "WEAK", "AUTHORS_ONLY"),
    ]
    return F.struct(ladder([(c, v) for c, v, _ in rules], "MISMATCH").alias("verdict"), ladder([(c, r) for c, _, r in rules], "NO_MATCH").alias("verdict_reason"))


def decide(rows: DataFrame) -> DataFrame:
    """All signals with the verdict and its reason."""
    return signals(rows).withColumn("v", verdict()).select("*", "v.verdict", "v.verdict_reason").drop("v")


def batch(papers: DataFrame, meta: DataFrame, heads: DataFrame) -> DataFrame:
    """Verdict of every paper: without metadata or without a file there is nothing to measure."""
    j = papers.select("paper_id").join(meta.withColumn("_meta", F.lit(True)), "paper_id", "left").join(heads.select("paper_id", "head", F.lit(True).alias("_file")), "paper_id", "left")
    measured = decide(j.where("_meta and _file").drop("_meta", "_file")).select("paper_id", "verdict", "verdict_reason")
    rest = j.where("_meta is null or _file is null")
    none = F.col("_meta").isNull()
    return measured.unionByName(rest.select("paper_id", F.when(none, "MISMATCH").otherwise("PDF_UNREADABLE").alias("verdict"), F.when(none, "NO_METADATA").otherwise("NO_FILE").alias("verdict_reason")))


def report(found: DataFrame) -> DataFrame:
    """Signals for people: the first three other DOIs in one cell."""
    return found.withColumn("other_dois", F.array_join(F.slice("other_dois", 1, 3), "; "))
