"""The corpus of papers: manifest updates, duplicates, drops, ledger, closure checks, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import count_if, ladder


def upsert(old: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """New rows replace old ones with the same key, all others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def apply_verdicts(manifest: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set the verdict where a decision differs; say what was done with each decided paper."""
    d = decisions.select("paper_id", F.col("verdict").alias("decided"))
    j = manifest.join(d, "paper_id", "left")
    done = ladder([(F.col("decided").isNull(), "untouched"), (F.col("decided") == F.col("verdict"), "already")], "changed")
    return j.select("paper_id", F.coalesce("decided", "verdict").alias("verdict"), done.alias("action"))


def drop_plan(manifest: DataFrame, reasons: DataFrame) -> DataFrame:
    """Papers to drop with their first reason: those not dropped yet that a reason names."""
    first = reasons.groupBy("paper_id").agg(F.min(F.struct("rank", "reason")).alias("top"))
    return manifest.where("verdict <> 'DROPPED'").join(first, "paper_id").select("paper_id", "verdict", F.col("top.reason").alias("reason"))


def identifiers(papers: DataFrame, *names: str) -> DataFrame:
    """One row per paper and identifier that it has."""
    items = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names))
    return papers.select("paper_id", "set", F.explode(items).alias("i")).select("paper_id", "set", "i.field", "i.value").where("coalesce(value, '') <> ''")


def collisions(papers: DataFrame, *names: str) -> DataFrame:
    """Identifiers that more than one paper carries."""
    g = identifiers(papers, *names).groupBy("field", "value").agg(F.countDistinct("paper_id").alias("n_papers"), F.min("paper_id").alias("first_paper"))
    return g.where("n_papers > 1")


def cross_set(papers: DataFrame, a: str, b: str, *names: str) -> DataFrame:
    """Papers of set ``a`` that share any identifier with set ``b``, with the fields that say so.

    Sets are compared by identifier with both sides aggregated first, so a common identifier makes no pairs.
    """
    i = identifiers(papers, *names)
    both = i.groupBy("field", "value").agg(count_if(F.col("set") == b).alias("in_b")).where("in_b > 0").select("field", "value")
    hit = i.where(F.col("set") == a).join(both, ["field", "value"], "left_semi")
    return hit.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ";").alias("fields"))


def merge_pairs(members: DataFrame) -> DataFrame:
    """Pairs of duplicates with exactly two members, one of them labelled: keep that one, remove the other."""
    lab = F.col("set") == "human_labelled"
    g = members.groupBy("pair_id").agg(F.count("*").alias("n"), count_if(lab).alias("n_kept"), F.max(F.when(lab, F.col("paper_id"))).alias("keep"), F.max(F.when(~lab, F.col("paper_id"))).alias("remove"))
    return g.where("n = 2 and n_kept = 1").select("pair_id", "keep", "remove")


def orphans(removed: DataFrame, labels: DataFrame) -> DataFrame:
    """Removed papers whose kept twin has no label."""
    return removed.join(labels.select(F.col("paper_id").alias("keep")), "keep", "left_anti")


def ledger(*branches: tuple[str, str, DataFrame]) -> DataFrame:
    """All exclusions: (stage, decided_by, rows with paper_id and reason)."""
    out = None
    for stage, by, rows in branches:
        one = rows.select("paper_id", F.lit(stage).alias("stage"), F.lit(by).alias("decided_by"), F.col("reason").cast("string").alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


def ledger_by_rules(manifest: DataFrame, *rules: tuple[str, str, Column, Column]) -> DataFrame:
    """The same where all branches read the manifest: one scan, a row for each rule (stage, decided_by, condition, reason) that holds."""
    items = F.array(*(F.when(c, F.struct(F.lit(stage).alias("stage"), F.lit(by).alias("decided_by"), reason.cast("string").alias("reason"))) for stage, by, c, reason in rules))
    return manifest.select("paper_id", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("r")).select("paper_id", "r.*")


def reconcile(manifest: DataFrame, book: DataFrame) -> DataFrame:
    """Do dropped papers of the manifest and papers of the ledger account for each other?"""
    dropped = manifest.where("verdict = 'DROPPED'").select("paper_id", F.lit(1).alias("d"))
    listed = book.select("paper_id").distinct().withColumn("l", F.lit(1))
    totals = manifest.select("paper_id", "verdict", "status").join(dropped, "paper_id", "left").join(listed, "paper_id", "left")
    g = totals.agg(
        F.count("*").alias("manifest_n"), count_if(F.col("d").isNotNull()).alias("dropped_n"), count_if(F.col("l").isNotNull()).alias("listed_n"), count_if(F.col("d").isNotNull() & F.col("l").isNull()).alias("dropped_unlisted"),
        count_if(F.col("d").isNull() & F.col("l").isNotNull()).alias("listed_active"), count_if(F.col("d").isNull() & (F.col("status") == "OK")).alias("active_n"),
    )
    return g.withColumn("reconciles", (F.col("dropped_unlisted") == 0) & (F.col("listed_active") == 0))


def checks(*named: tuple[str, DataFrame, Column]) -> DataFrame:
    """A row per check: its tag, how many rows offend, and whether none does."""
    out = None
    for tag, rows, bad in named:
        one = rows.agg(count_if(bad).alias("offending")).select(F.lit(tag).alias("tag"), "offending", (F.col("offending") == 0).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def source_summary(rows: DataFrame) -> DataFrame:
    """Counts per source and a TOTAL row."""
    g = rows.rollup("source").agg(F.count("*").alias("n"), count_if(F.col("labelled")).alias("labelled"), count_if(F.col("excluded")).alias("excluded"), count_if(F.col("labelled") & ~F.col("excluded")).alias("kept"))
    return g.withColumn("source", F.coalesce("source", F.lit("TOTAL")))


def subtree(edges: DataFrame, root: str) -> DataFrame:
    """Every node below ``root`` with its path; edges are (node, parent).

    Level by level inside Spark, up to its recursion limits (spark.sql.cteRecursionLevelLimit, 100 levels, and
    spark.sql.cteRecursionRowLimit, a million rows unless set); a deeper or larger tree is an error, never a part of it.
    """
    return edges.sparkSession.sql("""WITH RECURSIVE t(node, path, depth) AS (
        SELECT node, node AS path, 0 AS depth FROM {edges} WHERE node = :root UNION ALL
        SELECT e.node, concat(t.path, '/', e.node), t.depth + 1 FROM {edges} e JOIN t ON e.parent = t.node) SELECT node, path, depth FROM t""", {"root": root}, edges=edges)
