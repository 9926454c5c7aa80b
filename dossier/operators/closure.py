"""Closure checklists: named assertions over the whole corpus, every one of them answered before anything is refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import blank_to_null, count_if
from dossier.functions.text import is_correction

from .corpus import collisions, cross_set

# Reasons that no reader could judge; characters below which a text is a notice or a stub; identifiers that no two papers share.
NONJUDGEABLE = ("protocol_paper", "duplicate_group_random_drop")
LEAST_CHARS = 3000
IDENTIFIERS = ("doi", "pmid", "pmcid", "md5")


def _check(tag: str, rows: DataFrame, bad: Column | None = None, key: str = "paper_id") -> DataFrame:
    """How many rows offend, and the first eight of their keys."""
    if bad is not None:
        rows = rows.where(bad)
    g = rows.agg(F.count("*").alias("offending"), F.min(F.col(key).cast("string")).alias("first"))
    return g.select(F.lit(tag).alias("tag"), "offending", (F.col("offending") == 0).alias("ok"), "first")


def _pairs(papers: DataFrame) -> DataFrame:
    return papers.withColumns({c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in IDENTIFIERS})


def labelled_set(papers: DataFrame, labels: DataFrame, texts: DataFrame, queue: DataFrame, reviewed: DataFrame, flagged: DataFrame, disagreements: DataFrame, unjoined: DataFrame, duplicates: DataFrame, merged: DataFrame, ledger: DataFrame) -> DataFrame:
    """C1 to C14 over the labelled half of the manifest."""
    mine = papers.where("set = 'human_labelled'")
    active = mine.where("verdict <> 'DROPPED'")
    ids = active.select("paper_id")
    thin = ids.join(texts.select("paper_id", "chars"), "paper_id", "left").where(F.col("chars").isNull() | (F.col("chars") < LEAST_CHARS))
    has = lambda c: blank_to_null(F.col(c)).isNotNull()
    out, power, stats = has("exclusion_reason"), has("power"), has("stats")
    words = F.coalesce(F.lower(F.trim("power")), F.lit("")).isin("", "yes", "no") & F.coalesce(F.lower(F.trim("stats")), F.lit("")).isin("", "yes", "no")
    shared = collisions(_pairs(active), *IDENTIFIERS).select(F.concat_ws("=", "field", "value").alias("paper_id"))
    still = duplicates.select("paper_id").distinct().join(ids, "paper_id", "left_semi").join(merged.select(F.col("removed").alias("paper_id")), "paper_id", "left_anti")
    flags = duplicates.agg(F.floor(F.count("*") / 2).alias("most"))
    pairs = still.agg(F.count("*").alias("n"), F.min("paper_id").alias("first")).crossJoin(F.broadcast(flags))  # one row each
    over = pairs.select(F.lit("C12").alias("tag"), F.greatest(F.col("n") - F.col("most"), F.lit(0)).alias("offending"), (F.col("n") <= F.col("most")).alias("ok"), F.when(F.col("n") > F.col("most"), F.col("first")).alias("first"))
    held = labels.agg(count_if(F.col("split").isNull()).alias("unsplit"), count_if((F.col("split") == "holdout") & ~out).alias("held"))
    split = held.select(F.lit("C13").alias("tag"), F.col("unsplit").alias("offending"), ((F.col("unsplit") == 0) & (F.col("held") > 0)).alias("ok"), F.lit(None).cast("string").alias("first"))
    one_way = ids.join(labels.select("paper_id"), "paper_id", "left_anti").unionByName(labels.select("paper_id").join(ids, "paper_id", "left_anti"))
    return reduce(DataFrame.unionByName, [
        _check("C1", one_way), _check("C2", active, F.col("verdict") != "VERIFIED"), _check("C3", queue.where("set = 'human_labelled'").join(reviewed.select("paper_id"), "paper_id", "left_anti").select("paper_id").distinct()),
        _check("C4", ids.join(flagged.where("set = 'human_labelled'").select("paper_id"), "paper_id", "left_semi")), _check("C5", thin), _check("C6", labels, F.col("exclusion_reason").isin(*NONJUDGEABLE)),
        _check("C7", labels, F.when(out, power | stats).otherwise(~(power & stats))), _check("C8", labels, ~words), _check("C9", shared), _check("C10", ids.join(disagreements.select("paper_id"), "paper_id", "left_semi")),
        _check("C11", unjoined, key="citation_raw"), over, split, _check("C14", ids.join(ledger.where("set = 'human_labelled'").select("paper_id"), "paper_id", "left_semi")),
    ])


def unlabelled_set(papers: DataFrame, labels: DataFrame, texts: DataFrame, queue: DataFrame, decisions: DataFrame, flagged: DataFrame, removed: DataFrame, restored: DataFrame, ledger: DataFrame, files: DataFrame, documented: int) -> DataFrame:
    """U1 to U12 over the unlabelled half; ``documented`` is the published number of active papers."""
    mine = papers.where("set = 'unlabelled'")
    active = mine.where("verdict <> 'DROPPED'")
    ids = active.select("paper_id")
    thin = ids.join(texts.select("paper_id", "chars"), "paper_id", "left").where(F.col("chars").isNull() | (F.col("chars") < LEAST_CHARS))
    settled = decisions.where(F.col("decision").isin("replaced", "dropped")).select("paper_id")
    open_flags = ids.join(flagged.where("set = 'unlabelled'").select("paper_id"), "paper_id", "left_semi").join(settled, "paper_id", "left_anti")
    shared = collisions(_pairs(active), *IDENTIFIERS).select(F.concat_ws("=", "field", "value").alias("paper_id"))
    both = cross_set(_pairs(papers.where("verdict <> 'DROPPED'")), "unlabelled", "human_labelled", *IDENTIFIERS)
    gone = removed.select(F.col("removed").alias("paper_id"), F.col("kept").alias("twin"))
    back = gone.select("paper_id").distinct().join(papers.select("paper_id"), "paper_id", "left_semi").join(restored.select("paper_id"), "paper_id", "left_anti")
    orphaned = gone.join(labels.select(F.col("paper_id").alias("twin")), "twin", "left_anti").join(papers.select("paper_id"), "paper_id", "left_anti")
    stray = files.select("paper_id").distinct().join(mine.select("paper_id"), "paper_id", "left_anti").unionByName(ids.join(files.select("paper_id"), "paper_id", "left_anti"))
    count = active.agg(F.count("*").alias("n")).select(F.lit("U12").alias("tag"), F.abs(F.col("n") - documented).alias("offending"), (F.col("n") == documented).alias("ok"), F.lit(None).cast("string").alias("first"))
    return reduce(DataFrame.unionByName, [
        _check("U1", thin), _check("U2", active, F.col("verdict") != "VERIFIED"), _check("U3", queue.where("set = 'unlabelled'").join(decisions.select("paper_id"), "paper_id", "left_anti").select("paper_id").distinct()), _check("U4", open_flags),
        _check("U5", active, is_correction(F.col("title"))), _check("U6", shared), _check("U7", both), _check("U8", back), _check("U9", orphaned), _check("U10", ids.join(ledger.where("set = 'unlabelled'").select("paper_id"), "paper_id", "left_semi")), _check("U11", stray), count,
    ])


def summary(checked: DataFrame) -> DataFrame:
    """How many checks there are, which fail, and whether the set is closed."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("tag")))), ";")  # a row per check, a dozen in all
    return checked.agg(F.count("*").alias("checks"), count_if(~F.col("ok")).alias("failed_n"), failed.alias("failed"), F.bool_and("ok").alias("closed"))


def restore_preview(removed: DataFrame, restored: DataFrame, labels: DataFrame) -> DataFrame:
    """Removed papers whose twin lost its label and that nobody restored, by the first 70 characters of the reason."""
    left = removed.join(labels.select(F.col("paper_id").alias("kept")), "kept", "left_anti").join(restored.select(F.col("paper_id").alias("removed")), "removed", "left_anti")
    return left.groupBy(F.substring("reason", 1, 70).alias("reason")).agg(F.count("*").alias("n"))
