"""Deterministic, stratified splits and fixed evaluation rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.columns import count_if, hash_rank, ladder


#: Ranges of hash ranks that strata are cut into: a stratum's order is made part by part, never in one task.
PARTS = 256


def _placed(labels: DataFrame, seed: str) -> DataFrame:
    """Each label's place in its stratum by hash rank (then id) and the stratum's size.

    Ranks lie evenly in [0, 1), so a stratum falls into PARTS ranges; places inside a range come from a window over the
    range, those before it from the counts of all ranges, a few hundred rows.
    """
    ranked = labels.withColumn("rank", hash_rank(F.col("paper_id"), seed)).withColumn("_part", F.floor(F.col("rank") * PARTS).cast("int"))
    sums = ranked.groupBy("stratum", "_part").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("stratum")
    before = sums.select("stratum", "_part", (F.sum("_n").over(by.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("size"))
    inside = F.row_number().over(Window.partitionBy("stratum", "_part").orderBy("rank", "paper_id"))
    return ranked.withColumn("_nth", inside).join(before, ["stratum", "_part"]).withColumn("place", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before", "rank")


def assign_split(labels: DataFrame, seed: str, holdout: float) -> DataFrame:
    """Within each stratum the lowest hash ranks are held out: round-half-even(holdout * n) of them."""
    held = F.col("place") <= F.bround(F.lit(holdout) * F.col("size"), 0)
    return _placed(labels, seed).select(*labels.columns, F.when(held, "holdout").otherwise("build").alias("split"))


def interleave(labels: DataFrame, seed: str, size: int = 50) -> DataFrame:
    """Strata mixed evenly: the i-th of n stands at (i - 1/2) / n; then rounds of ``size`` in that order."""
    spread = _placed(labels, seed).withColumn("position", (F.col("place") - F.lit(0.5)) / F.col("size")).withColumn("_part", F.floor(F.col("position") * PARTS).cast("int"))
    sums = spread.groupBy("_part").agg(F.count("*").alias("_n"))  # at most PARTS rows
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("position", "stratum", "paper_id"))
    nth = (F.col("_before") + F.col("_nth")).cast("int")
    x = spread.withColumn("_nth", inside).join(before, "_part").withColumn("nth", nth)
    return x.withColumn("round", (F.floor((F.col("nth") - 1) / size) + 1).cast("int")).select("paper_id", "stratum", "nth", "round")


def load_rounds(wanted: DataFrame, rounds: DataFrame, labels: DataFrame, verdicts: DataFrame, cached: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Each round that is asked for (task, round): how many papers it keeps and skips, or the first refusal, which holds for the whole round.

    Order: B3 no such round; B10 a paper stands in it twice; then paper by paper as listed (``nth``): B8 dropped papers are skipped,
    B2 no label or no split, B1 another split than build, B4 an excluded paper in an analysis, B7 no cached text; last B5 other members than ``expected``.
    """
    r = wanted.join(rounds, ["task", "round"])
    times = r.groupBy("task", "round", "paper_id").agg(F.count("*").alias("_times"), F.min("nth").alias("nth"))
    lab = labels.select("paper_id", F.trim(F.coalesce("split", F.lit(""))).alias("_split"), F.coalesce("exclusion_reason", F.lit("")).alias("_reason"), F.lit(True).alias("_label"))
    j = times.join(lab, "paper_id", "left").join(verdicts.select("paper_id", F.upper(F.trim(F.coalesce("verdict", F.lit("")))).alias("_verdict")), "paper_id", "left").join(cached.select("paper_id").distinct().withColumn("_text", F.lit(True)), "paper_id", "left")
    skipped = F.coalesce(F.col("_verdict") == "DROPPED", F.lit(False))
    split = F.col("_split")
    case = ladder([
        (skipped, None), (F.col("_label").isNull(), "B2"), (split == "", "B2"), (split == "holdout", "B1"), (split != "build", "B1"), ((F.col("task") != "exclusion") & (F.col("_reason") != ""), "B4"), (F.col("_text").isNull(), "B7"),
    ])
    j = j.withColumn("_case", case).withColumn("_skipped", skipped)
    bad = F.when(F.col("_case").isNotNull(), F.struct("nth", "paper_id", F.col("_case").alias("case")))
    per = [count_if(~F.col("_skipped")).alias("kept"), count_if(F.col("_skipped")).alias("skipped"), F.max("_times").alias("_times"), F.min(bad).alias("_bad")]
    if expected is not None:
        seen = j.join(expected.select("task", "round", "paper_id", F.lit(True).alias("_expected")), ["task", "round", "paper_id"], "full_outer")
        off = (F.col("_expected").isNull() & ~F.col("_skipped")) | (F.col("_expected").isNotNull() & F.coalesce(F.col("_skipped"), F.lit(True)))
        g = seen.groupBy("task", "round").agg(*per, count_if(off).alias("_off"))
    else:
        g = j.groupBy("task", "round").agg(*per, F.lit(0).alias("_off"))
    out = wanted.join(g, ["task", "round"], "left")
    refusal = ladder([(F.col("_times").isNull(), "B3"), (F.col("_times") > 1, "B10"), (F.col("_bad").isNotNull(), F.col("_bad.case")), (F.col("_off") > 0, "B5")])
    done = refusal.isNull()
    return out.select("task", "round", F.when(done, F.col("kept")).alias("kept"), F.when(done, F.col("skipped")).alias("skipped"), refusal.alias("refusal"), F.when(refusal == F.col("_bad.case"), F.col("_bad.paper_id")).alias("refused_paper"))


def combined_round(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rounds' lists (nth, paper_id, stratum, skipped) as one: DC54 unless they agree paper by paper, in order, with the same skips."""
    place = lambda d, p: d.select("nth", *(F.col(c).alias(f"{p}_{c}") for c in ("paper_id", "stratum", "skipped")))
    j = place(a, "a").join(place(b, "b"), "nth", "full_outer")
    differs = F.lit(False)
    for c in ("paper_id", "stratum", "skipped"):
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return j.agg(F.count("*").alias("places"), count_if(differs).alias("differing"), F.min(F.when(differs, F.col("nth"))).alias("first_difference")).withColumn("refusal", F.when(F.col("differing") > 0, "DC54"))


def same_membership(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: papers only in one of two rounds."""
    left = a.select("paper_id").distinct().withColumn("in_a", F.lit(1))
    right = b.select("paper_id").distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, "paper_id", "full_outer")
    return both.agg(F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_b"), F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("both_n"))


def membership_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The papers that only one of two rounds has, and which."""
    left, right = a.select("paper_id").distinct(), b.select("paper_id").distinct()
    only = lambda x, y, side: x.join(y, "paper_id", "left_anti").withColumn("only_in", F.lit(side))
    return only(left, right, "a").unionByName(only(right, left, "b"))
