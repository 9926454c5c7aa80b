"""Evaluation of judgments against labels: confusion counts, agreement, intervals, calibration, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import count_if, joined_set, ladder, ratio, wilson

ABSTAIN = ("undecidable", "wrong_text")
OUTCOMES = ("false_negative", "false_positive", "undecidable", "wrong_text", "missing", "unlabeled", "true_positive", "true_negative")


def expected_decision(task: str) -> Column:
    """What a label row says for a task; null without an answer."""
    if task == "exclusion":
        return F.when(F.coalesce(F.col("exclusion_reason"), F.lit("")) != "", "yes").otherwise("no")
    return F.nullif(F.lower(F.trim(F.col("power" if task == "power_analysis" else "stats"))), F.lit(""))


def four_way(truth: Column, decision: Column) -> Column:
    yes, said = truth == "yes", decision == "yes"
    return ladder([(yes & said, "true_positive"), (yes & (decision == "no"), "false_negative"), ((truth == "no") & said, "false_positive"), ((truth == "no") & (decision == "no"), "true_negative")])


def _outcome() -> Column:
    return ladder([
        (F.col("truth").isNull(), "unlabeled"), (F.col("judged").isNull(), "missing"), (F.col("decision").isin(*ABSTAIN), F.col("decision")),
        (F.col("decision").isin("yes", "no"), four_way(F.col("truth"), F.col("decision"))),
    ], "unlabeled")


def cases(labels: DataFrame, latest: DataFrame, task: str) -> DataFrame:
    """Labels first: every eligible label gets a row, missing judgments too; judgments without truth are unlabeled."""
    truth = labels.select("paper_id", expected_decision(task).alias("truth")).where("truth is not null")
    said = latest.select("paper_id", "decision", "confidence", "run_id", F.lit(True).alias("judged"))
    joined = truth.join(said, "paper_id", "full_outer")
    return joined.select("paper_id", "truth", "decision", "confidence", "run_id", _outcome().alias("outcome"), F.coalesce("judged", F.lit(False)).alias("judged"))


def cases_by_task(labels: DataFrame, latest: DataFrame, *tasks: str) -> DataFrame:
    """The cases of several tasks in one pass over labels and judgments."""
    answers = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), expected_decision(t).alias("truth")) for t in tasks)))
    truth = labels.select("paper_id", answers.alias("a")).select("paper_id", "a.task", "a.truth").where("truth is not null")
    said = latest.select("paper_id", "task", "decision", "confidence", F.lit(True).alias("judged"))
    return truth.join(said, ["paper_id", "task"], "full_outer").select("task", "paper_id", "truth", "decision", "confidence", _outcome().alias("outcome"))


def confusion(found: DataFrame, *by: str) -> DataFrame:
    of = {"tp": "true_positive", "tn": "true_negative", "fp": "false_positive", "fn": "false_negative", "undecidable": "undecidable", "wrong_text": "wrong_text", "missing": "missing", "unlabeled": "unlabeled"}
    return found.groupBy(*by).agg(count_if(F.col("truth").isNotNull()).alias("eligible"), *(count_if(F.col("outcome") == v).alias(k) for k, v in of.items()))


def rates(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    scored = tp + tn + fp + fn
    out = counts.withColumn("scored", scored).withColumn("judged_eligible", F.col("eligible") - F.col("missing"))
    named = {
        "accuracy": ratio(tp + tn, scored), "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, "coverage": ratio(F.col("judged_eligible"), F.col("eligible")), "scoreable_coverage": ratio(scored, F.col("eligible")),
    }
    return out.withColumns(named)


def kappa(counts: DataFrame) -> DataFrame:
    """Chance-corrected agreement; null if nothing is scored or chance alone would agree."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = F.nullif(tp + tn + fp + fn, F.lit(0.0))
    po, pe = (tp + tn) / n, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)
    return counts.select(po.alias("observed"), pe.alias("expected"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def intervals(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    pairs = {"accuracy": (tp + tn, tp + tn + fp + fn), "sensitivity": (tp, tp + fn), "specificity": (tn, tn + fp)}
    columns = []
    for name, (k, n) in pairs.items():
        low, high = wilson(k, n)
        columns += [low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    return counts.select(*columns)


def confidence_summary(found: DataFrame) -> DataFrame:
    """Over eligible judged papers, abstentions included."""
    c = F.when(F.col("truth").isNotNull() & F.col("judged"), F.col("confidence"))
    return found.agg(F.count(c).alias("n"), F.min(c).alias("lowest"), F.max(c).alias("highest"), F.avg(c).alias("mean"), F.countDistinct(c).alias("distinct_n"))


def scored_with_confidence(found: DataFrame) -> DataFrame:
    right = F.col("outcome").isin("true_positive", "true_negative")
    return found.where(F.col("outcome").isin("true_positive", "true_negative", "false_positive", "false_negative") & F.col("confidence").isNotNull()).withColumn("correct", right.cast("double"))


def _bounds(found: DataFrame, n: int, first: float, step: float, name: str) -> DataFrame:
    """A few fixed literals, rounded as they are written."""
    return F.broadcast(found.sparkSession.createDataFrame([(i, round(first + i * step, 2)) for i in range(n)], f"bin int, {name} double"))


def calibration_bins(found: DataFrame) -> DataFrame:
    """Ten bins of width 0.1 by comparison with their bounds; the last is closed."""
    bins = _bounds(found, 10, 0.0, 0.1, "lower").withColumn("upper", F.round(F.col("lower") + 0.1, 2))
    c = F.col("confidence")
    inside = (c >= F.col("lower")) & ((c < F.col("upper")) | (F.col("bin") == 9) & (c <= 1.0))
    grouped = scored_with_confidence(found).join(bins, inside).groupBy("bin", "lower", "upper")
    return grouped.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy"))


def calibration_summary(found: DataFrame) -> DataFrame:
    """Mean confidence, accuracy, their gap, Brier score and expected calibration error: sums per bin, then over the bins, in one pass over the cases."""
    c = F.col("confidence")
    of = F.least(F.floor(F.round(c * 10, 9)), F.lit(9))  # a bin's bounds are tenths
    bins = scored_with_confidence(found).groupBy(of.alias("bin")).agg(F.count("*").alias("k"), F.sum(c).alias("c"), F.sum("correct").alias("r"), F.sum(F.pow(c - F.col("correct"), 2)).alias("b"))
    n = F.sum("k")
    return bins.agg(n.alias("n"), (F.sum("c") / n).alias("mean_confidence"), (F.sum("r") / n).alias("accuracy"), (F.sum("b") / n).alias("brier"), (F.sum("c") / n - F.sum("r") / n).alias("gap"), (F.sum(F.abs(F.col("c") - F.col("r"))) / n).alias("ece"))


def thresholds(found: DataFrame) -> DataFrame:
    """For cuts .50 to .95: how many scored papers fall below, and how good the rest is."""
    cuts = _bounds(found, 10, 0.5, 0.05, "threshold").drop("bin")
    x = scored_with_confidence(found).crossJoin(cuts)
    kept, o = F.col("confidence") >= F.col("threshold"), F.col("outcome")
    n = {k: count_if(kept & (o == v)) for k, v in {"tp": "true_positive", "tn": "true_negative", "fp": "false_positive", "fn": "false_negative"}.items()}
    g = x.groupBy("threshold").agg(F.count("*").alias("n"), count_if(~kept).alias("low_n"), *(v.alias(k) for k, v in n.items()))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return g.select("threshold", "low_n", ratio(F.col("low_n"), F.col("n")).alias("low_rate"), (tp + tn + fp + fn).alias("retained_n"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"))


def configuration(latest: DataFrame, runs: DataFrame) -> DataFrame:
    """Which configurations the latest judgments come from, all of them, and whether they compare."""
    j = latest.join(runs.select("run_id", "config_fingerprint", "effort", "model"), "run_id", "left")  # Spark broadcasts the runs while they are few
    g = j.agg(F.count("*").alias("judgments"), count_if(F.col("config_fingerprint").isNull()).alias("unprovenanced"), F.countDistinct("config_fingerprint").alias("configs"), *(joined_set(F.col(c)).alias(c + "s") for c in ("run_id", "effort", "model", "promptbook_version")))
    status = ladder([
        (F.col("judgments") == 0, "no_judgments"), (F.col("configs") == 0, "unprovenanced_legacy"), (F.col("unprovenanced") > 0, "mixed_with_unprovenanced"), (F.col("configs") > 1, "mixed_configuration"),
    ], "comparable")
    return g.withColumn("status", status)


def judgment_first(labels: DataFrame, latest: DataFrame, task: str) -> DataFrame:
    """The other accuracy: judgments first, abstentions counted before the truth is looked for."""
    truth = labels.select("paper_id", expected_decision(task).alias("truth"), F.lit(True).alias("labelled"))
    x = latest.join(truth, "paper_id", "left")
    outcome = ladder([(F.col("labelled").isNull(), "unlabeled"), (F.col("decision").isin(*ABSTAIN), "abstained"), (F.col("truth").isNull(), "unlabeled"), (F.col("truth") == F.col("decision"), "correct")], "wrong")
    g = x.groupBy().agg(*(count_if(outcome == k).alias(k) for k in ("correct", "wrong", "abstained", "unlabeled")))
    return g.withColumn("accuracy", ratio(F.col("correct"), F.col("correct") + F.col("wrong")))


def status(judged: Column, truth: Column, decision: Column) -> Column:
    """How a case counts: missing, abstained, not_scored, scored, invalid or unlabeled."""
    return ladder([(truth.isNull(), "unlabeled"), (~judged, "missing"), (decision == "undecidable", "abstained"), (decision == "wrong_text", "not_scored"), (decision.isin("yes", "no"), "scored")], "invalid")


def undecidable_rate(counts: DataFrame) -> DataFrame:
    return counts.withColumn("undecidable_rate", ratio(F.col("undecidable"), F.col("eligible") - F.col("missing")))


def review_outcomes(found: DataFrame) -> DataFrame:
    """How many cases stand under each heading, in the order of review."""
    order = F.array_position(F.array(*(F.lit(o) for o in OUTCOMES)), F.col("outcome"))
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.max("confidence").alias("top_confidence")).withColumn("review_order", order)
