"""Append-only judgments and attempts: latest per key, next index, integrity, retries, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.columns import count_if, ladder, ratio

RETRYABLE = ("process", "parse", "semantic")


def latest_judgments(judgments: DataFrame, *keys: str, version: str | None = None) -> DataFrame:
    """The judgment with the highest index per key.  A version narrows the scope before the maximum is taken.

    A maximum of structs combines before the shuffle, so a key with very many judgments costs no long window.
    """
    scope = judgments if version is None else judgments.where(F.col("promptbook_version") == version)
    rest = [c for c in scope.columns if c not in keys and c != "judgment_index"]
    top = scope.groupBy(*keys).agg(F.max(F.struct("judgment_index", *rest)).alias("top"))
    return top.select(*keys, "top.*")


def next_index(judgments: DataFrame, papers: DataFrame) -> DataFrame:
    """The index that a paper's next judgment gets: one above the highest so far, 1 if there is none."""
    top = judgments.groupBy("paper_id", "task").agg(F.max("judgment_index").alias("top"))
    return papers.join(top, ["paper_id", "task"], "left").select("paper_id", "task", (F.coalesce("top", F.lit(0)) + 1).alias("next_index"))


def integrity(judgments: DataFrame, runs: DataFrame) -> DataFrame:
    """Violations of the log's constraints by kind; a count of zero for each means a sound log.

    Rules about single rows are counted in one scan beside their runs; the two about repeats group by their keys.
    """
    known = runs.select("run_id", F.col("task").alias("run_task"), F.lit(True).alias("known"))
    j = judgments.join(known, "run_id", "left")
    rules = {
        "unknown_run": F.col("run_id").isNotNull() & F.col("known").isNull(), "run_of_other_task": F.col("known").isNotNull() & (F.col("task") != F.col("run_task")),
        "decision_outside_vocabulary": ~F.col("decision").isin("yes", "no", "undecidable", "wrong_text") | (F.col("decision") == "wrong_text") & (F.col("task") != "exclusion"), "confidence_outside_bounds": (F.col("confidence") < 0) | (F.col("confidence") > 1),
    }
    one = j.agg(*(count_if(c).alias(k) for k, c in rules.items()))
    out = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("violation"), F.col(k).alias("n")) for k in rules))).alias("x")).select("x.*")
    for kind, rows, key in (("repeated_key", judgments, ["paper_id", "task", "judgment_index"]), ("repeated_response", judgments.where("response_id is not null"), ["response_id", "task"])):
        twice = rows.groupBy(*key).agg(F.count("*").alias("k")).agg(count_if(F.col("k") > 1).alias("n"))
        out = out.unionByName(twice.select(F.lit(kind).alias("violation"), "n"))
    return out


def _newest() -> Column:
    return F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("attempt"), F.desc("started_at"), F.desc("event_id")))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """Per paper the attempt with the highest number, then start, then place in the log; blank papers are left out."""
    return attempts.where("coalesce(paper_id, '') <> ''").withColumn("nth", _newest()).where("nth = 1").drop("nth")


def superseded_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.where("coalesce(paper_id, '') <> ''").withColumn("nth", _newest()).where("nth > 1").drop("nth")


def retry_rate(attempts: DataFrame) -> DataFrame:
    """Attempts, papers, retries and their rate (4 places, null without attempts)."""
    a = attempts.agg(F.count("*").alias("attempts"), F.countDistinct("paper_id").alias("papers"), count_if(F.col("attempt") > 1).alias("retries"))
    return a.withColumn("retry_rate", F.round(ratio(F.col("retries"), F.col("attempts")), 4))


def retry_by_kind(attempts: DataFrame) -> DataFrame:
    return attempts.where("attempt > 1").groupBy(F.coalesce(F.nullif("failure_kind", F.lit("")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def retry_state(latest: DataFrame, most: int = 3) -> DataFrame:
    """What is to be done with each paper's latest attempt."""
    retryable = F.col("failure_kind").isin(*RETRYABLE)
    eligible = retryable & (F.col("attempt") < most)
    state = ladder([(eligible, "retry"), (retryable, "review_required")], "accepted")
    return latest.select("paper_id", "attempt", "failure_kind", state.alias("state"))


def last_decisions(log: DataFrame) -> DataFrame:
    """The last decision per paper by its timestamp as text, then by place in the log."""
    place = Window.partitionBy("paper_id").orderBy(F.desc("decided_at"), F.desc("seq"))
    return log.withColumn("nth", F.row_number().over(place)).where("nth = 1").drop("nth")


def history(observations: DataFrame) -> DataFrame:
    """Each observation beside the one before it of the same task and split; comparable if both are and share a fingerprint."""
    before = Window.partitionBy("task", "split").orderBy("seq")
    rows = observations.withColumn("previous_accuracy", F.lag("accuracy").over(before)).withColumn("was", F.lag("fingerprint").over(before)).withColumn("was_ok", F.lag("comparable").over(before))
    return rows.withColumn("comparable_to_previous", F.coalesce(F.col("comparable") & F.col("was_ok") & (F.col("was") == F.col("fingerprint")), F.lit(False))).drop("was", "was_ok")
