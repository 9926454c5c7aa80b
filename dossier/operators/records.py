"""Records that are written once and guarded: judgments, history, ledger rows, ids, prompts, reports of a load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.columns import blank_to_null, count_if, ladder

from .judgments import integrity

DETAIL_CHARS, BILLED_MOST = 400, 2_000
# Where each half of the corpus keeps its files.
FOLDERS = {"human_labelled": "pdfs_labelled", "unlabelled": "pdfs_unlabelled"}


class Refused(ValueError):
    """A write that would damage a record; nothing has been written."""


def append_judgments(batch: DataFrame, log: DataFrame, runs: DataFrame) -> DataFrame:
    """``batch`` with its next indices, ready to append, if every row of it is sound against the log; else nothing is appended."""
    top = log.groupBy("paper_id", "task").agg(F.max("judgment_index").alias("_top"))
    nth = F.row_number().over(Window.partitionBy("paper_id", "task").orderBy("response_id"))
    out = batch.join(top, ["paper_id", "task"], "left").withColumn("judgment_index", (F.coalesce("_top", F.lit(0)) + nth).cast("int")).drop("_top")
    bad = [r for r in integrity(log.select(*[c for c in out.columns if c in log.columns]).unionByName(out, allowMissingColumns=True), runs).collect() if r["n"]]  # a row per rule
    if bad:
        raise Refused("; ".join(f"{r['violation']}: {r['n']}" for r in bad))
    return out


def unwritten(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of a batch whose response and task the log doesn't hold yet: a batch that runs again writes nothing."""
    return batch.join(log.where("response_id is not null").select("response_id", "task").distinct(), ["response_id", "task"], "left_anti")


def response_tasks(log: DataFrame) -> DataFrame:
    """The tasks that each response has judgments for, in order."""
    return log.where("response_id is not null").groupBy("response_id").agg(F.array_join(F.array_sort(F.collect_set("task")), ";").alias("tasks"))


HISTORY_KEY = ("task", "split", "promptbook_version", "run_ids")


def history_rows(results: DataFrame, existing: DataFrame) -> DataFrame:
    """Each result's fate as an observation: refused if its configuration isn't one and known, or if it is there already; else its note beside the latest row of task and split."""
    known = existing.select(*HISTORY_KEY).distinct().withColumn("_known", F.lit(True))
    last = existing.groupBy("task", "split").agg(F.max_by(F.struct("configuration_status", "configuration_fingerprint"), "nth").alias("_last"))
    j = results.join(known, list(HISTORY_KEY), "left").join(last, ["task", "split"], "left")
    same = F.coalesce((F.col("_last.configuration_status") == "comparable") & (F.col("_last.configuration_fingerprint") == F.col("configuration_fingerprint")), F.lit(False))
    refusal = ladder([(F.col("configuration_status") != "comparable", "configuration"), (F.col("_known").isNotNull(), "duplicate")])
    note = ladder([
        (refusal.isNotNull(), ""), (F.col("_last").isNull(), "first fully-provenanced observation for this task/split"), (same, "same configuration as previous row; eligible for comparison"),
    ], "configuration changed; comparison to previous row is forbidden")
    return j.select(*results.columns, refusal.alias("refusal"), F.when(refusal.isNull() & same, "yes").otherwise("no").alias("comparable_to_previous"), note.alias("comparison_note"))


def append_history(results: DataFrame, existing: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Existing rows and new ones after them; refused as a whole if the header differs or any result is."""
    if [c for c in existing.columns if c != "nth"] != list(columns):
        raise Refused("the history has another header")
    rows = history_rows(results, existing)
    bad = [r for r in rows.where("refusal is not null").groupBy("refusal").count().collect()]  # two kinds
    if bad:
        raise Refused("; ".join(f"{r['refusal']}: {r['count']}" for r in bad))
    return existing.drop("nth").unionByName(rows.select(*columns))


def to_score(papers: DataFrame, decisions: DataFrame, again: bool = False) -> DataFrame:
    """Papers that nobody has decided yet, or all of them on request."""
    return papers if again else papers.join(decisions.select("paper_id"), "paper_id", "left_anti")


def repaired(alternatives: DataFrame) -> DataFrame:
    """The first of a paper's alternative files that verifies."""
    return alternatives.where("verdict = 'VERIFIED'").groupBy("paper_id").agg(F.min_by("file", "nth").alias("file"))


def drift(restored: DataFrame) -> DataFrame:
    """Restored files whose content differs from the archived one; blank if nothing was archived."""
    had = blank_to_null(F.col("archived_md5"))
    return restored.withColumn("drift", ladder([(had.isNull(), ""), (had == F.col("md5"), "same")], "changed"))


def file_accounts(files: DataFrame, papers: DataFrame) -> DataFrame:
    """Files without a paper and papers without a file."""
    a = files.select("paper_id").distinct().join(papers.select("paper_id"), "paper_id", "left_anti").withColumn("problem", F.lit("orphan_file"))
    return a.unionByName(papers.select("paper_id").join(files.select("paper_id"), "paper_id", "left_anti").withColumn("problem", F.lit("missing_file")))


def protected(reason: Column) -> Column:
    """Decisions by hand are kept when the library is fetched again."""
    return F.coalesce(reason, F.lit("")).startswith("MANUAL_")


def ledger_rows(checked: DataFrame) -> DataFrame:
    """Checked responses as rows of the append-only ledger; details are cut to 400 characters, as that table's rule is."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return checked.select("task", "round", "paper_id", "token", "attempt", F.when(F.col("status") == "ok", "ok").otherwise("failure").alias("outcome"), text("failure_kind").alias("failure_kind"), F.substring(text("detail"), 1, DETAIL_CHARS).alias("detail"), text("exit_code").alias("exit_code"), "raw_path")


def response_id(run: Column, paper: Column, attempt: Column, provider: Column) -> Column:
    """The provider's id if it gave one, else one made from run, paper and attempt; hashed, so both have one shape."""
    own = blank_to_null(provider)
    return F.concat(F.lit("response-"), F.sha2(F.coalesce(F.concat(F.lit("provider:"), own), F.concat_ws(":", F.lit("attempt"), run, paper, attempt.cast("string"))), 256))


def blinded_token(seed: Column, text: Column, tries: int = 8) -> Column:
    """16 hex digits that stand nowhere in the text: the first of ``tries`` from a seed; null if each is in it."""
    made = [F.substring(F.sha2(F.concat(seed, F.lit(f":{i}")), 256), 1, 16) for i in range(tries)]
    return F.coalesce(*(F.when(~F.contains(F.coalesce(text, F.lit("")), t), t) for t in made))


def prompt(token: Column, paper: Column, promptbook: Column, task: Column) -> Column:
    """One request: the criteria before the paper and again after it, the paper between marks that name its token."""
    mark = lambda word: F.concat(F.lit(f"<<{word} "), token, F.lit(">>"))
    allowed = F.when(task == "exclusion", "yes, no, undecidable, wrong_text").otherwise("yes, no, undecidable")
    ask = F.concat(F.lit("Task: "), task, F.lit(". Answer with one of: "), allowed, F.lit(". Echo paper_id "), token, F.lit("."))
    return F.concat_ws("\n\n", promptbook, mark("PAPER"), paper, mark("END"), promptbook, ask)


def request_schema(*tasks: str) -> dict:
    """JSON Schema of an answer to one task, or to several at once as named halves."""
    def half(task: str) -> dict:
        decisions = ["yes", "no", "undecidable", *(["wrong_text"] if task == "exclusion" else [])]
        fields = {"decision": {"type": "string", "enum": decisions}, "reasoning": {"type": "string", "minLength": 1, "maxLength": 200}, "promptbook_evidence": {"type": "string", "minLength": 1}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}}
        return {"type": "object", "additionalProperties": False, "properties": fields, "required": list(fields)}

    if len(tasks) == 1:
        return half(tasks[0])
    return {"type": "object", "additionalProperties": False, "properties": {t: half(t) for t in tasks}, "required": list(tasks)}


def preflight_ok(billed: Column) -> Column:
    """A first call that reports more input than the pinned prompt needs was not the call that was meant; silence is no pass."""
    return F.coalesce(billed <= BILLED_MOST, F.lit(False))


def extraction_report(papers: DataFrame, extracted: DataFrame) -> DataFrame:
    """A row per paper: extracted ones with characters per page, all others as missing."""
    j = papers.select("paper_id").join(extracted, "paper_id", "left")
    return j.select("paper_id", F.when(F.col("method").isNull(), "missing").otherwise("extracted").alias("state"), F.when(F.coalesce("pages", F.lit(0)) > 0, F.bround(F.col("chars") / F.col("pages"), 0).cast("long")).otherwise(0).alias("chars_per_page"))


def load_report(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row about a load of labels: rows, papers, rows without a paper, rows nobody reviewed, papers that were dropped."""
    gone = manifest.where("verdict = 'DROPPED'").select("paper_id").withColumn("_gone", F.lit(True))
    j = rows.join(gone, "paper_id", "left")
    has = F.coalesce("paper_id", F.lit("")) != ""
    return j.agg(F.count("*").alias("n"), F.countDistinct(F.when(has, F.col("paper_id"))).alias("papers"), count_if(~has).alias("unresolved"), count_if(F.col("labeled") == "0").alias("pending"), count_if(F.col("_gone").isNotNull()).alias("dropped"))


def folder_of(half: Column) -> Column:
    """Where a half of the corpus keeps its files; an unknown half is an error."""
    return ladder([(half == k, v) for k, v in FOLDERS.items()], F.raise_error(F.concat(F.lit("unknown set "), F.coalesce(half, F.lit("null")))).cast("string"))


def run_log(sent: DataFrame, no_text: DataFrame) -> DataFrame:
    """All papers of a round: those without text stay in the log, so the denominator doesn't shrink."""
    return sent.select("paper_id", F.lit("sent").alias("state")).unionByName(no_text.select("paper_id", F.lit("no_text").alias("state")))
