"""What people read: review tables in their order, vocabulary, cited rules, reports, and picks by priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.columns import blank_to_null, count_if, ladder, ratio
from dossier.functions.text import YEAR, field_value, identifiers, normalize_doi

from .evaluate import expected_decision, four_way

# Worst outcomes first; words for stored answers, by task; link modes, best first.
ORDER = ("false_negative", "false_positive", "undecidable", "wrong_text", "failed", "unlabelled", "true_positive", "true_negative")
WORDS = {"exclusion": {"yes": "exclude", "no": "keep"}, "analysis": {"yes": "correct", "no": "flawed"}}
HEADINGS = {
    "exclusion": {"true_positive": "Correctly excluded", "true_negative": "Correctly kept", "false_positive": "Wrongly excluded", "false_negative": "Wrongly kept"},
    "analysis": {"true_positive": "Correct, and model agreed", "true_negative": "Flawed, and model agreed", "false_positive": "Model too lenient", "false_negative": "Model too strict"},
    "any": {"undecidable": "Model abstained", "wrong_text": "Wrong paper text", "failed": "Response failed checks", "unlabelled": "No human label"},
}
LINK_MODES = ("imported_file", "imported_url", "linked_url")
NO_RULE = "the promptbook in force does not define this rule"


def outcome(status: Column, truth: Column, decision: Column) -> Column:
    """Unscoreable rows are named, never put into the table of right and wrong."""
    binary = F.coalesce(truth.isin("yes", "no") & decision.isin("yes", "no"), F.lit(False))
    return ladder([(F.coalesce(status, F.lit("")) != "ok", "failed"), (F.coalesce(decision.isin("undecidable", "wrong_text"), F.lit(False)), decision), (~binary, "unlabelled")], four_way(truth, decision))


def sort_keys() -> list[Column]:
    """Worst outcome first, then the most confident, then by paper; what is no number counts as zero, unknown outcomes go last."""
    place = F.array_position(F.array(*(F.lit(o) for o in ORDER)), F.coalesce("outcome", F.lit("")))
    return [F.when(place == 0, len(ORDER) + 1).otherwise(place), F.coalesce(-F.expr("try_cast(confidence as double)"), F.lit(0.0)), F.coalesce("paper_id", F.lit(""))]


def verdict_word(task: Column, value: Column) -> Column:
    """A stored answer as a reader says it; a dash without one."""
    pick = lambda words: ladder([(value == k, v) for k, v in words.items()], F.replace(value, F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(value, F.lit("")) == "", "\u2014").when(task == "exclusion", pick(WORDS["exclusion"])).otherwise(pick(WORDS["analysis"]))


def heading(task: Column, found: Column) -> Column:
    """What an outcome means for a task."""
    named = lambda kind: ladder([(found == k, v) for k, v in HEADINGS[kind].items()])
    return F.coalesce(F.when(task == "exclusion", named("exclusion")).otherwise(named("analysis")), named("any"))


def table(checked: DataFrame, manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """Checked responses beside title, truth and split; rows without either stay."""
    truth = F.coalesce(*(F.when(F.col("task") == t, expected_decision(t)) for t in ("exclusion", "power_analysis", "data_analysis")))
    lab = labels.select("paper_id", "exclusion_reason", "power", "stats", F.coalesce("split", F.lit("")).alias("split"), F.lit(True).alias("_label"))
    j = checked.join(manifest.select("paper_id", "title"), "paper_id", "left").join(lab, "paper_id", "left").withColumn("truth", F.when(F.col("_label"), truth))
    return j.select(
        "paper_id", "task", "status", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("split", F.lit("")).alias("split"), F.coalesce("truth", F.lit("")).alias("truth"), F.coalesce("decision", F.lit("")).alias("decision"),
        outcome(F.col("status"), F.col("truth"), F.col("decision")).alias("outcome"), "confidence", "cited_rules", "promptbook_evidence",
    )


def tally(rows: DataFrame) -> DataFrame:
    """Rows, right and scored answers, accuracy, and how many lack a title or a truth."""
    right, wrong = F.col("outcome").isin("true_positive", "true_negative"), F.col("outcome").isin("false_positive", "false_negative")
    g = rows.groupBy("task").agg(F.count("*").alias("n"), count_if(right).alias("correct"), count_if(right | wrong).alias("scored"), count_if(F.col("title") == "").alias("missing_title"), count_if(F.col("truth") == "").alias("missing_truth"))
    return g.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("scored")), 4))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` in an order: a heap per partition, no global sort."""
    return rows.orderBy(*order).limit(n)


def sample(values: DataFrame, column: str, n: int = 8) -> DataFrame:
    """One line with the first ``n`` values in order, and dots if there are more."""
    first = values.select(F.col(column).cast("string").alias("v")).distinct().orderBy("v").limit(n + 1).agg(F.array_sort(F.collect_list("v")).alias("v"))
    return first.select(F.concat(F.array_join(F.slice("v", 1, n), ", "), F.when(F.size("v") > n, ", ...").otherwise("")).alias("sample"))


def cited_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Each cited rule of a row with its text; a row that cites none shows its evidence, a rule without text says so."""
    ids = F.filter(F.transform(F.split(F.coalesce("cited_rules", F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    x = rows.select("paper_id", "task", "promptbook_evidence", F.posexplode_outer(ids).alias("nth", "rule"))
    j = x.join(rules.select("task", "rule", "text"), ["task", "rule"], "left")
    shown = F.when(F.col("rule").isNull(), F.trim(F.coalesce("promptbook_evidence", F.lit("")))).otherwise(F.coalesce("text", F.lit(NO_RULE)))
    return j.select("paper_id", "task", F.coalesce("nth", F.lit(0)).alias("nth"), "rule", shown.alias("text")).where("text <> ''")


def inline_markup(c: Column) -> Column:
    """Escaped text in which bold, emphasis and code marks come back as elements."""
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "<em>$1</em>")
    return F.regexp_replace(out, r"`([^`]+)`", "<code>$1</code>")


def metric(c: Column, percent: bool = False) -> Column:
    """A figure as a report prints it: a dash for none, three places, or a percentage with one."""
    return F.when(c.isNull(), "\u2014").otherwise(F.format_string("%.1f%%", F.round(c.cast("double") * 100, 1)) if percent else F.format_string("%.3f", F.round(c.cast("double"), 3)))


def pick_attachment(children: DataFrame) -> DataFrame:
    """Of each item's PDF attachments the first by link mode, then as listed; what is wrong without one, and a warning if there were several."""
    pdf = F.col("content_type") == "application/pdf"
    mode = F.array_position(F.array(*(F.lit(m) for m in LINK_MODES)), F.coalesce("link_mode", F.lit("")))
    name = F.coalesce(blank_to_null(F.col("title")), blank_to_null(F.col("filename")), F.col("key"))
    g = children.groupBy("item").agg(
        count_if(pdf).alias("pdfs"), F.min(F.when(pdf & (mode > 0), F.struct(mode.alias("mode"), "nth", "key"))).alias("best"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(pdf, F.struct("nth", name.alias("name"))))), lambda x: x["name"]), "; ").alias("names"),
    )
    return g.select(
        "item", F.col("best.key").alias("key"), ladder([(F.col("pdfs") == 0, "no PDF attachment on record"), (F.col("best").isNull(), "linked_file not in cloud storage")], "").alias("problem"),
        F.when(F.col("pdfs") > 1, F.concat(F.col("pdfs").cast("string"), F.lit(" PDF attachments, picked highest priority: "), F.col("names"))).otherwise("").alias("warning"),
    )


def metadata(items: DataFrame) -> DataFrame:
    """Library items -> one flat record each: authors, year, identifiers by field first, then free text."""
    author = F.transform(F.filter("creators", lambda c: c["creatorType"] == "author"), lambda c: F.coalesce(F.nullif(c["lastName"], F.lit("")), c["name"], F.lit("")))
    x = items.withColumn("authors", author).withColumn("ids", identifiers(field_value(F.col("pmid")), field_value(F.col("pmcid")), F.col("extra"), F.col("archive"), F.col("url")))
    own = normalize_doi(F.col("doi"))
    return x.select(
        "paper_id", F.coalesce("title", F.lit("")).alias("title"), "authors", F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("first_author"), F.when(own != "", own).otherwise(F.col("ids.doi")).alias("doi"),
        F.col("ids.pmid").alias("pmid"), F.col("ids.pmcid").alias("pmcid"), F.regexp_extract(F.coalesce("date", F.lit("")), YEAR, 0).alias("year"),
    )


def placements(found: DataFrame) -> DataFrame:
    """key, folder as found -> one row per key with its folders in the order of encounter."""
    first = found.groupBy("key", "folder").agg(F.min("nth").alias("nth"))
    return first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "folder"))), lambda x: x["folder"]), "; ").alias("folders"), F.count("*").alias("n_folders"))


def placement_totals(found: DataFrame) -> DataFrame:
    """Placements, distinct keys, and keys filed more than once."""
    g = found.groupBy("key").agg(F.count("*").alias("k"))
    return g.agg(F.sum("k").alias("placements"), F.count("*").alias("unique_keys"), count_if(F.col("k") > 1).alias("multi_filed"))


def unsettled(papers: DataFrame, decisions: DataFrame, settled: Sequence[str] = ("no_issue", "replaced", "dropped")) -> DataFrame:
    """Papers without a settled decision."""
    return papers.join(decisions.where(F.col("decision").isin(*settled)).select("paper_id"), "paper_id", "left_anti")


def reasons(dropped: DataFrame, decisions: DataFrame, queue: DataFrame, default: str) -> DataFrame:
    """Why a paper went: the note of its decision, else that of the queue, else a default."""
    j = dropped.join(decisions.select("paper_id", F.col("note").alias("_note")), "paper_id", "left").join(queue.select("paper_id", F.col("problem").alias("_problem")), "paper_id", "left")
    return j.select("paper_id", F.coalesce(blank_to_null(F.col("_note")), blank_to_null(F.col("_problem")), F.lit(default)).alias("reason"))


def log_with_titles(log: DataFrame, papers: DataFrame, default: str = "(title unknown)") -> DataFrame:
    return log.join(papers.select("paper_id", "title"), "paper_id", "left").withColumn("title", F.when(blank_to_null(F.col("title")).isNotNull(), F.col("title")).otherwise(F.lit(default)))


def strip_totals(stripped: DataFrame) -> DataFrame:
    """Characters in, out and removed, and how often each reason kept a text whole (blank: it was stripped)."""
    return stripped.groupBy("reason").agg(F.count("*").alias("n"), F.sum("source_chars").alias("chars_in"), F.sum("result_chars").alias("chars_out"), F.sum("tail_chars").alias("tail_chars")).withColumn("removed_percent", F.round(100.0 * (F.col("chars_in") - F.col("chars_out")) / F.greatest("chars_in", F.lit(1)), 1))


def newest_first(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with their place within a key, the newest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("nth"))))
