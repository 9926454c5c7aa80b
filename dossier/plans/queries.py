"""Queries for the operators of review-corpus analytics, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import evaluate as ev
from dossier.operators import judgments as jd
from dossier.operators import splits as sp

from dossier.functions.columns import ladder
from dossier.functions.median import median_by

from .fixtures import ROUND_SEED, SPLIT_SEED, TASKS, Corpus

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    """Register a query over the views of one folder under its function's name."""
    REGISTRY[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
    return f


def _latest(c: Corpus, task: str = "exclusion", version: str | None = "v1") -> DataFrame:
    return jd.latest_judgments(c.judgments().where(F.col("task") == task), "paper_id", version=version)


def _cases(c: Corpus, task: str = "exclusion", version: str | None = "v1") -> DataFrame:
    """Build-split labels against the latest judgments of a version."""
    return ev.cases(c.labels().where("split = 'build'"), _latest(c, task, version), task)


# --- evaluation ---------------------------------------------------------------------------------------------


@query
def eval_cases(c: Corpus) -> DataFrame:
    return _cases(c)


@query
def eval_confusion(c: Corpus) -> DataFrame:
    """One row per task, all tasks in one pass."""
    latest = jd.latest_judgments(c.judgments(), "paper_id", "task", version="v1")
    return ev.confusion(ev.cases_by_task(c.labels().where("split = 'build'"), latest, *TASKS), "task")


@query
def eval_rates(c: Corpus) -> DataFrame:
    return ev.rates(ev.confusion(_cases(c)))


@query
def eval_kappa(c: Corpus) -> DataFrame:
    return ev.kappa(ev.confusion(_cases(c, "data_analysis")))


@query
def eval_wilson(c: Corpus) -> DataFrame:
    return ev.intervals(ev.confusion(_cases(c)))


@query
def eval_confidence_summary(c: Corpus) -> DataFrame:
    return ev.confidence_summary(_cases(c))


@query
def eval_calibration_bins(c: Corpus) -> DataFrame:
    return ev.calibration_bins(_cases(c)).select("bin", "lower", "upper", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query
def eval_calibration_summary(c: Corpus) -> DataFrame:
    s = ev.calibration_summary(_cases(c))
    return s.select("n", *(F.round(x, 6).alias(x) for x in ("mean_confidence", "accuracy", "brier", "gap", "ece")))


@query
def eval_thresholds(c: Corpus) -> DataFrame:
    return ev.thresholds(_cases(c))


@query
def eval_configuration(c: Corpus) -> DataFrame:
    return ev.configuration(_latest(c, "exclusion", None), c.runs())


@query
def accuracy_judgment_first(c: Corpus) -> DataFrame:
    return ev.judgment_first(c.labels(), _latest(c, "power_analysis", None), "power_analysis")


@query
def review_outcomes(c: Corpus) -> DataFrame:
    return ev.review_outcomes(_cases(c, "power_analysis"))


# --- judgments, attempts, decisions ---------------------------------------------------------------------------


@query
def judgments_latest(c: Corpus) -> DataFrame:
    return jd.latest_judgments(c.judgments(), "paper_id", "task").select("paper_id", "task", "judgment_index", "promptbook_version", "decision", "confidence")


@query
def judgments_latest_by_version(c: Corpus) -> DataFrame:
    return jd.latest_judgments(c.judgments(), "paper_id", "task", version="v1").select("paper_id", "task", "judgment_index", "decision")


@query
def judgments_next_index(c: Corpus) -> DataFrame:
    papers = c.papers().select("paper_id").crossJoin(F.broadcast(c.runs().select("task").distinct()))
    return jd.next_index(c.judgments(), papers)


@query
def judgments_integrity(c: Corpus) -> DataFrame:
    return jd.integrity(c.judgments(), c.runs())


@query
def attempts_latest(c: Corpus) -> DataFrame:
    return jd.latest_attempts(c.attempts()).select("paper_id", "attempt", "started_at", "failure_kind")


@query
def attempts_superseded(c: Corpus) -> DataFrame:
    return jd.superseded_attempts(c.attempts()).groupBy("paper_id").agg(F.count("*").alias("superseded"))


@query
def retry_rate(c: Corpus) -> DataFrame:
    return jd.retry_rate(c.attempts())


@query
def retry_by_kind(c: Corpus) -> DataFrame:
    return jd.retry_by_kind(c.attempts())


@query
def retry_state(c: Corpus) -> DataFrame:
    return jd.retry_state(jd.latest_attempts(c.attempts()))


@query
def decisions_last_by_time(c: Corpus) -> DataFrame:
    log = c.attempts().select("paper_id", F.substring("started_at", 1, 10).alias("decided_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("verdict"))
    return jd.last_decisions(log).select("paper_id", "decided_at", "verdict")


@query
def history_lag(c: Corpus) -> DataFrame:
    """Accuracy of every promptbook version in turn, per task."""
    truth = c.labels().select("paper_id", *(ev.expected_decision(t).alias(t) for t in TASKS))
    x = c.judgments().join(truth, "paper_id").withColumn("truth", F.coalesce(*(F.when(F.col("task") == t, F.col(t)) for t in TASKS)))
    x = x.where("truth is not null and decision in ('yes', 'no')")
    seen = x.groupBy("task", F.col("promptbook_version").alias("seq")).agg(F.avg((F.col("truth") == F.col("decision")).cast("double")).alias("accuracy"))
    rows = seen.select("task", F.lit("build").alias("split"), "seq", F.round("accuracy", 6).alias("accuracy"), F.lit("f").alias("fingerprint"), F.lit(True).alias("comparable"))
    return jd.history(rows).select("task", "seq", "accuracy", "previous_accuracy", "comparable_to_previous")


# --- splits and rounds ------------------------------------------------------------------------------------------


@query
def split_rank(c: Corpus) -> DataFrame:
    from dossier.functions.columns import hash_rank

    return c.papers().select("paper_id", hash_rank(F.col("paper_id"), SPLIT_SEED).alias("rank"))


@query
def split_assign(c: Corpus) -> DataFrame:
    return c.labels().select("paper_id", "stratum", "split")


@query
def split_counts(c: Corpus) -> DataFrame:
    return c.labels().groupBy("stratum", "split").agg(F.count("*").alias("n"))


@query
def rounds_interleave(c: Corpus) -> DataFrame:
    return sp.interleave(c.labels().where("split = 'build'"), ROUND_SEED)


@query
def rounds_membership_equal(c: Corpus) -> DataFrame:
    rounds = sp.interleave(c.labels().where("split = 'build' and stratum = 'survivor'"), ROUND_SEED)
    return sp.same_membership(rounds.where("round = 1"), sp.interleave(c.labels().where("split = 'build'"), ROUND_SEED).where("round = 1"))


# --- labels -----------------------------------------------------------------------------------------------------

from dossier.operators import labels as lb  # noqa: E402


@query
def labels_union(c: Corpus) -> DataFrame:
    """Two sources with different columns."""
    s = c.label_sources()
    a = s.where("source = 'A'").drop("stats").withColumn("note", F.lit("n"))
    return lb.union_sources(a, s.where("source = 'B'")).select("paper_id", "source", "power", "stats", "note")


@query
def labels_agree(c: Corpus) -> DataFrame:
    return lb.agreeing(c.label_sources()).select("paper_id", "n_rows", "exclusion_reason", "power", "stats")


@query
def labels_disagree(c: Corpus) -> DataFrame:
    return lb.disagreeing(c.label_sources()).select("paper_id", "n_rows", "n_answers")


@query
def labels_collapse(c: Corpus) -> DataFrame:
    return lb.agreeing(c.label_sources()).select("paper_id", "source_files", "citations")


@query
def labels_gate(c: Corpus) -> DataFrame:
    """Every row carries all answers first, so that the gate has something to take away."""
    full = c.label_sources().withColumn("power", F.lit("yes"))
    return lb.gate(full).select("paper_id", "source", "exclusion_reason", "power", "stats")


def _raw_answers(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    texts = F.array(*(F.lit(x) for x in ("Yes", " no (see text)", "N", "y, partly", "", "maybe", "Pilot Study", " Secondary  DATA analysis ", "None", "unclear", "strange reason", "17", " 8 ", "8.5")))
    return c.table("documents").select(d.cast("string").alias("paper_id"), F.element_at(texts, (d % 14 + 1).cast("int")).alias("raw"))


@query
def labels_clean_yes_no(c: Corpus) -> DataFrame:
    return _raw_answers(c).withColumn("clean", lb.clean_yes_no(F.col("raw")))


@query
def labels_clean_reason(c: Corpus) -> DataFrame:
    return _raw_answers(c).withColumn("clean", lb.clean_reason(F.col("raw")))


@query
def labels_restricted(c: Corpus) -> DataFrame:
    return _raw_answers(c).select("paper_id", "raw", lb.clean_restricted(F.col("raw")).alias("restricted"), lb.clean_int(F.col("raw")).alias("number"))


def _new_labels(c: Corpus) -> DataFrame:
    """The next load: some papers are gone, some have another citation."""
    d = F.col("doc_id")
    return c.labels().where(d % 7 != 0).withColumn("citation_raw", F.when(d % 5 == 0, F.concat("citation_raw", F.lit(" (rev)"))).otherwise(F.col("citation_raw"))).select("paper_id", "citation_raw", "split")


@query
def labels_upsert_keep_split(c: Corpus) -> DataFrame:
    return lb.upsert_keep_split(c.labels().select("paper_id", "citation_raw", "split"), _new_labels(c))


@query
def labels_stale(c: Corpus) -> DataFrame:
    return lb.stale(c.labels().select("paper_id", "citation_raw", "split"), _new_labels(c), allow_split=True)


@query
def labels_identifier_join(c: Corpus) -> DataFrame:
    p = c.papers()
    rows = p.select(F.concat(F.lit("r"), "paper_id").alias("row_id"), F.when(F.col("doc_id") % 4 != 0, F.col("doi")).otherwise("").alias("doi"), F.when(F.col("doc_id") % 3 == 0, F.col("pmid")).otherwise("").alias("pmid"))
    return lb.join_by_identifier(rows, p.select("paper_id", "doi", "pmid"))


def _authors(c: Corpus) -> DataFrame:
    """Papers with invented authors: the surname is the source, the year from the id."""
    d = F.col("doc_id")
    authors = F.array(F.col("source"), F.concat(F.lit("co"), (d % 11).cast("string")), F.concat(F.lit("third"), (d % 3).cast("string")))
    return c.papers().select("paper_id", "doc_id", F.col("source").alias("surname"), (F.lit(1990) + d % 23).alias("year"), authors.alias("authors"))


@query
def labels_author_year_join(c: Corpus) -> DataFrame:
    """Every ninth citation has a suffix, which only a sole candidate may have."""
    p = _authors(c)
    rows = p.select(F.concat(F.lit("r"), "paper_id").alias("row_id"), "surname", "year", F.when(F.col("doc_id") % 9 == 0, "a").otherwise("").alias("suffix"), F.array().cast("array<string>").alias("extras"))
    return lb.join_author_year(rows, p.select("paper_id", "surname", "year", "authors")).select("row_id", "paper_id", "rule")


@query
def labels_positional_join(c: Corpus) -> DataFrame:
    p = _authors(c)
    rows = p.select(F.concat(F.lit("r"), "paper_id").alias("row_id"), "surname", "year", F.slice("authors", 2, 2).alias("extras"))
    return lb.join_author_year(rows, p.select("paper_id", "surname", "year", "authors"))


@query
def labels_fuzzy_join(c: Corpus) -> DataFrame:
    """Citation keys of every 50th paper: unique by surname and year, tied, or without an author's name (every 1000th)."""
    d = F.col("doc_id")
    papers = c.papers().select("paper_id", F.concat(F.lit("name"), (d % 499).cast("string")).alias("surname"), (F.lit(1990) + d % 7).cast("string").alias("year"), "title")
    words = F.lower(F.regexp_replace(F.substring("title", 1, 40), r"[^A-Za-z]+", " "))
    rows = c.papers().where(d % 50 == 0).select(F.concat(F.lit("r"), "paper_id").alias("row_id"), F.when(d % 1000 == 0, "institute").otherwise(F.concat(F.lit("name"), (d % 499).cast("string"))).alias("surname"), F.when(d % 100 == 0, "").otherwise((F.lit(1990) + d % 7).cast("string")).alias("year"), words.alias("words"))
    return lb.join_cite_key(rows, papers).withColumn("score", F.round("score", 6))


# --- corpus -----------------------------------------------------------------------------------------------------

from dossier.operators import corpus as cp  # noqa: E402


def _ledger(c: Corpus) -> DataFrame:
    """Nine rules over the manifest, in one scan of it."""
    d, gone = F.col("doc_id"), F.col("verdict") == "DROPPED"
    names = [("cross_set_duplicate", "rule"), ("internal_duplicate", "rule"), ("identity", "human"), ("unreviewed", "rule"), ("cross_paper_reason", "rule"), ("disagreement", "human"), ("expert_review", "human"), ("text_integrity", "model")]
    reason = F.concat(F.lit("rule "), (d % 3).cast("string"))
    return cp.ledger_by_rules(c.papers(), *((n, by, gone & (d % 8 == i), reason) for i, (n, by) in enumerate(names)), ("pdf_missing", "rule", F.col("status") == "PDF_MISSING", F.col("status")))


@query
def ledger_union(c: Corpus) -> DataFrame:
    return _ledger(c)


@query
def ledger_by_stage(c: Corpus) -> DataFrame:
    from dossier.functions.columns import joined_set

    return _ledger(c).groupBy("stage").agg(F.count("*").alias("n"), joined_set(F.col("decided_by")).alias("decided_by"), joined_set(F.col("reason"), "; ").alias("reasons"))


@query
def ledger_reconcile(c: Corpus) -> DataFrame:
    return cp.reconcile(c.papers(), _ledger(c))


@query
def dedupe_identifier_collisions(c: Corpus) -> DataFrame:
    return cp.collisions(c.papers(), "doi", "pmid", "md5")


@query
def dedupe_cross_set(c: Corpus) -> DataFrame:
    return cp.cross_set(c.papers(), "unlabelled", "human_labelled", "doi", "pmid", "md5")


def _pairs(c: Corpus) -> DataFrame:
    return c.papers().select(F.col("md5").alias("pair_id"), "paper_id", "set")


@query
def dedupe_pairs_merge(c: Corpus) -> DataFrame:
    return cp.merge_pairs(_pairs(c))


@query
def dedupe_orphans(c: Corpus) -> DataFrame:
    return cp.orphans(cp.merge_pairs(_pairs(c)), c.labels().where("split = 'build'")).select("pair_id", "keep", "remove")


def _decisions(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    return c.papers().where(d % 9 == 0).select("paper_id", F.when(d % 2 == 0, "VERIFIED").otherwise("DROPPED").alias("verdict"))


@query
def corpus_upsert(c: Corpus) -> DataFrame:
    p = c.papers().select("paper_id", "verdict", "status")
    return cp.upsert(p, _decisions(c).withColumn("status", F.lit("DECIDED")))


@query
def corpus_apply_verdict(c: Corpus) -> DataFrame:
    return cp.apply_verdicts(c.papers(), _decisions(c))


@query
def corpus_drop_plan(c: Corpus) -> DataFrame:
    p = c.papers()
    reasons = p.where("status = 'PDF_MISSING'").select("paper_id", F.lit(2).alias("rank"), F.lit("no_pdf").alias("reason"))
    twice = cp.merge_pairs(_pairs(c)).select(F.col("remove").alias("paper_id"), F.lit(1).alias("rank"), F.lit("duplicate").alias("reason"))
    return cp.drop_plan(p, reasons.unionByName(twice))


@query
def source_summary_rollup(c: Corpus) -> DataFrame:
    lab = c.labels().select("paper_id", F.lit(True).alias("labelled"), F.col("exclusion_reason").isNotNull().alias("excluded"))
    rows = c.papers().join(lab, "paper_id", "left").select("source", F.coalesce("labelled", F.lit(False)).alias("labelled"), F.coalesce("excluded", F.lit(False)).alias("excluded"))
    return cp.source_summary(rows)


@query
def tree_subtree_paths(c: Corpus) -> DataFrame:
    regions = c.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"))
    nations = c.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    root = c.spark.createDataFrame([("root", None)], "node string, parent string")
    return cp.subtree(root.unionByName(regions).unionByName(nations), "root")


# --- text -------------------------------------------------------------------------------------------------------

from dossier.functions import text as tx  # noqa: E402


@query
def text_normalize_doi(c: Corpus) -> DataFrame:
    raw = F.concat(F.element_at(F.array(F.lit("https://doi.org/"), F.lit("DOI: "), F.lit(" HTTP://dx.doi.org/"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int")), F.upper("doi"), F.lit(".,"))
    return c.papers().select("paper_id", tx.normalize_doi(raw).alias("doi"), tx.label_doi(raw).alias("label_doi"))


@query
def text_other_dois(c: Corpus) -> DataFrame:
    text = F.concat(F.lit("see "), "doi", F.lit("; also (10.2000/a"), (F.col("doc_id") % 5).cast("string"), F.lit("), 10.2000/b; 10.2000/b."))
    return c.papers().select("paper_id", F.array_join(tx.other_dois(F.col("doi"), text), " ").alias("others"))


@query
def text_correction_title(c: Corpus) -> DataFrame:
    title = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Correction: ", "ERRATUM to ", "The correction of ", "[Retracted] ", "Publisher Corrigendum to a: ", "(withdrawn)", ""))), (F.col("doc_id") % 7 + 1).cast("int")), "title")
    return c.papers().select("paper_id", tx.is_correction(title).alias("is_correction"))


@query
def text_admin_head(c: Corpus) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.element_at(F.array(F.lit("Summary\n Statement\n"), F.lit("Principal Investigator: "), F.lit("PRIVILEGED  Communication ")), (F.col("doc_id") % 3 + 1).cast("int")), "text")).otherwise(F.col("text"))
    return c.table("documents").select("doc_id", tx.is_administrative(text).alias("is_administrative"))


def _with_references(c: Corpus) -> DataFrame:
    tail = F.concat(F.lit("\n 5. References:\n"), F.repeat(F.lit("1. Someone 2001.\n"), (F.col("doc_id") % 40).cast("int")), F.when(F.col("doc_id") % 3 == 0, "Appendix A\nmore").otherwise(""))
    text = F.when(F.col("doc_id") % 5 != 0, F.concat("text", tail)).otherwise(F.col("text"))
    return c.table("documents").select("doc_id", text.alias("text"))


@query
def text_reference_strip(c: Corpus) -> DataFrame:
    out = _with_references(c).select("doc_id", tx.strip_references(F.col("text")).alias("s"))
    return out.select("doc_id", "s.stripped", "s.reason", "s.heading", "s.heading_line", F.md5("s.text").alias("text_md5"), *(F.col(f"s.{x}").cast("long").alias(x) for x in ("source_chars", "result_chars", "removed_chars", "tail_chars")))


@query
def text_integrity_flags(c: Corpus) -> DataFrame:
    k = F.col("doc_id") % 8
    planted = F.when(k == 1, F.concat("text", F.lit("\nReferences\n1. One 2001.\n Abstract\nmore"))).when(k == 2, F.concat(F.lit("Submission Form\n"), "text")).when(k == 3, F.concat("text", F.lit("\ufffd doi: 10.1"))).when(k == 4, F.concat("text", F.lit(" doing"))).otherwise(F.col("text"))
    abstract = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.substring("text", 1, 100))
    docs = c.table("documents").select("doc_id", planted.alias("text"), abstract.alias("abstract")).withColumn("pages", F.ceil(F.length("text") / 3000).cast("double"))
    middle = median_by(docs.where("pages > 0").select((F.length("text") / F.col("pages")).alias("v")), "v").select("median")  # one row
    return docs.crossJoin(F.broadcast(middle)).select("doc_id", F.array_join(tx.integrity_scan(F.col("text"), F.col("pages"), F.col("abstract"), F.col("median")), ";").alias("flags"))


@query
def text_chars_per_page_median(c: Corpus) -> DataFrame:
    return median_by(c.table("documents").where("length(text) > 0").select((F.length("text") / F.ceil(F.length("text") / 3000)).alias("v")), "v").select("n", "median")


@query
def text_clean(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(F.when(d % 3 == 0, "\ufeff").otherwise(""), F.when(d % 4 == 0, F.regexp_replace("text", "\n", "\r\n")).when(d % 41 == 1, " \n ").otherwise(F.col("text")))
    s = F.col("s")
    out = c.table("documents").select("doc_id", tx.clean_text(text).alias("s"))
    notes = tx.text_notes(s, F.when(d % 5 == 0, d).otherwise(0), F.when(d % 7 == 0, "no_heading").otherwise(""), F.when(d % 11 == 0, "").otherwise("reference_heading_v1"))
    return out.select("doc_id", F.md5("s.text").alias("text_md5"), "s.refused", notes.alias("notes"))


@query
def text_rule_citations(c: Corpus) -> DataFrame:
    text = F.concat(F.lit("By E"), (F.col("doc_id") % 30).cast("string"), F.lit(" and P2, E1, E1, XE5, E123; D7. "), "text")
    return c.table("documents").select("doc_id", F.array_join(tx.rule_citations(text), ",").alias("cited"), F.array_join(tx.rule_citations(text, "E"), ",").alias("task_rules"))


@query
def text_other_paper_flags(c: Corpus) -> DataFrame:
    text = F.concat(F.lit("As Smith et al. (2001), Jones 1999 and Smith et al. (2001) say, Lee & Roe, 2020 and The 2019 cohort, not by "), "text", F.lit(" ("), (F.lit(1900) + F.col("doc_id") % 120).cast("string"), F.lit(")"))
    return c.table("documents").select("doc_id", F.array_join(tx.other_papers(text), "|").alias("others"))


# --- replies ----------------------------------------------------------------------------------------------------

from dossier.operators import replies as rp  # noqa: E402


@query
def reply_parse(c: Corpus) -> DataFrame:
    return rp.parse(c.replies()).select("paper_id", "task", "fenced", "decision", "failure")


@query
def reply_validate(c: Corpus) -> DataFrame:
    return rp.checker_summary(rp.parse(c.replies()))


@query
def reply_semantic(c: Corpus) -> DataFrame:
    rules = c.spark.createDataFrame([(t, f"{p}{i}") for t, p in rp.PREFIX.items() for i in range(3)], "task string, rule string")
    return rp.semantic(rp.parse(c.replies()), rules)


@query
def reply_text(c: Corpus) -> DataFrame:
    return rp.assistant_text(rp.events(c.reply_lines())).select("stream_id", F.md5("text").alias("text_md5"))


@query
def reply_provenance(c: Corpus) -> DataFrame:
    return rp.provenance(rp.events(c.reply_lines()))


@query
def reply_tokens(c: Corpus) -> DataFrame:
    return rp.usage(rp.events(c.reply_lines()))


@query
def reply_tools(c: Corpus) -> DataFrame:
    return rp.tools_offered(rp.events(c.reply_lines()))


@query
def reply_tool_use(c: Corpus) -> DataFrame:
    """Blocks nested below a message; every third one is a tool's, others quote the words."""
    nested = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"a": [{"b": {"type": "tool_use"}}], "t": '), F.to_json(F.struct("text")), F.lit("}"))).otherwise(F.concat(F.lit('{"type": "text", "t": "{\\"type\\": \\"tool_use\\"}", "x": '), F.to_json(F.struct("text")), F.lit("}")))
    return c.table("conversations").select("conv_id", "turn", rp.uses_tool(nested).alias("uses_tool"))


@query
def canary_verdict(c: Corpus) -> DataFrame:
    x = _cases(c).where("judged and truth is not null").select("truth", "decision", F.when(F.col("paper_id").cast("long") % 2 == 0, "yes").otherwise("no").alias("decoy"))
    return rp.canary(x)


@query
def constant_confidence(c: Corpus) -> DataFrame:
    return rp.constant_confidence(c.judgments())


# --- statistics and identity --------------------------------------------------------------------------------------

from dossier.operators import stats as st  # noqa: E402


def _agency(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    return c.table("labels").join(c.table("documents").select("doc_id", "n_chars", "text"), "doc_id").select("doc_id", (d % 2 == 0).alias("agency"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("ignored"), (d % 3).alias("stratum"), "n_chars", "text")


@query
def stats_two_by_two(c: Corpus) -> DataFrame:
    return st.two_by_two(_agency(c), "agency", "correct")


@query
def stats_characteristics(c: Corpus) -> DataFrame:
    return st.characteristics(_agency(c), "n_chars", "agency", "correct")


@query
def stats_flow_categories(c: Corpus) -> DataFrame:
    return st.flow_categories(c.table("documents"), "text", {"licence": "licen[cs]e", "address": "@", "table": r" \| ", "symbol": "[%&$]{2}"})


@query
def stats_fisher_exact(c: Corpus) -> DataFrame:
    t = st.cells(_agency(c), F.col("agency"), F.col("correct"), "stratum")
    return st.fisher(t, "stratum").select("stratum", F.round("p_value", 8).alias("p_value"))


@query
def stats_cmh(c: Corpus) -> DataFrame:
    t = st.cmh(st.cells(_agency(c), F.col("agency"), F.col("ignored"), "stratum"))
    return t.select("strata", F.round("statistic", 8).alias("statistic"), F.round("odds_ratio", 8).alias("odds_ratio"))


def _heads(c: Corpus) -> DataFrame:
    """Heads of 900 characters (a head is a file's first pages) with what the library says of them."""
    d = F.col("doc_id")
    head = F.substring("text", 1, 900)
    shown = ladder([(d % 4 == 0, F.concat(F.lit("doi 10.1000/"), F.md5("text"), F.lit(" "), head)), (d % 9 == 1, F.concat(F.lit("Summary Statement "), head))], head)
    names = F.array(F.coalesce(F.lower(F.get(F.split("text", " "), 2)), F.lit("")), F.lit("nobody"))
    return c.table("documents").select(d.cast("string").alias("paper_id"), shown.alias("head"), F.concat(F.lit("10.1000/"), F.md5("text")).alias("doi"), F.substring("text", 1, 60).alias("title"), names.alias("surnames"), F.lit("2001").alias("year"), F.substring("text", 100, 20).alias("journal"))


@query
def identity_ladder(c: Corpus) -> DataFrame:
    from dossier.operators.identity import decide, report

    return report(decide(_heads(c)))


# --- manifest and records ---------------------------------------------------------------------------------------

from dossier.functions import citations as ct  # noqa: E402
from dossier.operators import manifest as mf  # noqa: E402


@query
def manifest_extractable(c: Corpus) -> DataFrame:
    return mf.extractable(mf.active(c.papers())).select("paper_id", "verdict", "status")


@query
def manifest_extraction_flags(c: Corpus) -> DataFrame:
    method = F.when(F.col("status") == "PDF_MISSING", "none").when(F.col("doc_id") % 19 == 0, "ocr").otherwise("text")
    return c.papers().select("paper_id", mf.extraction_flag(method, F.col("title"), F.col("n_chars")).alias("flag"), mf.sparse(F.col("n_chars"), F.col("doc_id") % 40).alias("sparse"))


@query
def manifest_outstanding(c: Corpus) -> DataFrame:
    """Texts whose extraction is missing or was made from another file."""
    p = c.papers().select("paper_id", "doc_id", "md5")
    done = p.where("doc_id % 3 <> 0").withColumn("md5", F.when(F.col("doc_id") % 5 == 0, F.md5("md5")).otherwise(F.col("md5")))
    return mf.outstanding(p.select("paper_id", "md5"), done, "paper_id", "md5")


@query
def manifest_coverage(c: Corpus) -> DataFrame:
    p = c.papers().withColumn("doi", F.when(F.col("doc_id") % 4 != 0, F.col("doi")).otherwise(" "))
    return mf.coverage(p, "doi", "pmid", "md5")


@query
def manifest_histogram(c: Corpus) -> DataFrame:
    return mf.histogram(c.label_sources(), "exclusion_reason", "power", "stats", "source")


@query
def label_counts(c: Corpus) -> DataFrame:
    return mf.label_counts(c.labels())


@query
def label_descriptions(c: Corpus) -> DataFrame:
    category = F.when(F.col("doc_id") % 4 == 0, "B")
    return c.labels().select("paper_id", mf.describe(F.col("exclusion_reason"), F.col("power"), F.col("stats"), category).alias("description"))


@query
def token_display(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", mf.format_tokens(F.col("n_chars") * 97).alias("shown"))


@query
def run_fingerprints(c: Corpus) -> DataFrame:
    r = c.runs()
    return r.select("task", "promptbook_version", mf.fingerprint("task", "promptbook_version", "effort").alias("fingerprint"), mf.run_id(F.col("task"), F.lit(1), F.col("promptbook_version")).alias("id"))


@query
def run_snapshots(c: Corpus) -> DataFrame:
    return mf.snapshot_id(c.judgments().where("promptbook_version = 'v2'"), "paper_id", "decision").select("task", "n", F.length("snapshot").alias("hash_chars"))


@query
def run_registration(c: Corpus) -> DataFrame:
    r = c.runs()
    again = r.withColumn("effort", F.when(F.col("task") == "exclusion", F.lit("low")).otherwise(F.col("effort")))
    return mf.registration(r.where("task <> 'data_analysis'"), again, "run_id", "effort", "model", "config_fingerprint")


@query
def round_preparation(c: Corpus) -> DataFrame:
    rows = c.papers().select("source", F.when(F.col("doc_id") % 40 == 0, "").otherwise("strip-1").alias("method"))
    return mf.mixed_preparation(rows, "source", "method")


@query
def reply_leaked_ids(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    raw = F.concat(F.lit("about id"), d.cast("string"), F.lit(" and "), F.when(d % 3 == 0, F.concat(F.lit("id"), (d + 1).cast("string"))).otherwise("none"), F.lit("."))
    replies = c.table("documents").select(F.concat(F.lit("id"), d.cast("string")).alias("paper_id"), raw.alias("raw"))
    return mf.leaked_ids(replies, replies)


@query
def citation_parse(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(F.when(d % 2 == 0, F.concat(d.cast("string"), F.lit(". "))).otherwise(" "), F.when(d % 7 != 0, "(").otherwise(""), F.lit("Hershman, Bansal, & Roe-Smith, et al., "), (F.lit(1900) + d % 120).cast("string"), F.when(d % 5 == 0, "b").otherwise(""), F.lit(") "))
    x = c.table("documents").select("doc_id", ct.citation(text).alias("s")).select("doc_id", "s.*")
    return x.select("doc_id", "number", "year", "suffix", F.array_join(ct.cited_names(F.col("names")), "|").alias("names"))


@query
def citation_keys(c: Corpus) -> DataFrame:
    d = F.col("doc_id")
    key = F.concat(F.element_at(F.array(F.lit("smith"), F.lit("abrahams-gessel"), F.lit("")), (d % 3 + 1).cast("int")), F.when(d % 2 == 0, "EffectOfDNALight").otherwise("Study"), F.when(d % 5 != 0, (F.lit(1900) + d % 120).cast("string")).otherwise(""), F.when(d % 7 == 0, "a").otherwise(""))
    return c.table("documents").select("doc_id", ct.cite_key(key).alias("s")).select("doc_id", "s.*")


@query
def latex_cells(c: Corpus) -> DataFrame:
    cell = F.concat(F.lit(r"Hern\'andez {et} al.\textsuperscript{\cite{hern2001}} & \textbf{Caf\'{e}} --- "), F.col("doc_id").cast("string"), F.lit(r"\% \emph{of} $\sim$5 \"u \& m\^ore \cite{x} \\\\ "))
    return c.table("documents").select("doc_id", ct.strip_latex(cell).alias("text"))


@query
def reading_conditions(c: Corpus) -> DataFrame:
    return c.judgments().groupBy("task", ct.reading_condition(F.col("promptbook_version")).alias("condition")).agg(F.count("*").alias("n"))


from . import review  # noqa: E402, F401  registers its queries
