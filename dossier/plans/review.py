"""Queries for rounds, provenance, closure, review tables, records and the report statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.functions.columns import ladder, rounded
from dossier.operators import closure as cl
from dossier.operators import evaluate as ev
from dossier.operators import identity as idn
from dossier.operators import labels as lb
from dossier.operators import manifest as mf
from dossier.operators import records as rc
from dossier.operators import replies as rp
from dossier.operators import review as rv
from dossier.operators import splits as sp
from dossier.operators import stats as st

from .fixtures import ROUND_SEED, TASKS, Corpus
from .queries import _cases, _heads, _with_references, query


def _d() -> Column:
    return F.col("doc_id")


def _docs(c: Corpus, *columns: Column | str) -> DataFrame:
    return c.table("documents").select(_d().cast("string").alias("paper_id"), "doc_id", *columns)


def _pick(n: Column, *values: object) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


# --- rounds -----------------------------------------------------------------------------------------------------


def _round_rows(c: Corpus) -> DataFrame:
    """Rounds of three tasks cut from labels: round 1 is sound, others hold a paper that stops them."""
    d = F.col("doc_id")
    lab = c.labels().select("paper_id", "doc_id", "split", "exclusion_reason", "stratum")
    ok = (F.col("split") == "build") & (d % 13 != 0) & (d % 10 != 3)
    task = lambda t, r, rows: rows.select(F.lit(t).alias("task"), F.lit(r).alias("round"), d.alias("nth"), "paper_id", "stratum")
    good = lab.where(ok)
    out = task("exclusion", 1, good).unionByName(task("exclusion", 2, good.where(d % 5 == 0))).unionByName(task("exclusion", 2, good.where(d % 50 == 0))).unionByName(task("exclusion", 3, lab.where(d % 13 != 0)))
    out = out.unionByName(task("power_analysis", 1, good.where("exclusion_reason is null"))).unionByName(task("power_analysis", 2, good)).unionByName(task("data_analysis", 1, lab.where((F.col("split") == "build") & F.col("exclusion_reason").isNull())))
    unknown = good.where(d % 3 == 0).withColumn("paper_id", F.when(d % 9 == 0, F.concat(F.lit("x"), "paper_id")).otherwise(F.col("paper_id")))
    return out.unionByName(task("exclusion", 4, unknown)).unionByName(task("exclusion", 5, good.where(d % 3 == 0)))


@query
def round_plans(c: Corpus) -> DataFrame:
    """Every way that a round can be refused, and two that hold."""
    wanted = c.spark.createDataFrame([("exclusion", r) for r in (1, 2, 3, 4, 5, 9)] + [("power_analysis", 1), ("power_analysis", 2), ("data_analysis", 1)], "task string, round int")
    rounds = _round_rows(c)
    cached = c.table("documents").where(_d() % 10 != 3).select(_d().cast("string").alias("paper_id"))
    expected = rounds.where("not (task = 'exclusion' and round = 5 and nth % 2 = 0)").select("task", "round", "paper_id").distinct()
    return sp.load_rounds(wanted, rounds, c.labels(), c.papers().select("paper_id", "verdict"), cached, expected)


@query
def round_combined(c: Corpus) -> DataFrame:
    """The shared sample of two analyses, of which one skips other papers."""
    r = sp.interleave(c.labels().where("split = 'build' and stratum = 'survivor'"), ROUND_SEED)
    p = F.col("paper_id").cast("long")
    return sp.combined_round(r.withColumn("skipped", p % 13 == 0), r.withColumn("skipped", (p % 13 == 0) & (p % 2 == 1)))


@query
def rounds_membership_difference(c: Corpus) -> DataFrame:
    r = sp.interleave(c.labels().where("split = 'build'"), ROUND_SEED)
    return sp.membership_difference(r.where("round = 1"), r.where("nth between 26 and 75"))


@query
def round_severity(c: Corpus) -> DataFrame:
    return mf.severity(rp_checked(c).withColumn("round", F.substring("paper_id", 1, 1)))


# --- provenance and replies ---------------------------------------------------------------------------------------


@query
def reply_provenance_checks(c: Corpus) -> DataFrame:
    return rp.provenance_failure(rp.events(c.reply_lines()), "m-1")


@query
def round_versions(c: Corpus) -> DataFrame:
    runs = rp.provenance(rp.events(c.reply_lines())).select(F.substring("stream_id", -1, 1).alias("round"), F.col("cli_version").alias("version"))
    return rp.mixed_versions(runs)


@query
def environments_compare(c: Corpus) -> DataFrame:
    r = c.table("nation").select("n_nationkey", "n_regionkey")
    n, k = F.col("n_nationkey"), F.col("n_regionkey")
    first = F.struct(F.lit("m-1").alias("model"), F.lit("high").alias("effort"), F.lit("s").alias("system_prompt_sha256"), F.lit("v1").alias("promptbook_version"), F.when(n % 7 != 0, "p").alias("promptbook_sha256"))
    second = F.struct(F.when(k == 1, "m-2").otherwise("m-1").alias("model"), F.when(n % 5 == 0, "low").otherwise("high").alias("effort"), F.lit("s").alias("system_prompt_sha256"), F.lit("v1").alias("promptbook_version"), F.when(n % 14 != 0, "p").alias("promptbook_sha256"))
    return rp.compare_environments(r.select("n_nationkey", first.alias("first"), second.alias("second")))


def _combined(c: Corpus) -> DataFrame:
    d = _d()
    half = lambda p, k: F.struct(
        _pick(d + k, "Yes", "no", "undecidable").alias("decision"), F.when((d + k) % 17 == 0, "as the data analysis decision says, the power analysis result").otherwise("because").alias("reasoning"),
        F.when((d + k) % 12 == 0, "D9 or P9").otherwise(F.concat(F.lit(f"rule {p}"), (d % 3).cast("string"))).alias("promptbook_evidence"), F.when((d + k) % 19 == 0, 2.0).otherwise(0.5).alias("confidence"), F.when((d + k) % 23 == 0, "x").alias("task"),
    )
    echo = ladder([(d % 29 == 0, None), (d % 31 == 0, "other")], F.concat(F.lit("tok"), d.cast("string")))
    raw = F.to_json(F.struct(half("P", 0).alias("power_analysis"), F.when(d % 5 != 0, half("D", 1)).alias("data_analysis"), echo.alias("paper_id")))
    return _docs(c, F.concat(F.lit("tok"), d.cast("string")).alias("token"), raw.alias("raw")).drop("doc_id")


def _rules(c: Corpus) -> DataFrame:
    return c.spark.createDataFrame([(t, f"{p}{i}") for t, p in rp.PREFIX.items() for i in range(3)], "task string, rule string")


@query
def reply_combined(c: Corpus) -> DataFrame:
    """Two answers in one reply: both or neither."""
    sound = F.col("failure").isNull()
    return rp.parse_combined(_combined(c)).select("paper_id", "task", "failure", F.when(sound, F.col("decision")).alias("decision"), F.when(sound, F.col("confidence")).alias("confidence"))


@query
def reply_combined_checks(c: Corpus) -> DataFrame:
    return rp.check_combined(rp.parse_combined(_combined(c)), _rules(c))


def rp_checked(c: Corpus) -> DataFrame:
    """All checks of a response in their order, over replies with planted faults."""
    d = _d()
    parsed = rp.parse(c.replies()).where("task = 'exclusion'")
    known = rp.known_rules(_rules(c).where("task = 'exclusion'"))
    x = parsed.join(known, "task", "left").withColumns({"round": F.concat(F.lit("r"), (d % 40).cast("string")), "attempt": _pick(d, "1", "2", "3", "", "x", "0"), "exit_code": F.when(d % 37 == 1, 1).otherwise(0), "token": F.when(d % 83 == 0, "zz").otherwise(F.col("paper_id"))})
    case = rp.decision_case(F.col("task"), F.col("decision"), F.col("evidence"), F.col("confidence"), F.col("echo"), F.col("known"))
    g_case, g_severity = ladder([(d % 71 == 3, "G3"), (d % 43 == 4, "G9"), (d % 47 == 5, "G6")]), F.when(d % 71 == 3, "FATAL").when((d % 43 == 4) | (d % 47 == 5), "RETRY")
    return rp.check_responses(x, d % 61 != 2, d % 97 == 6, g_case, g_severity, d % 89 == 7, F.col("failure"), rp.token_case(F.col("echo"), F.col("token")), case)


@query
def responses_checked(c: Corpus) -> DataFrame:
    return rp_checked(c)


@query
def resume_states(c: Corpus) -> DataFrame:
    d = _d()
    latest = _docs(c, _pick(d, "1", "2", "3", "", "bad").alias("attempt"), F.when(d % 7 == 0, "1").otherwise("0").alias("exit_code"), F.when(d % 3 != 0, F.concat(F.lit("raw/"), d.cast("string"))).alias("raw_path"), F.lit("t").alias("token")).drop("doc_id")
    checked = _docs(
        c, F.lit(0).alias("nth"), _pick(d, "1", "2", "3", "", "bad").alias("attempt"), F.when(d % 2 == 0, F.concat(F.lit("raw/"), d.cast("string"))).otherwise("").alias("raw_path"), F.when(d % 13 == 0, "u").otherwise("t").alias("token"),
        _pick(d, "ok", "failed", "odd", "failed").alias("status"), _pick(d, "parse", "FATAL", "").alias("failure_kind"), _pick(d, "", "yes", "no", " TRUE ").alias("retry_eligible"),
    ).where(d % 11 != 0).drop("doc_id")
    return rp.resume_state(latest, checked)


@query
def run_billing(c: Corpus) -> DataFrame:
    runs = rp.provenance(rp.events(c.reply_lines())).select(F.substring("stream_id", -1, 1).alias("task"), "billed_input_tokens", F.col("total_cost_usd").cast("string").alias("total_cost_usd"))
    return rp.billing(runs)


@query
def attempt_numbers(c: Corpus) -> DataFrame:
    raw = _pick(_d(), "1", " 7 ", "0", "-4", "x", "", "2.5", "+3")
    return _docs(c, raw.alias("raw"), rp.attempt_number(raw).alias("attempt")).drop("doc_id")


# --- identity and library records -----------------------------------------------------------------------------------


@query
def identity_signals(c: Corpus) -> DataFrame:
    """The signals that need no similarity, and where the title stands."""
    return idn.signals(_heads(c)).select("paper_id", "head_chars", "admin_doc", "doi_hit", F.size("other_dois").alias("n_other_dois"), "author_count", "year_hit")


@query
def identity_batch(c: Corpus) -> DataFrame:
    h = _heads(c)
    d = F.col("paper_id").cast("long")
    got = idn.batch(c.papers(), h.where(d % 7 != 0).drop("head"), h.where(d % 5 != 0).select("paper_id", "head"))
    return got.groupBy("verdict_reason").agg(F.count("*").alias("n")).where("verdict_reason in ('NO_METADATA', 'NO_FILE', 'ADMIN_DOCUMENT', 'NO_TEXT', 'DOI_MATCH')")


@query
def library_identifiers(c: Corpus) -> DataFrame:
    d = _d()
    s = d.cast("string")
    pmid = _pick(d, "", "PMID: 12", "77", "n/a")
    extra = F.concat(_pick(d, "", "PMID: ", "pmid=", "x"), s, F.lit(" DOI: https://doi.org/10.1234/AB"), s, F.lit("., PMCID: PMC"), s)
    rec = tx.identifiers(pmid, _pick(d, "", "PMC5", "6"), F.when(d % 5 != 0, extra), F.lit("PMC9"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), s, F.lit("/")))
    return _docs(c, rec.alias("r")).select("paper_id", "r.*")


@query
def library_metadata(c: Corpus) -> DataFrame:
    d = _d()
    person = lambda kind, last, name: F.struct(F.lit(kind).alias("creatorType"), last.alias("lastName"), name.alias("name"))
    creators = F.array(person("editor", F.lit("Ed"), F.lit("")), person("author", F.when(d % 3 == 0, "").otherwise("Li"), F.lit("Trial Group")), person("author", F.lit("Roe"), F.lit(None).cast("string")))
    items = _docs(
        c, F.when(d % 9 != 0, F.substring("text", 1, 30)).alias("title"), F.when(d % 4 == 0, F.slice(creators, 1, 1)).otherwise(creators).alias("creators"), F.when(d % 2 == 0, F.concat(F.lit("doi:10.5555/X"), d.cast("string"))).otherwise("").alias("doi"),
        F.lit(" ").alias("pmid"), F.lit("").alias("pmcid"), F.lit("DOI 10.6666/extra").alias("extra"), F.lit("").alias("archive"), F.lit("").alias("url"), _pick(d, "May 2004", "1899-01-01", "2150", "").alias("date"),
    )
    return rv.metadata(items).withColumn("authors", F.array_join("authors", "|")).withColumn("title", F.md5("title"))


@query
def attachments_pick(c: Corpus) -> DataFrame:
    """Events as attachments of users: the priority of link modes decides, then the order."""
    e = F.col("event_id")
    children = c.table("events").select(F.col("user_id").alias("item"), e.alias("nth"), F.concat(F.lit("k"), e.cast("string")).alias("key"), _pick(e, "application/pdf", "text/html", "application/pdf").alias("content_type"), _pick(e, "linked_file", "linked_url", "imported_url", "imported_file", "linked_file").alias("link_mode"), F.lit("").alias("title"), F.when(e % 2 == 0, F.concat(F.lit("f"), e.cast("string"))).alias("filename"))
    return rv.pick_attachment(children).withColumn("warning", F.md5("warning"))


@query
def library_placements(c: Corpus) -> DataFrame:
    found = c.table("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("folder"), F.col("event_id").alias("nth"))
    return rv.placements(found)


@query
def placement_totals(c: Corpus) -> DataFrame:
    found = c.table("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("folder")).distinct()
    return rv.placement_totals(found)


# --- labels -----------------------------------------------------------------------------------------------------


def _label_source(c: Corpus) -> DataFrame:
    d = _d()
    return _docs(
        c, F.when(d % 17 != 0, F.concat(F.lit("p"), (d % 90).cast("string"))).otherwise("").alias("claims"), _pick(d, "", "Pilot  study", "", "odd", "").alias("exclusion_reason_raw"), _pick(d, "yes (close)", "No", "", "maybe").alias("power_correct_raw"), _pick(d, "", "n", "Y").alias("data_correct_raw"),
        _pick(d, "", " b ").alias("review_category_raw"), _pick(d, "none", "stratified", "unclear").alias("restricted_rand_raw"), _pick(d, "no", "").alias("stepped_wedge_raw"), F.concat(F.lit("f"), (d % 3).cast("string")).alias("source_file"), F.lit("c").alias("citation_raw"),
        _pick(d, "doi", "pmid").alias("matched_by"), _pick(d, "100", "", "85").alias("match_score"),
    )


@query
def labels_derive(c: Corpus) -> DataFrame:
    return lb.derive(_label_source(c)).select("paper_id", "exclusion_reason", "power_correct", "data_correct", "review_category", "restricted_rand", "stepped_wedge", "excluded", "labeled")


@query
def labels_rows(c: Corpus) -> DataFrame:
    return lb.label_rows(lb.derive(_label_source(c))).select("paper_id", "exclusion_reason", "power", "stats", "review_category", "matched_by", "match_score")


@query
def labels_claims(c: Corpus) -> DataFrame:
    merged = c.table("nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("paper_id"))
    return lb.collisions(_label_source(c).withColumn("paper_id", F.col("claims")), merged)


@query
def labels_remap(c: Corpus) -> DataFrame:
    merged = c.table("nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("removed"), F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("kept"))
    return lb.remap(_label_source(c).select(F.col("paper_id").alias("row_id"), F.col("claims").alias("paper_id")), merged)


@query
def labels_pool(c: Corpus) -> DataFrame:
    p = c.papers().withColumn("folders", F.array("source", "lang"))
    return lb.match_pool(p, "en", p.where("verdict = 'DROPPED' and doc_id % 2 = 0")).select("paper_id")


@query
def labels_load_report(c: Corpus) -> DataFrame:
    return rc.load_report(lb.derive(_label_source(c)).withColumn("paper_id", F.when(_d() % 17 != 0, F.col("paper_id")).otherwise("")), c.papers())


# --- closure ------------------------------------------------------------------------------------------------------


def _parts(c: Corpus) -> dict[str, DataFrame]:
    """The review files around a manifest, by arithmetic on ids."""
    p = c.papers().withColumn("pmcid", F.lit("")).withColumn("title", F.when(_d() % 401 == 7, "Erratum: a trial").otherwise(F.col("title")))
    d = _d()
    some = lambda k, r: p.where(d % k == r).select("paper_id", "set")
    pair = lambda k: p.where(d % k == 0).select(F.col("paper_id").alias("removed"), (d + 1).cast("string").alias("kept"), F.concat(F.lit("same "), (d % 3).cast("string")).alias("reason"))
    return {
        "papers": p, "texts": p.where(d % 83 != 5).select("paper_id", (F.col("n_chars") + 2500).alias("chars")), "queue": some(10, 1), "reviewed": some(20, 1), "flagged": some(29, 3), "disagreements": some(37, 4), "ledger": some(13, 0).unionByName(some(131, 5)),
        "pairs": pair(53), "removed": p.where(d % 59 == 0).select(F.concat(F.when(d % 2 == 0, "gone").otherwise(""), "paper_id").alias("removed"), (d + 1).cast("string").alias("kept"), F.concat(F.lit("same "), (d % 3).cast("string")).alias("reason")), "restored": some(177, 0),
        "files": p.where(d % 97 != 6).select(F.when(d % 101 == 9, F.concat(F.lit("stray"), "paper_id")).otherwise(F.col("paper_id")).alias("paper_id")),
        "decisions": some(20, 1).withColumn("decision", F.lit("no_issue")).unionByName(some(58, 3).withColumn("decision", F.lit("replaced"))).drop("set"),
    }


@query
def checks_labels_closure(c: Corpus) -> DataFrame:
    x = _parts(c)
    unjoined = c.table("nation").where("n_nationkey % 9 = 0").select(F.col("n_name").alias("citation_raw"))
    return cl.labelled_set(x["papers"], c.labels(), x["texts"], x["queue"], x["reviewed"], x["flagged"], x["disagreements"], unjoined, x["pairs"].select(F.col("removed").alias("paper_id")), x["pairs"].where("removed % 2 = 0"), x["ledger"]).select("tag", "offending", "ok")


@query
def checks_corpus_closure(c: Corpus) -> DataFrame:
    x = _parts(c)
    return cl.unlabelled_set(x["papers"], c.labels(), x["texts"], x["queue"], x["decisions"], x["flagged"], x["removed"], x["restored"], x["ledger"], x["files"], 500).select("tag", "offending", "ok")


@query
def checks_summary(c: Corpus) -> DataFrame:
    return cl.summary(checks_corpus_closure(c))


@query
def restore_preview(c: Corpus) -> DataFrame:
    x = _parts(c)
    return cl.restore_preview(x["removed"], x["restored"].select("paper_id"), c.labels())


@query
def sets_by_precedence(c: Corpus) -> DataFrame:
    """A & (B - C) of the labelled half and (A & B) - C of the other, each as it is grouped."""
    p = c.papers()
    a, b, cc = p.where("verdict <> 'DROPPED'").select("paper_id"), p.where("doc_id % 3 = 0").select("paper_id"), p.where("doc_id % 2 = 0").select("paper_id")
    first = a.join(b.join(cc, "paper_id", "left_anti"), "paper_id", "left_semi").withColumn("form", F.lit("a_and_b_minus_c"))
    flags = p.where("doc_id % 5 = 0").select("paper_id")
    return first.unionByName(flags.intersect(a).exceptAll(cc).withColumn("form", F.lit("a_and_b_less_c")))


# --- review -------------------------------------------------------------------------------------------------------


def _review(c: Corpus) -> DataFrame:
    return rv.table(c.checked(), c.papers().where("doc_id % 21 <> 0"), c.labels())


@query
def review_table(c: Corpus) -> DataFrame:
    return _review(c).select("paper_id", "task", "status", F.md5("title").alias("title_md5"), "split", "truth", "decision", "outcome")


@query
def review_tally(c: Corpus) -> DataFrame:
    return rv.tally(_review(c))


@query
def review_top(c: Corpus) -> DataFrame:
    """The first forty rows that a reviewer opens the table for."""
    return rv.top(_review(c).where("task = 'power_analysis'"), 40, *rv.sort_keys()).select("paper_id", "outcome", "confidence")


@query
def review_sample(c: Corpus) -> DataFrame:
    return rv.sample(c.papers().where("verdict = 'DROPPED'"), "paper_id")


@query
def review_words(c: Corpus) -> DataFrame:
    return _review(c).select("paper_id", "task", rv.verdict_word(F.col("task"), F.col("decision")).alias("said"), rv.verdict_word(F.col("task"), F.col("truth")).alias("wanted"), rv.heading(F.col("task"), F.col("outcome")).alias("heading"))


@query
def review_cited_rules(c: Corpus) -> DataFrame:
    rules = _rules(c).withColumn("text", rv.inline_markup(F.concat(F.lit("**"), "rule", F.lit(".** <b> & `x` *it*"))))
    return rv.cited_rules(_review(c), rules)


@query
def review_unsettled(c: Corpus) -> DataFrame:
    decisions = _docs(c, _pick(_d(), "no_issue", "later", "dropped").alias("decision")).where(_d() % 4 != 0)
    return rv.unsettled(c.papers().select("paper_id"), decisions)


@query
def exclusion_reasons(c: Corpus) -> DataFrame:
    x = c.papers().where("verdict = 'DROPPED'").select("paper_id")
    notes = _docs(c, _pick(_d(), "note", " ", "").alias("note")).where(_d() % 2 == 0)
    queue = _docs(c, _pick(_d(), "problem", "").alias("problem")).where(_d() % 3 != 0)
    return rv.reasons(x, notes, queue, "no reason recorded")


@query
def exclusion_log_titles(c: Corpus) -> DataFrame:
    log = _docs(c).where(_d() % 13 == 0).select("paper_id")
    return rv.log_with_titles(log, c.papers().where("doc_id % 2 = 0")).select("paper_id", F.md5("title").alias("title_md5"))


@query
def strip_totals(c: Corpus) -> DataFrame:
    return rv.strip_totals(_with_references(c).select(tx.strip_references(F.col("text")).alias("s")).select("s.*"))


@query
def strip_records(c: Corpus) -> DataFrame:
    """Records of stripped texts: current unless the text or the rules have changed since."""
    x = _with_references(c).select("doc_id", "text", tx.strip_record(F.col("text")).alias("r"))
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return x.select("doc_id", "r.method", "r.stripped", "r.source_text_sha256", tx.is_current(F.col("r"), changed).alias("current"), tx.explain(F.col("r.reason")).alias("why"))


@query
def eval_statuses(c: Corpus) -> DataFrame:
    x = _cases(c)
    return x.groupBy(ev.status(F.col("judged"), F.col("truth"), F.col("decision")).alias("status")).agg(F.count("*").alias("n"))


@query
def eval_presentation(c: Corpus) -> DataFrame:
    """Figures as a report prints them."""
    r = ev.undecidable_rate(ev.rates(ev.confusion(_cases(c, "power_analysis"))))
    return r.select(rv.metric(F.col("accuracy"), True).alias("accuracy"), rv.metric(F.col("f1")).alias("f1"), rv.metric(F.col("undecidable_rate"), True).alias("undecidable_rate"), rv.metric(F.nullif(F.col("missing"), F.col("missing"))).alias("none"), rounded(F.col("accuracy")).alias("rounded"))


# --- records --------------------------------------------------------------------------------------------------------


@query
def records_history(c: Corpus) -> DataFrame:
    n = F.col("n_nationkey")
    base = c.table("nation").select(n.alias("nth"), _pick(n, *TASKS).alias("task"), F.lit("build").alias("split"), F.concat(F.lit("v"), (n % 4).cast("string")).alias("promptbook_version"), F.concat(F.lit("run"), n.cast("string")).alias("run_ids"), _pick(n, "comparable", "comparable", "mixed_configuration").alias("configuration_status"), F.concat(F.lit("f"), (n % 2).cast("string")).alias("configuration_fingerprint"))
    existing = base.where("nth < 12 and task <> 'data_analysis'")
    return rc.history_rows(base.where("nth >= 6").drop("nth"), existing).select("task", "run_ids", "refusal", "comparable_to_previous", "comparison_note")


@query
def records_unwritten(c: Corpus) -> DataFrame:
    j = c.judgments()
    return rc.unwritten(j.where("response_id is not null"), j.where("doc_id % 3 = 0")).select("paper_id", "task", "judgment_index")


@query
def records_response_tasks(c: Corpus) -> DataFrame:
    j = c.judgments().withColumn("response_id", F.when(F.col("run_id").isNotNull(), F.concat(F.lit("r"), "paper_id")))
    return rc.response_tasks(j)


@query
def records_next_judgments(c: Corpus) -> DataFrame:
    """A batch that is sound as a whole gets its indices; test_records holds one that isn't."""
    j = c.judgments().select("paper_id", "doc_id", "task", "judgment_index", "decision", "confidence", "run_id", "response_id")
    batch = j.where("judgment_index = 1 and run_id is not null").withColumn("response_id", F.concat(F.lit("new-"), "response_id")).drop("judgment_index")
    return rc.append_judgments(batch, j, c.runs()).select("paper_id", "task", "judgment_index")


@query
def records_ledger(c: Corpus) -> DataFrame:
    return rc.ledger_rows(c.checked()).withColumn("detail", F.length("detail"))


@query
def records_response_ids(c: Corpus) -> DataFrame:
    d = _d()
    return _docs(c, rc.response_id(F.lit("run-1"), d.cast("string"), d % 3 + 1, F.when(d % 2 == 0, F.concat(F.lit("req"), d.cast("string"))).otherwise(" ")).alias("response_id")).drop("doc_id")


@query
def records_tokens(c: Corpus) -> DataFrame:
    """The first token stands in every third text, so the second is taken."""
    d = _d()
    seed = F.concat(F.lit("s"), d.cast("string"))
    text = F.when(d % 3 == 0, F.concat("text", F.lit(" "), F.substring(F.sha2(F.concat(seed, F.lit(":0")), 256), 1, 16))).otherwise(F.col("text"))
    return _docs(c, rc.blinded_token(seed, text).alias("token")).drop("doc_id")


@query
def records_prompts(c: Corpus) -> DataFrame:
    d = _d()
    task = _pick(d, *TASKS)
    return _docs(c, F.sha2(rc.prompt(F.concat(F.lit("t"), d.cast("string")), F.col("text"), F.concat(F.lit("# "), task), task), 256).alias("prompt_sha256")).drop("doc_id")


@query
def records_files(c: Corpus) -> DataFrame:
    x = _parts(c)
    return rc.file_accounts(x["files"], x["papers"])


@query
def records_drift(c: Corpus) -> DataFrame:
    d = _d()
    rows = _docs(c, F.md5("text").alias("md5"), F.when(d % 3 == 0, F.md5("text")).when(d % 3 == 1, F.md5(F.lit("x"))).otherwise(" ").alias("archived_md5"))
    return rc.drift(rows).select("paper_id", "drift")


@query
def records_repairs(c: Corpus) -> DataFrame:
    e = F.col("event_id")
    alternatives = c.table("events").select(F.col("user_id").cast("string").alias("paper_id"), e.alias("nth"), F.concat(F.lit("f"), e.cast("string")).alias("file"), _pick(e, "MISMATCH", "VERIFIED", "WEAK").alias("verdict"))
    return rc.repaired(alternatives)


@query
def records_to_score(c: Corpus) -> DataFrame:
    return rc.to_score(c.papers().select("paper_id"), _docs(c).where(_d() % 6 == 0))


@query
def extraction_report(c: Corpus) -> DataFrame:
    got = _docs(c, _pick(_d(), "text", "ocr").alias("method"), F.col("n_chars").alias("chars"), (_d() % 7).alias("pages")).where(_d() % 10 != 0).drop("doc_id")
    return rc.extraction_report(c.papers(), got)


@query
def fetch_protected(c: Corpus) -> DataFrame:
    return _docs(c, rc.protected(_pick(_d(), "MANUAL_DROPPED", "manual", None, "AUTO")).alias("protected"), rc.preflight_ok(F.when(_d() % 4 != 0, F.col("n_chars"))).alias("preflight_ok"), rc.folder_of(_pick(_d(), "unlabelled", "human_labelled")).alias("folder")).drop("doc_id")


@query
def round_run_log(c: Corpus) -> DataFrame:
    return rc.run_log(c.papers().where("n_chars > 500"), c.papers().where("n_chars <= 500"))


# --- report statistics ------------------------------------------------------------------------------------------------


def _trials(c: Corpus) -> DataFrame:
    d = _d()
    return _docs(
        c, _pick(d, "", "", "", "Baseline paper", "", "secondary data; baseline", "Second study, same group", "", "Pilot; not a group-randomized trial", "review of methods", "").alias("exclude_reason"), _pick(d, " Yes", "no", "", "NO").alias("data_correct"), _pick(d, "no", "yes ", "x").alias("power_correct"),
        _pick(d, "none", "Stratified", "", "pair matched", "constrained", "minimised").alias("restricted_rand"), _pick(d, "clustering", "Clustering and stratified", "neither", "").alias("data_done"), _pick(d, "none", "CLUSTERING").alias("power_done"),
        F.when(d % 9 != 0, d % 5 + 1).alias("n_levels"), _pick(d, "yes", " YES ", "no").alias("stepped_wedge"), _pick(d, "12", "~30 per arm", "NR", "5000-20000", "<8>", "unknown", "").alias("n_outer"),
    )


@query
def trials_design(c: Corpus) -> DataFrame:
    x = st.derive_design(_trials(c))
    return x.select("paper_id", "excluded", "data_correct_n", "power_correct_n", "rr_flag", "design_type", "ignored_data_c", "ignored_power_c", st.first_number(F.col("n_outer")).alias("n_outer_n"))


@query
def trials_characteristics(c: Corpus) -> DataFrame:
    return st.review_counts(st.derive_design(_trials(c)))


@query
def trials_flow(c: Corpus) -> DataFrame:
    return st.flow_counts(st.derive_design(_trials(c)))


def _two_agencies(c: Corpus, column: str) -> DataFrame:
    """Published cells of one agency above the counted rows of the other."""
    nci = [("Clustering alone", 1, 20), ("Clustering alone", 0, 10), ("Ignored RR only", 1, 32), ("Ignored RR only", 0, 34), ("Ignored both", 1, 19), ("Ignored both", 0, 47)]
    own = st.ignored_rows(st.derive_design(_trials(c)), column).groupBy("stratum", "ignored").agg(F.count("*").alias("count"))
    return c.spark.createDataFrame(nci, "stratum string, ignored int, count long").withColumn("agency", F.lit("A")).unionByName(own.withColumn("agency", F.lit("B")))


@query
def trials_ignored(c: Corpus) -> DataFrame:
    return _two_agencies(c, "ignored_power_c")


@query
def trials_marginals(c: Corpus) -> DataFrame:
    rows = _two_agencies(c, "ignored_data_c").withColumn("alone", (F.col("stratum") == "Clustering alone").cast("int"))
    return st.marginals(rows, "ignored", "alone")


def _strata(c: Corpus) -> DataFrame:
    return st.weighted_cells(_two_agencies(c, "ignored_power_c"), F.col("agency") == "A", F.col("ignored") == 1, F.col("count"), "stratum")


@query
def trials_cmh(c: Corpus) -> DataFrame:
    x = st.cmh(_strata(c)).crossJoin(F.broadcast(st.cmh_exact(_strata(c)).drop("strata")))  # a row each
    return x.select("strata", F.round("statistic", 6).alias("statistic"), F.round("odds_ratio", 6).alias("odds_ratio"), F.round("p_value", 6).alias("p_value"))


@query
def corpus_active(c: Corpus) -> DataFrame:
    """Papers that count: neither dropped nor without a file."""
    return mf.active(c.papers()).where("status = 'OK'").select("paper_id", "verdict")


@query
def dedupe_first_per_key(c: Corpus) -> DataFrame:
    return rv.newest_first(c.table("events").select("user_id", F.col("event_id").alias("nth")), "user_id").where("place = 1").drop("place")


