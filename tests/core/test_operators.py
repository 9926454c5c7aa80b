import json
import re

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.functions.similarity import fold, token_set
from dossier.operators import corpus as cp
from dossier.operators import evaluate as ev
from dossier.operators import judgments as jd
from dossier.operators import labels as lb
from dossier.operators import replies as rp
from dossier.operators import splits as sp
from dossier.operators import stats as st

COUNTS = "eligible long, tp long, tn long, fp long, fn long, undecidable long, wrong_text long, missing long, unlabeled long"


def counts(spark, tp, tn, fp, fn, missing=0, eligible=0):
    return spark.createDataFrame([(eligible, tp, tn, fp, fn, 0, 0, missing, 0)], COUNTS)


# Published figures of three evaluations: counts, then rates, kappa and intervals to four places.
@pytest.mark.parametrize("cells, want, kappa, low, high", [
    ((31, 12, 5, 0), {"accuracy": 0.8958, "sensitivity": 1.0, "specificity": 0.7059, "precision": 0.8611, "npv": 1.0, "f1": 0.9254, "balanced_accuracy": 0.8529}, 0.7561, 0.7783, 0.9547),
    ((3, 36, 5, 5), {"accuracy": 0.7959, "sensitivity": 0.375, "specificity": 0.878}, 0.253, 0.6636, 0.8852),
    ((2, 36, 5, 5), {"accuracy": 0.7917, "sensitivity": 0.2857, "specificity": 0.878}, 0.1638, 0.6574, 0.8827),
])
def test_published_figures(spark, cells, want, kappa, low, high):
    c = counts(spark, *cells)
    r = ev.rates(c).first()
    assert {k: round(r[k], 4) for k in want} == want
    assert round(ev.kappa(c).first().kappa, 4) == kappa
    i = ev.intervals(c).first()
    assert (round(i.accuracy_low, 4), round(i.accuracy_high, 4)) == (low, high)


def test_undefined_is_null(spark):
    r = ev.rates(counts(spark, 0, 0, 0, 0)).first()
    assert r.accuracy is None and r.coverage is None and r.f1 is None
    assert ev.kappa(counts(spark, 5, 0, 0, 0)).first().kappa is None
    assert ev.intervals(counts(spark, 0, 0, 0, 0)).first().accuracy_low is None


def test_six_papers(spark):
    labels = spark.createDataFrame([("tp", "r"), ("fn", "r"), ("fp", None), ("tn", ""), ("u", None), ("w", "r")], "paper_id string, exclusion_reason string").withColumn("power", F.lit("yes")).withColumn("stats", F.lit(None).cast("string"))
    said = [("tp", "yes"), ("fn", "no"), ("fp", "yes"), ("tn", "no"), ("u", "undecidable"), ("w", "wrong_text"), ("x", "yes")]
    latest = spark.createDataFrame([(p, d, 0.9, "r1") for p, d in said], "paper_id string, decision string, confidence double, run_id string")
    c = ev.confusion(ev.cases(labels, latest, "exclusion"))
    r = ev.rates(c).first()
    assert (r.eligible, r.scored, r.tp, r.tn, r.fp, r.fn, r.undecidable, r.wrong_text, r.missing, r.unlabeled) == (6, 4, 1, 1, 1, 1, 1, 1, 0, 1)
    assert ev.kappa(c).first().kappa == 0
    none = ev.confusion(ev.cases(labels, latest, "data_analysis")).first()
    assert none.eligible == 0 and none.unlabeled == 7


def test_latest_within_version(spark):
    j = spark.createDataFrame([("a", "t", 1, "v1", "yes"), ("a", "t", 2, "v2", "no")], "paper_id string, task string, judgment_index int, promptbook_version string, decision string")
    assert jd.latest_judgments(j, "paper_id", version="v1").first().decision == "yes"
    assert jd.latest_judgments(j, "paper_id").first().decision == "no"


def test_split_is_stable_and_half_even(spark):
    rows = spark.createDataFrame([(str(i), "a" if i < 15 else "b") for i in range(20)], "paper_id string, stratum string")
    got = {r.paper_id: r.split for r in sp.assign_split(rows, "s", 0.3).collect()}
    assert sum(v == "holdout" for k, v in got.items() if int(k) < 15) == 4 and sum(v == "holdout" for k, v in got.items() if int(k) >= 15) == 2
    assert got == {r.paper_id: r.split for r in sp.assign_split(rows.orderBy(F.desc("paper_id")), "s", 0.3).collect()}
    r = sp.interleave(rows, "s", 7).collect()
    assert sorted(x.nth for x in r) == list(range(1, 21)) and {x.round for x in r} == {1, 2, 3}


def test_calibration_edges(spark):
    x = spark.createDataFrame([("true_positive", c) for c in (0.0, 0.29, 0.57, 0.9, 1.0)], "outcome string, confidence double")
    assert {r.bin: r.n for r in ev.calibration_bins(x).collect()} == {0: 1, 2: 1, 5: 1, 9: 2}


def brute_strip(text):
    """The rules in plain Python: reason, text, characters behind the bibliography."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if re.match(r"(?i)^[\s\d.)*•#]*(references?|reference list|bibliography|works cited|literature cited)\s*[:.]?\s*$", x.strip())]
    if not text.strip():
        return "empty", text, 0
    if not at:
        return "no_heading", text, 0
    body, tail = "\n".join(lines[: at[-1]]), lines[at[-1] :]
    if len(body) / len(text) < 0.3:
        return "heading_too_early", text, 0
    after = next((i for i, x in enumerate(tail) if re.match(r"(?i)^[\s\d.)*•#]*(appendix|appendices|supplement(ary|al)?|additional file|supporting information|online supplement|web appendix|e-?appendix|annex)\b", x.strip())), 0)
    rest = "\n".join(tail[after:]) if after else ""
    out = "\n\n".join([body.rstrip(), tx.MARKER, *([rest.lstrip("\n")] if rest else [])]) + "\n"
    return ("cut_too_large", text, 0) if (len(text) - len(out)) / len(text) > 0.6 else ("", out, len(rest))


def test_reference_strip(spark):
    body = "some words here\n" * 20
    texts = ["", " \n", "plain", body + "References\n1. a\n2. b", body + "References\n1. a\nAppendix A\nmore", "References\n" + body, "short\nReferences\n" + "ref\n" * 50, body + "REFERENCES:\nx\n" + body + "7. Bibliography\ny", body + "No references here\n", body * 2 + "Works Cited.\n" + "r\n" * 40 + "Supplementary\nz", "References", body + "\n\n * Reference list \na\n\ne-Appendix: b", body + "Annex\nReferences\nx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.strip_references(F.col("t")).alias("s"), tx.strip_record(F.col("t")).alias("r"), tx.is_current(tx.strip_record(F.col("t")), F.col("t")).alias("now")).orderBy("i").collect()
    assert [(r.s.reason, r.s.text, r.s.tail_chars) for r in df] == [brute_strip(t) for t in texts]
    assert all(r.now and r.r.method == tx.STRIP_METHOD for r in df)


def test_text_columns(spark):
    t = "See Smith et al. (2001) and Jones 1999; Smith et al. (2001), Lee & Roe, 2020, Kim (2003) and The 2019 cohort."
    r = spark.createDataFrame([(t, "\ufeffa\r\nb\rc", None)], "t string, b string, n string").select(
        tx.other_papers(F.col("t")).alias("o"), tx.clean_text(F.col("b")).alias("c"), tx.clean_text(F.col("n")).alias("n"), tx.rule_citations(F.lit("E1 E1 P2 E12")).alias("r"), tx.rule_citations(F.lit("E1 E1 P2 E12"), "E").alias("e"),
        tx.other_dois(F.lit("10.1000/a"), F.lit("10.1000/A, 10.2000/b. 10.2000/b)")).alias("d"), tx.clean_bytes(F.expr("X'61FF620A'")).alias("y"),
        tx.text_notes(tx.clean_text(F.col("b")), F.lit(0), F.lit("no_heading"), F.lit("")).alias("notes"),
    ).first()
    assert r.o == sorted({"Smith et al. (2001)", "Lee & Roe, 2020", "Kim (2003)"})
    assert (r.c.text, r.c.had_bom, r.c.had_crlf, r.n.is_empty) == ("a\nb\nc", True, True, True) and (r.y.text, r.y.replaced) == ("a\ufffdb\n", 1)
    assert r.notes == "bom_stripped;crlf_normalized;refs_kept:no_heading;refs_unprepared"
    assert r.r == ["E1", "E1", "P2", "E12"] and r.e == ["E1", "E12"] and r.d == ["10.2000/b"]


def test_notices_and_paperwork(spark):
    """A notice announces itself in front of a colon or bracket; trials about corrections are trials, and funding statements are no paperwork."""
    titles = {"Erratum: x": True, "Publisher Correction to: y": True, "[Retracted] z": True, "(Withdrawn) z": True, "Reentry from Corrections to Community Treatment": False, "Neonatal Opioid Withdrawal": False, "The correction: of": False, "Correction of myopia in children in a trial: results": False, "Expression of  concern: a": True}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", tx.is_correction(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == titles
    heads = {"PRIVILEGED\n  Communication": True, "Summary Statement": True, "resume and summary of discussion": True, "Principal investigator: Jane Doe": False, "Grant application": False, "x" * 1500 + " summary statement": False}
    got = spark.createDataFrame([(t,) for t in heads], "t string").select("t", tx.is_administrative(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == heads


def test_cleaners(spark):
    raw = {"Yes": "yes", "n (x)": "no", "no\u2014see": "no", "": "", "maybe": "", " Y,": "yes", "yesterday": "", "NO": "no"}
    rows = spark.createDataFrame([(x,) for x in raw], "x string").select("x", lb.clean_yes_no(F.col("x")).alias("c"), lb.clean_reason(F.col("x")).alias("r")).collect()
    assert {r.x: r.c for r in rows} == raw
    words = {"Secondary  Analysis": "secondary_analysis", " pilot STUDY ": "pilot_study", "odd": "other", None: "", "multiple trials from the same research group": "duplicate_group_random_drop"}
    got = spark.createDataFrame([(x,) for x in words], "x string").select("x", lb.clean_reason(F.col("x")).alias("c")).collect()
    assert {r.x: r.c for r in got} == words


def test_python_rounding(spark):
    from dossier.functions.columns import rounded

    values = [2.675, 0.00005, 0.00015, 0.12345, 1.00005, 0.5, 1 / 3, -0.00005, 0.8958333, 1e-9, 123.45675, 0.00025]
    got = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(rounded(F.col("v")).alias("r")).collect()]
    assert got == [round(v, 4) for v in values]


def test_latex_and_citations(spark):
    from dossier.functions import citations as ct
    from dossier.functions.similarity import last_name

    cells = {r"Hern\'andez-Gald{\'a}mez et al.\textsuperscript{\cite{h2001}} & \textit{x} --- y \\\\": "Hern\u00e1ndez-Gald \u00e1mez et al. & x \u2014 y", r"a{b}c \emph{d} \% $\sim$5 \&": "a b c d % ~5 &"}
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", ct.strip_latex(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in got} == cells
    keys = {"abdullahiHydroxyureaPrimaryStroke2022": ("abdullahi", "hydroxyurea primary stroke", "2022"), "abrahams-gesselPointOfCare2001a": ("abrahamsgessel", "point of care", "2001"), "x": ("x", "", ""), "NoAuthor1999": ("", "no author", "1999")}
    got = spark.createDataFrame([(c,) for c in keys], "c string").select("c", ct.cite_key(F.col("c")).alias("k")).collect()
    assert {r.c: tuple(r.k) for r in got} == keys
    r = spark.range(1).select(ct.citation(F.lit(" 83. (Hershman, Bansal, et al., 2023b) ")).alias("c"), ct.citation(F.lit("Hershman 2023")).alias("n")).first()
    assert tuple(r.c) == ("83", "Hershman, Bansal, et al.", "2023", "b") and set(r.n) == {""}
    assert [last_name(x) for x in ("Mary O\u2019Connor", "Jos\u00e9 \u00c1lvarez-P\u00e9rez", "", "Li")] == ["oconnor", "alvarezperez", "", "li"]


def test_semantic_order(spark):
    """The first failure in the order of the rules, by golden rows."""
    rows = [
        ("wrong_text", "WRONG_TEXT", "power_analysis", "t", "E1"), ("yes", "E1", "exclusion", None, "E10"), ("wrong_text", "E5", "exclusion", "t", "E6"), ("wrong_text", " wrong_text ", "exclusion", "t", None), ("yes", "prose", "exclusion", "t", "E6"),
        ("yes", "P3", "exclusion", "t", "E4"), ("yes", "E99", "exclusion", "t", "E3/E5"), ("yes", "E1, E2", "exclusion", "t", None), ("yes", "E1 and P1", "exclusion", "t", "E4"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, e string, t string, echo string, want string").withColumn("known", F.array(F.lit("E1"), F.lit("E2")))
    got = df.select("i", "want", rp.decision_case(F.col("t"), F.col("d"), F.col("e"), F.lit(0.5), F.col("echo"), F.col("known")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [r.want for r in got]
    said = {"the data analysis decision was yes": True, "based on the data-analysis": True, "a data analysis plan": False, "power analysis result": False}
    got = spark.createDataFrame([(s,) for s in said], "s string").select("s", tx.leans_on_other_task(F.lit("power_analysis"), F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in got} == said
    got = spark.createDataFrame([("t", "t"), ("", "t"), (None, "t"), ("u", "t")], "a string, b string").select(rp.token_case(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in got] == [None, None, None, "E9"]


def test_replies(spark):
    good = {"decision": " Yes ", "reasoning": "r", "promptbook_evidence": "E1", "confidence": 1}
    raws = [json.dumps(good), "```json\n" + json.dumps(good) + "\n```", "[1]", None, json.dumps(good | {"x": 1}), json.dumps(good | {"reasoning": "r" * 201}), json.dumps({k: v for k, v in good.items() if k != "confidence"}), json.dumps(good | {"decision": "wrong_text"})]
    df = spark.createDataFrame([(str(i), "power_analysis", r) for i, r in enumerate(raws)], "paper_id string, task string, raw string")
    got = [r.failure for r in rp.parse(df).orderBy("paper_id").collect()]
    assert got == [None, None, "not_an_object", "empty", "unknown_key", "reasoning", "confidence", "wrong_text_outside_exclusion"]
    use = spark.createDataFrame([('{"a": [{"type": "tool_use"}]}',), ('{"t": "{\\"type\\": \\"tool_use\\"}"}',), ("{",), (None,)], "raw string")
    assert [r.u for r in use.select(rp.uses_tool("raw").alias("u")).collect()] == [True, False, False, False]


def test_exact_tests(spark):
    t = spark.createDataFrame([("x", 31, 65, 12, 40), ("y", 3, 1, 1, 3), ("z", 0, 0, 0, 0)], "k string, a long, b long, c long, d long")
    p = {r.k: r.p_value for r in st.fisher(t, "k").collect()}
    assert abs(p["x"] - 0.26121630089615) < 1e-9 and abs(p["y"] - 0.4857142857) < 1e-9 and p["z"] == 1.0
    assert st.cmh(t.where("k = 'z'")).first().statistic is None


def test_corpus_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "paper_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "paper_id string, v int")
    assert {tuple(r) for r in cp.upsert(old, new).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert fold("Éa-\nb  C!") == "eab c" and fold("plan- \n ning ﬁt") == "planning fit" and token_set("a b c", "c b a") == 100.0 and token_set("a b", "b a c") == 100.0


def test_rule_texts(spark):
    from dossier.operators.manifest import rule_texts

    book = ["# Rules", "1. **E5.** Not a", "   trial of people.", "2. **P1.** Power", "", "   is told.", "## Next", "   stray", "3. **D2.** Data", "Plain line"]
    df = spark.createDataFrame([("b", i, v) for i, v in enumerate(book)], "book string, nth int, value string")
    assert {r.rule: r.text for r in rule_texts(df).collect()} == {"E5": "**E5.** Not a trial of people.", "P1": "**P1.** Power is told.", "D2": "**D2.** Data"}
