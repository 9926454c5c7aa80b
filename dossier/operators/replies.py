"""Stored model replies: event streams, provenance, token counts, validation with ordered severities."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from dossier.functions.columns import count_if, joined_set, ladder, ratio, strip
from dossier.functions.text import leans_on_other_task, rule_citations

ALLOWED_KEYS = ("decision", "reasoning", "promptbook_evidence", "confidence", "task", "paper_id")
DECISIONS = ("yes", "no", "undecidable", "wrong_text")
PREFIX = {"exclusion": "E", "power_analysis": "P", "data_analysis": "D"}


def events(lines: DataFrame) -> DataFrame:
    """(stream_id, line, raw) -> parsed events in order; lines that are no JSON object are skipped."""
    v = lines.withColumn("v", F.try_parse_json("raw")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return v.select("stream_id", "line", "v", F.expr("try_variant_get(v, '$.type', 'string')").alias("kind"), F.expr("try_variant_get(v, '$.subtype', 'string')").alias("subtype"))


def assistant_text(found: DataFrame) -> DataFrame:
    """Text blocks of assistant events in order; without any, the last result."""
    blocks = "try_variant_get(v, '$.message.content', 'array<struct<type:string,text:string>>')"
    said = found.where("kind = 'assistant'").select("stream_id", "line", F.posexplode(F.expr(blocks)).alias("at", "b")).where("b.type = 'text'")
    text = said.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "at", F.col("b.text").alias("text")))), lambda x: x["text"]), "").alias("text"))
    last = found.where("kind = 'result'").groupBy("stream_id").agg(F.max_by(F.expr("try_variant_get(v, '$.result', 'string')"), "line").alias("result"))
    return found.select("stream_id").distinct().join(text, "stream_id", "left").join(last, "stream_id", "left").select("stream_id", F.coalesce("text", "result").alias("text"))


def usage(found: DataFrame) -> DataFrame:
    """Tokens of a stream: the result's, else the first assistant's, else absent; sums of what is reported, null if nothing is."""
    fields = ("input_tokens", "cache_read_input_tokens", "output_tokens")
    got = F.struct(*(F.coalesce(F.expr(f"try_variant_get(v, '$.usage.{f}', 'long')"), F.expr(f"try_variant_get(v, '$.message.usage.{f}', 'long')")).alias(f) for f in fields))
    rank = F.when(F.col("kind") == "result", 0).otherwise(1)
    has = F.expr("try_variant_get(v, '$.usage', 'variant') is not null or try_variant_get(v, '$.message.usage', 'variant') is not null")
    first = found.where(F.col("kind").isin("result", "assistant") & has).groupBy("stream_id").agg(F.min_by(got, F.struct(rank.alias("r"), "line")).alias("u"))
    i, c = F.col("u.input_tokens"), F.col("u.cache_read_input_tokens")
    billed = F.when(i.isNotNull() | c.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)))
    return found.select("stream_id").distinct().join(first, "stream_id", "left").select("stream_id", billed.alias("billed_input"), F.col("u.output_tokens").alias("output_tokens"))


# What the last event says of a run, what its usage says, and the serving path that every run must have taken.
RESULT_FIELDS = {
    "session_id": "string", "duration_ms": "long", "duration_api_ms": "long", "ttft_ms": "long", "num_turns": "long", "stop_reason": "string", "terminal_reason": "string", "total_cost_usd": "double", "service_tier": "string",
    "inference_geo": "string", "context_window": "long", "max_output_tokens": "long", "fast_mode_state": "string",
}
USAGE_FIELDS = {"input_tokens": "long", "output_tokens": "long", "cache_read_input_tokens": "long", "cache_creation_input_tokens": "long", "speed": "string"}
#: The field of an init event that holds the version of the command line tool.
VERSION_FIELD = "claude_code_version"
SERVING = {"fast_mode_state": "off", "speed": "standard", "service_tier": "standard"}


def _get(path: str, kind: str, v: str = "v") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def headlines(found: DataFrame) -> DataFrame:
    """One row per stream: its first init and result event, its usage and the first request id that an assistant event has; absent ones are null."""
    init, result, said = (F.col("kind") == "system") & (F.col("subtype") == "init"), F.col("kind") == "result", F.col("kind") == "assistant"
    usage_of = F.coalesce(F.when(result, _get("usage", "variant")), F.when(said, _get("message.usage", "variant")))
    place = F.struct(F.when(result, 0).otherwise(1).alias("r"), "line")
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when & value.isNotNull(), F.col("line")))
    return found.groupBy("stream_id").agg(
        first(F.col("v"), init).alias("init"), first(F.col("v"), result).alias("result"), F.min_by(usage_of, F.when(usage_of.isNotNull(), place)).alias("usage"),
        first(F.nullif(_get("request_id", "string"), F.lit("")), said).alias("request_id"),
    )


def provenance(found: DataFrame) -> DataFrame:
    """What a stream says about its run in 23 columns; what it doesn't say stays null, never zero."""
    h = headlines(found)
    own = {k: _get(k, t, "result") for k, t in RESULT_FIELDS.items()} | {k: _get(k, t, "usage") for k, t in USAGE_FIELDS.items()}
    own["service_tier"] = F.coalesce(own["service_tier"], _get("service_tier", "string", "usage"))
    i, c = own["input_tokens"], own["cache_read_input_tokens"]
    w = own["cache_creation_input_tokens"]
    billed = F.when(i.isNotNull() | c.isNotNull() | w.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)) + F.coalesce(w, F.lit(0)))
    return h.select(
        "stream_id", *(x.alias(k) for k, x in own.items()), _get(VERSION_FIELD, "string", "init").alias("cli_version"), _get("model", "string", "init").alias("reported_model"), billed.alias("billed_input_tokens"), "request_id",
        F.size(_get("permission_denials", "array<variant>", "result")).alias("permission_denials"),
    )


def provenance_failure(found: DataFrame, model: str) -> DataFrame:
    """The first thing wrong with a stream's provenance, loudest first: severity REFUSE, FATAL (the round is void) or RETRY (one paper) and its case; nulls if sound."""
    h = headlines(found)
    denied = F.coalesce(F.size(_get("permission_denials", "array<variant>", "result")), F.lit(0)) > 0
    detour = F.lit(False)
    for k, wanted in SERVING.items():
        detour = detour | F.coalesce(F.coalesce(_get(k, "string", "result"), _get(k, "string", "usage")) != wanted, F.lit(False))
    reported = F.nullif(_get("model", "string", "init"), F.lit(""))
    rules = [
        (F.col("init").isNull() | F.coalesce(F.nullif(_get(VERSION_FIELD, "string", "init"), F.lit("")).isNull(), F.lit(True)), "REFUSE", "G4"), (F.coalesce(reported != model, F.lit(False)), "FATAL", "G3"), (F.col("result").isNull(), "RETRY", "G5"),
        (denied, "FATAL", "G8"), (detour, "FATAL", "G12"), (F.coalesce(_get("stop_reason", "string", "result") == "max_tokens", F.lit(False)), "RETRY", "G9"), (F.col("request_id").isNull(), "RETRY", "G6"),
    ]
    return h.select("stream_id", ladder([(c, s) for c, s, _ in rules]).alias("severity"), ladder([(c, k) for c, _, k in rules]).alias("case"))


def mixed_versions(runs: DataFrame) -> DataFrame:
    """round, version -> rounds that ran under more than one version are two experiments and void."""
    v = F.nullif("version", F.lit(""))
    return runs.groupBy("round").agg(F.countDistinct(v).alias("versions"), F.array_join(F.array_sort(F.collect_set(v)), ";").alias("seen")).withColumn("discarded", F.col("versions") > 1)


COMPARABLE = ("model", "effort", "system_prompt_sha256", "promptbook_version", "promptbook_sha256")


def compare_environments(pairs: DataFrame) -> DataFrame:
    """Two runs' environments (structs ``first`` and ``second``): refused if any field that makes rounds comparable differs, with its name."""
    moved = F.filter(F.array(*(F.when(~F.col(f"first.{f}").eqNullSafe(F.col(f"second.{f}")), F.lit(f)) for f in COMPARABLE)), lambda x: x.isNotNull())
    return pairs.withColumn("moved", F.array_join(moved, ";")).withColumn("refused", F.size(moved) > 0).drop("first", "second")


def tools_offered(found: DataFrame) -> DataFrame:
    """How many tools the init event offers; null if it says nothing, which isn't zero."""
    tools = F.expr("try_variant_get(v, '$.tools', 'array<string>')")
    g = found.where("kind = 'system'").groupBy("stream_id").agg(F.min_by(tools, "line").alias("tools"))
    return found.select("stream_id").distinct().join(g, "stream_id", "left").select("stream_id", F.when(F.col("tools").isNotNull(), F.size("tools")).alias("n_tools"))


def _has_tool(text: str | None) -> bool:
    try:
        stack = [json.loads(text or "null")]
    except ValueError:
        return False
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if x.get("type") in ("tool_use", "tool_result"):
                return True
            stack += x.values()
        elif isinstance(x, list):
            stack += x
    return False


@F.pandas_udf(BooleanType())
def uses_tool(raw: pd.Series) -> pd.Series:
    """A tool block at any depth; a text that only quotes one doesn't count."""
    return raw.map(_has_tool)


def strip_fences(c: Column) -> Column:
    """A reply without the fence around it: the first line goes, and a closing fence if there is one."""
    text = strip(F.coalesce(c, F.lit("")))
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise("")
    return F.when(text.startswith("```"), strip(F.regexp_replace(body, r"(?U)```\s*\z", ""))).otherwise(text)


def parse(replies: DataFrame) -> DataFrame:
    """Replies with task and raw text -> fields and the first failure in order (null if the reply is sound)."""
    body = strip_fences(F.col("raw"))
    x = replies.withColumn("fenced", strip(F.coalesce("raw", F.lit(""))).startswith("```")).withColumn("v", F.try_parse_json(body)).withColumn("body", body)
    get = lambda k, t="string": F.expr(f"try_variant_get(v, '$.{k}', '{t}')")
    object_ = F.coalesce(F.expr("schema_of_variant(v) like 'OBJECT%'"), F.lit(False))
    x = x.withColumn("decision", F.lower(strip(get("decision")))).withColumn("reasoning", strip(get("reasoning"))).withColumn("evidence", strip(get("promptbook_evidence"))).withColumn("confidence", get("confidence", "double")).withColumn("echo", strip(get("paper_id")))
    extra = F.when(object_, F.array_except(F.json_object_keys("body"), F.array(*(F.lit(k) for k in ALLOWED_KEYS))))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    case = ladder([
        (F.col("body") == "", "empty"), (F.col("v").isNull(), "not_json"), (~object_, "not_an_object"), (F.size(extra) > 0, "unknown_key"), (~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "decision"),
        (blank(F.col("reasoning")) | (F.length("reasoning") > 200), "reasoning"), (blank(F.col("evidence")), "evidence"), (F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence"),
        ((F.col("decision") == "wrong_text") & (F.col("task") != "exclusion"), "wrong_text_outside_exclusion"),
    ])
    return x.withColumn("failure", case).drop("v", "body")


def known_rules(rules: DataFrame) -> DataFrame:
    """task, rule of the promptbook in force -> one row per task."""
    return rules.groupBy("task").agg(F.collect_set("rule").alias("known"))


def decision_case(task: Column, decision: Column, evidence: Column, confidence: Column, echo: Column, known: Column) -> Column:
    """The first thing that is wrong with an answer, in this order; null if nothing is.

    E1 wrong_text outside exclusion; E10 no id echoed; E6 wrong_text must cite WRONG_TEXT, other answers a rule; E4 a rule of another
    task; E3/E5 a rule that the promptbook doesn't define; E7 confidence out of bounds.
    """
    cited, prefix = rule_citations(evidence), ladder([(task == t, p) for t, p in PREFIX.items()], "")
    mistaken = decision == "wrong_text"
    rest = ladder([
        (F.size(cited) == 0, "E6"), (F.exists(cited, lambda r: ~r.startswith(prefix)), "E4"), (F.size(F.array_except(cited, F.coalesce(known, F.array().cast("array<string>")))) > 0, "E3/E5"), (~confidence.between(0, 1), "E7"),
    ])
    return ladder([(mistaken & (task != "exclusion"), "E1"), (echo.isNull(), "E10"), (mistaken & (F.upper(strip(evidence)) != "WRONG_TEXT"), "E6"), (mistaken, None)], rest)


def token_case(echo: Column, token: Column) -> Column:
    """E9 if a reply names another token than the one it was sent: that voids the round, not the paper."""
    said = strip(F.coalesce(echo, F.lit("")))
    return F.when((said != "") & (said != token), "E9")


def semantic(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """Sound replies against the promptbook: the first failure in order."""
    x = parsed.where("failure is null").join(F.broadcast(known_rules(rules)), "task", "left")
    case = decision_case(F.col("task"), F.col("decision"), F.col("evidence"), F.col("confidence"), F.col("echo"), F.col("known"))
    return x.select("paper_id", "task", "decision", F.array_join(rule_citations(F.col("evidence")), ",").alias("cited"), case.alias("semantic_failure"))


ANALYSES = ("power_analysis", "data_analysis")


def parse_combined(replies: DataFrame) -> DataFrame:
    """A reply for both analyses at once becomes two rows, both or neither: a malformed half, or one that brings its own task or id, fails the whole."""
    body = strip_fences(F.col("raw"))
    x = replies.withColumn("body", body).withColumn("v", F.try_parse_json(body))
    keys = lambda path: F.json_object_keys(F.get_json_object("body", path))
    object_ = F.coalesce(F.expr("schema_of_variant(v) like 'OBJECT%'"), F.lit(False))
    bad = ladder([(F.col("body") == "", "empty"), (F.col("v").isNull(), "not_json"), (~object_, "not_an_object"), (F.size(F.array_except(keys("$"), F.array(*(F.lit(k) for k in (*ANALYSES, "paper_id"))))) > 0, "unknown_key")])
    half_keys = F.array(*(F.lit(k) for k in ("decision", "reasoning", "promptbook_evidence", "confidence")))
    halves = []
    for t in ANALYSES:
        get = lambda k, kind="string", t=t: F.expr(f"try_variant_get(v, '$.{t}.{k}', '{kind}')")
        d, r, e, c = F.lower(strip(get("decision"))), strip(get("reasoning")), strip(get("promptbook_evidence")), get("confidence", "double")
        case = ladder([
            (keys(f"$.{t}").isNull(), f"{t}:missing"), (F.size(F.array_intersect(keys(f"$.{t}"), F.array(F.lit("task"), F.lit("paper_id")))) > 0, f"{t}:wrapper_field"), (F.size(F.array_except(keys(f"$.{t}"), half_keys)) > 0, f"{t}:unknown_key"),
            (~F.coalesce(d.isin("yes", "no", "undecidable"), F.lit(False)), f"{t}:decision"), ((F.coalesce(r, F.lit("")) == "") | (F.length(r) > 200), f"{t}:reasoning"), (F.coalesce(e, F.lit("")) == "", f"{t}:evidence"), (c.isNull() | (c < 0) | (c > 1), f"{t}:confidence"),
        ])
        halves.append(F.struct(F.lit(t).alias("task"), d.alias("decision"), r.alias("reasoning"), e.alias("evidence"), c.alias("confidence"), case.alias("half_failure")))
    x = x.withColumn("halves", F.array(*halves)).withColumn("echo", strip(F.expr("try_variant_get(v, '$.paper_id', 'string')")))
    x = x.withColumn("failure", F.coalesce(bad, F.col("halves")[0]["half_failure"], F.col("halves")[1]["half_failure"]))
    return x.drop("v", "body").withColumn("h", F.explode("halves")).select("*", "h.task", "h.decision", "h.reasoning", "h.evidence", "h.confidence").drop("halves", "h")


def check_combined(halves: DataFrame, rules: DataFrame) -> DataFrame:
    """Parsed halves with a token -> case per paper: its first failure over both halves, which rejects both.

    Each half's token, then its own checks, then whether it leans on the other's conclusion.
    """
    x = halves.where("failure is null").join(F.broadcast(known_rules(rules)), "task", "left")
    case = F.coalesce(
        token_case(F.col("echo"), F.col("token")), decision_case(F.col("task"), F.col("decision"), F.col("evidence"), F.col("confidence"), F.col("echo"), F.col("known")),
        F.when(leans_on_other_task(F.col("task"), F.concat_ws("\n", "reasoning", "evidence")), "DC54"),
    )
    nth = F.array_position(F.array(*(F.lit(t) for t in ANALYSES)), F.col("task"))
    return x.groupBy("paper_id").agg(F.min_by(case, F.when(case.isNotNull(), nth)).alias("case"), F.min_by("task", F.when(case.isNotNull(), nth)).alias("failed_task"))


RETRYABLE = ("process", "parse", "semantic", "truncation", "incomplete")
MOST_ATTEMPTS, DETAIL_CHARS = 3, 400


def retry_fields(kind: Column, attempt: Column) -> Column:
    """struct(retry_eligible, terminal_status) of a failure."""
    retryable = kind.isin(*RETRYABLE)
    eligible = retryable & (attempt < MOST_ATTEMPTS)
    return F.struct(F.when(eligible, "yes").otherwise("no").alias("retry_eligible"), F.when(retryable & ~eligible, "review_required").otherwise("").alias("terminal_status"))


def attempt_number(c: Column) -> Column:
    """A number of 1 or more; anything malformed is a first attempt."""
    return F.greatest(F.lit(1), F.coalesce(F.try_to_number(F.regexp_extract(strip(c.cast("string")), r"^[+-]?\d{1,9}$", 0), F.lit("S999999999")).cast("int"), F.lit(1)))


def check_responses(index: DataFrame, has_raw: Column, uses_tools: Column, provenance_case: Column, provenance_severity: Column, leaked: Column, parse_case: Column, token_failure: Column, semantic_case: Column) -> DataFrame:
    """Every response's status by an ordered ladder: process, tools, provenance, leaked ids, parsing, token, meaning; a FATAL voids its round."""
    failed = lambda kind, case="": F.struct(F.lit(kind).alias("kind"), (case if isinstance(case, Column) else F.lit(case)).alias("case"))
    none = F.struct(F.lit("").alias("kind"), F.lit("").alias("case"))
    rules = [
        (F.coalesce(F.col("exit_code").cast("string"), F.lit("")) != "0", failed("process")), (~has_raw, failed("process")), (uses_tools, failed("FATAL", "A1/A2")), (F.coalesce(provenance_severity == "FATAL", F.lit(False)), failed("FATAL", "G3/G8/G12")),
        (F.coalesce(provenance_case == "G9", F.lit(False)), failed("truncation", provenance_case)), (provenance_case.isNotNull(), failed("incomplete", provenance_case)), (leaked, failed("FATAL", "E11")), (parse_case.isNotNull(), failed("parse", "D")),
        (token_failure.isNotNull(), failed("FATAL", "E9")), (semantic_case.isNotNull(), failed("semantic", semantic_case)),
    ]
    x = index.withColumn("f", ladder(rules, none)).withColumn("attempt", attempt_number(F.col("attempt")))
    x = x.withColumn("r", retry_fields(F.col("f.kind"), F.col("attempt"))).withColumn("bad", F.col("f.kind") != "")
    fatal = x.groupBy("round").agg(count_if(F.col("f.kind") == "FATAL").alias("n_fatal"))
    return x.join(fatal, "round").select(
        "paper_id", "round", "attempt", F.when(F.col("bad"), "failed").otherwise("ok").alias("status"), F.col("f.kind").alias("failure_kind"), F.col("f.case").alias("failure_case"),
        F.when(F.col("bad"), F.col("r.retry_eligible")).otherwise("").alias("retry_eligible"), F.when(F.col("bad"), F.col("r.terminal_status")).otherwise("").alias("terminal_status"), (F.col("n_fatal") > 0).alias("round_discarded"),
    )


def resume_state(latest: DataFrame, checked: DataFrame) -> DataFrame:
    """What to do next with each paper: its latest attempt beside the last check of that very response.

    A response is known by its raw path if both sides have one, else by token and attempt.
    """
    key = lambda p: F.coalesce(F.nullif(p, F.lit("")))
    c = checked.select(F.col("paper_id").alias("cp"), key(F.col("raw_path")).alias("c_raw"), F.coalesce("token", F.lit("")).alias("c_token"), attempt_number(F.col("attempt")).alias("c_attempt"), F.col("status").alias("c_status"), F.col("failure_kind").alias("c_kind"), F.col("retry_eligible").alias("c_retry"), "nth")
    a = latest.withColumn("attempt", attempt_number(F.col("attempt"))).withColumn("a_raw", key(F.col("raw_path")))
    same = F.when(F.col("a_raw").isNotNull() & F.col("c_raw").isNotNull(), F.col("a_raw") == F.col("c_raw")).otherwise((F.coalesce("token", F.lit("")) == F.col("c_token")) & (F.col("attempt") == F.col("c_attempt")))
    j = a.join(c, (F.col("paper_id") == F.col("cp")) & same, "left")
    last = j.groupBy("paper_id", "attempt", "exit_code").agg(F.max_by(F.struct("c_status", "c_kind", "c_retry"), F.when(F.col("c_status").isNotNull(), F.col("nth"))).alias("c"))
    crashed = F.coalesce(F.col("exit_code").cast("string"), F.lit("")) != "0"
    kind = F.when(crashed, "process").otherwise(F.coalesce(F.nullif("c.c_kind", F.lit("")), F.lit("semantic")))
    said = F.lower(strip(F.coalesce("c.c_retry", F.lit(""))))
    eligible = crashed | F.when(said != "", said.isin("yes", "true", "1")).otherwise(kind.isin(*RETRYABLE))
    failed = crashed | (F.coalesce("c.c_status", F.lit("")) == "failed")
    state = ladder([(~failed & F.coalesce(F.col("c.c_status") == "ok", F.lit(False)), "accepted"), (~failed, "awaiting_check"), (~eligible | (F.col("attempt") >= MOST_ATTEMPTS), "review_required")], "retry")
    return last.select("paper_id", "attempt", state.alias("state"), F.when(state == "retry", F.col("attempt") + 1).alias("next_attempt"), F.when(state.isin("retry", "review_required"), kind).otherwise("").alias("failure_kind"))


def billing(runs: DataFrame) -> DataFrame:
    """Totals of a run log: tokens, calls that report none, and cost over the numbers that are there."""
    cost = F.expr("try_cast(total_cost_usd as double)")
    return runs.groupBy("task").agg(F.count("*").alias("calls"), F.sum("billed_input_tokens").alias("billed_input_tokens"), count_if(F.col("billed_input_tokens").isNull()).alias("unreported"), F.sum(cost).alias("cost"))


def canary(rows: DataFrame, margin: float = 0.15) -> DataFrame:
    """Do answers follow a decoy label rather than the truth?  Only rows where the two differ count."""
    x = rows.where("truth <> decoy").agg(F.count("*").alias("n"), ratio(count_if(F.col("decision") == F.col("truth")), F.count("*")).alias("truth_rate"), ratio(count_if(F.col("decision") == F.col("decoy")), F.count("*")).alias("decoy_rate"))
    return x.withColumn("suspicious", F.col("decoy_rate") > F.col("truth_rate")).withColumn("leaked", F.col("decoy_rate") >= F.col("truth_rate") + margin)


def constant_confidence(judgments: DataFrame, least: int = 10) -> DataFrame:
    g = judgments.groupBy("task", "promptbook_version").agg(F.count("confidence").alias("n"), F.countDistinct("confidence").alias("distinct_n"))
    return g.withColumn("constant", (F.col("n") >= least) & (F.col("distinct_n") == 1))


def checker_summary(parsed: DataFrame) -> DataFrame:
    """Replies, failures and fences per task and failure."""
    g = parsed.groupBy("task", F.coalesce("failure", F.lit("none")).alias("failure"))
    return g.agg(F.count("*").alias("n"), count_if(F.col("fenced")).alias("fenced_n"), joined_set(F.col("decision")).alias("decisions"))
