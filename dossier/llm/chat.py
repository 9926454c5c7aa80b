"""Chat formatting by schema fingerprints, with built-in functions only.

A record's nested field paths are read from the schema of its variant value, without types and without fields that no
mapping knows, and hashed.  The hash selects one of the declared mappings, which turns the record's layout
(messages, prompt and answer, instruction, one turn per row ..) into canonical turns (role, text).  Turns are put
together as

    ### role:
    text
    </turn>

where a backslash, ``###`` and ``</turn>`` inside a text are written as ``\\b``, ``\\h##`` and ``\\l/turn>`` (in a role
also a colon as ``\\c``), so no text can forge a mark and every text can be read back.

Defined results: a null text or role is an empty one; a record of an unknown layout, or that is no JSON, has no turns
(its conversation is there, with what other records give); rows with equal turn number stand by role, then text;
repeated rows are repeated turns; a null conversation id is a conversation of its own; a conversation must fit into one
row, as its digest runs over all of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Declared mappings: name, shapes of field paths (fields by name, as schema_of_variant writes them), SQL for the turns of ``v``.
TURNS = "array<struct<role:string,text:string>>"
_LISTS = [(name, role, text) for name in ("messages", "conversations", "conversation", "turns") for role, text in (("role", "content"), ("from", "value"), ("role", "text"), ("speaker", "text"))]
_PAIRS = [("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("instruction", "output"), ("instruction", "response")]


def _object(*fields: str) -> str:
    return f"OBJECT<{','.join(sorted(fields))}>"


def _text(path: str) -> str:
    return f"coalesce(try_variant_get(v, '$.{path}', 'string'), '')"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


def _mappings() -> list[tuple[str, list[str], str]]:
    out = [("turn", [_object("role", "text")], f"array({_turn(_text('role'), _text('text'))})"), ("turn", [_object("role", "content")], f"array({_turn(_text('role'), _text('content'))})")]
    system = f"if(try_variant_get(v, '$.system', 'string') is null, array(), array({_turn("'system'", _text('system'))}))"
    for name, role, text in _LISTS:
        inner = _object(role, text)
        got = f"coalesce(try_variant_get(v, '$.{name}', 'array<struct<{role}:string,{text}:string>>'), array())"
        turns = f"transform({got}, x -> {_turn(f'x.{role}', f'x.{text}')})"
        out.append((f"{name}.{role}", [_object(f"{name}:ARRAY<{inner}>")], turns))
        out.append((f"system+{name}.{role}", [_object(f"{name}:ARRAY<{inner}>", "system")], f"concat({system}, {turns})"))
    for ask, reply in _PAIRS:
        pair = f"{_turn("'user'", _text(ask))}, {_turn("'assistant'", _text(reply))}"
        more = f"concat_ws('\\n\\n', {_text(ask)}, nullif({_text('input')}, ''))"
        out.append((f"{ask}+{reply}", [_object(ask, reply)], f"array({pair})"))
        out.append((f"system+{ask}+{reply}", [_object(ask, reply, "system")], f"concat({system}, array({pair}))"))
        out.append((f"{ask}+input+{reply}", [_object(ask, "input", reply)], f"array({_turn("'user'", more)}, {_turn("'assistant'", _text(reply))})"))
    return out


MAPPINGS = _mappings()
NAMES = sorted({n for _, shapes, _ in MAPPINGS for s in shapes for n in s.replace("OBJECT<", " ").replace("ARRAY<", " ").replace(">", " ").replace(":", " ").replace(",", " ").split()})
# Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


def shape(v: Column) -> Column:
    """Nested field paths of a variant value, known fields only, in one string."""
    known = "|".join(NAMES)
    s = F.regexp_replace(F.regexp_replace(F.schema_of_variant(v), r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]*\))?", ""), r"([:,]) ", "$1")

    def without_unknown(t: Column) -> Column:
        """One level of fields that no mapping knows: plain ones, and objects or lists that hold no other."""
        t = F.regexp_replace(t, rf"(?<=[<,])(?!(?:{known})[,>:])[^<>,:]+(?::(?:ARRAY|OBJECT)<[^<>]*>)?(?=[,>])", "")
        t = F.regexp_replace(F.regexp_replace(t, r",+(?=[,>])", ""), r"<,+", "<")
        return F.regexp_replace(t, r"(?<=<)(?:ARRAY|OBJECT)<[A-Z_]*(?:\([0-9, ]*\))?>(?=>)", "")  # what a list holds, if nothing known is in it

    levels = F.length(s) - F.length(F.replace(s, F.lit("<"), F.lit("")))  # no field lies deeper than there are brackets
    return F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), s, lambda t, _: without_unknown(t))


def fingerprint(v: Column) -> Column:
    return F.xxhash64(shape(v))


def canonical_turns(records: DataFrame, record: Column, *order: str) -> DataFrame:
    """``conv_id``, the ``order`` columns, layout, nth, role and text: one row per turn (or one with nulls if there is none).

    ``record`` is a variant; JSON text goes through try_parse_json first.
    """
    rows = records.select("conv_id", *order, record.alias("v")).withColumn("_print", fingerprint(F.col("v")))
    pick, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, shapes, sql in MAPPINGS:
        hit = reduce(Column.__or__, [F.col("_print") == F.xxhash64(F.lit(s)) for s in shapes])
        pick, turns = F.when(hit, F.lit(name)).otherwise(pick), F.when(hit, F.expr(sql).cast(TURNS)).otherwise(turns)
    found = rows.select("conv_id", *order, pick.alias("layout"), F.posexplode_outer(turns).alias("nth", "_said"))
    role = F.coalesce("_said.role", F.lit(""))
    for old, new in ROLES.items():
        role = F.when(F.col("_said.role") == old, F.lit(new)).otherwise(role)
    there = F.col("_said").isNotNull()
    return found.select("conv_id", *order, "layout", "nth", F.when(there, role).alias("role"), F.when(there, F.coalesce("_said.text", F.lit(""))).alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("###"), F.lit("\\h##")), F.lit("</turn>"), F.lit("\\l/turn>"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, *order: str) -> DataFrame:
    """One row per conversation: formatted, loss_turns (is the turn an assistant's), loss_spans (where in formatted such texts are) and unknown_records.

    A record of a layout that no mapping knows adds no turn; unknown_records counts them.
    """
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(":\n"))
    by = [f"_by{i}" for i in range(len(order))]
    unknown = F.col("layout").isNull() if "layout" in turns.columns else F.lit(False)
    plain = turns.select("conv_id", *(F.col(c).alias(b) for c, b in zip(order, by)), "nth", "role", "text", unknown.alias("_unknown"))
    piece = plain.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit("\n</turn>\n")))
    place = Window.partitionBy("conv_id").orderBy(*by, "nth", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(place), F.lit(0)) + F.length("head"))
    there = F.when(F.col("piece").isNotNull(), F.struct(F.col("start").alias("at"), "piece", (F.col("role") == "assistant").alias("loss"), F.length("body").alias("size")))
    parts = F.sort_array(F.collect_list(there))
    joined = piece.groupBy("conv_id").agg(parts.alias("parts"), F.count_if("_unknown").alias("unknown_records"))
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["at"].alias("start"), p["size"].alias("length")))
    return joined.select("conv_id", F.array_join("parts.piece", "").alias("formatted"), F.col("parts.loss").alias("loss_turns"), spans.alias("loss_spans"), "unknown_records")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds: array of role and text."""
    parts = F.filter(F.split(formatted, "\n</turn>\n"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(F.substring_index(p, ":\n", 1), 5, 1 << 30)).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, ":\n", 1)) + 3)).alias("text")))
