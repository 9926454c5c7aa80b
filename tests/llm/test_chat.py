import json
import random

from pyspark.sql import functions as F

from dossier.llm.chat import canonical_turns, format_chats, read_turns

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "assistant"}], "id": 5, "meta": {"x": [1], "y": {"z": 1}}}, "messages.role", [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "system": "be kind"}, "system+conversations.from", [("system", "be kind"), ("user", "q"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c"}, "prompt+completion", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o", "tags": ["t"]}, "instruction+input+output", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction+input+output", [("user", "i"), ("assistant", "o")]),
    ({"role": "user", "text": None}, "turn", [("user", "")]),
    ({"messages": [{"role": "user", "content": "a", "m": {"a": {"b": {"c": {"d": {"e": [{"f": {"g": 1}}]}}}}}}], "z": {"a": [[[{"b": {"c": {"d": {"e": {"f": 1}}}}}]]]}}, "messages.role", [("user", "a")]),
    ({"other": 1}, None, []), ("bad{", None, []), (None, None, []), ([1, 2], None, []),
]


def test_layouts(spark):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)]
    df = spark.createDataFrame(rows, "conv_id long, r string")
    turns = canonical_turns(df, F.try_parse_json("r"))
    assert {(r.conv_id, r.layout) for r in turns.collect()} == {(i, x[1]) for i, x in enumerate(RECORDS)}
    got = {r.conv_id: r for r in format_chats(turns).withColumn("turns", read_turns(F.col("formatted"))).collect()}
    assert {i: [tuple(t) for t in r.turns] for i, r in got.items()} == {i: x[2] for i, x in enumerate(RECORDS)}
    assert {i: r.unknown_records for i, r in got.items()} == {i: int(x[1] is None) for i, x in enumerate(RECORDS)}


def test_round_trip_and_mask(spark):
    rng = random.Random(2)
    bits = ["\\", "###", "</turn>", "#", "<", ":\n", "\n", "### assistant:\n", "\n</turn>\n", "é", "日", "b", "l/turn>", "h##", "\\b", "\\l", "c", " ", ""]
    want = {}
    for c in range(150):
        want[c] = [(rng.choice(["user", "assistant", "system", "a:b", "###", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(1, 6))]
    rows = [(c, i, r, t, "x") for c, v in want.items() for i, (r, t) in enumerate(v)]
    rows += [(None, 0, "user", None, "x"), (None, 0, "user", None, "x"), (900, None, None, "t", "x")]
    want |= {None: [("user", "")] * 2, 900: [("", "t")]}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    back = format_chats(canonical_turns(df, F.to_variant_object(F.struct("role", "text")), "turn"), "turn").withColumn("turns", read_turns(F.col("formatted"))).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in back} == want
    for r in back:
        assert r.loss_turns == [t.role == "assistant" for t in r.turns]
        under = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        plain = [u.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\") for u in under]
        assert plain == [t.text for t in r.turns if t.role == "assistant"]
    assert format_chats(canonical_turns(df.limit(0), F.to_variant_object(F.struct("role", "text")), "turn"), "turn").count() == 0
