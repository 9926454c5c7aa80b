import random
import re
from collections import Counter

import pyarrow as pa

from dossier.llm.quality import base_counts, quality_filter, quality_rules
from dossier.llm.text import Block

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def texts():
    rng = random.Random(4)
    out = [None, "", "\n", "\n\n a\n a\na\n a", "a a a a", "é\r\né\r\n\né", "x", "x y z x y z", "|<>#"]
    return out + ["".join(rng.choice(["ab", "é ", " ", "\n", "cd\n", "# ", "ab cd ef ", "日", "\t", "ab cd ef\n"]) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_counts_equal_brute_force():
    t = texts()
    for part in (t, t[5:50], [None], [""], []):
        c = base_counts(Block(pa.array(part, pa.string())))
        got = list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))))
        assert got == [brute(x) for x in part]


def test_verdicts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randrange(1, 4)))
    good = [(i, " ".join(word() for _ in range(120)), 1) for i in range(120)]
    bad = [(200 + i, " ".join(word() + rng.choice(["%%%", "&&&"]) for _ in range(120)), 0) for i in range(40)]
    docs = spark.createDataFrame([(d, t, 7) for d, t, _ in good + bad] + [(None, "x", 7), (999, None, 7)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in good + bad if d % 2] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect()}
    assert len(got) == 162 and not got[None] and not got[999]
    fine = [d for d, t, _ in good if not brute(t)[5]]
    assert sum(got[d] for d in fine) >= len(fine) - 2 and not any(got[d] for d, _, _ in bad)
    left = quality_filter(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, k in got.items() if k}
    assert sum(r.kept for r in quality_rules(docs, None).collect()) == 160 - sum(brute(t)[5] for _, t, _ in good + bad)
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_every_label_counts(spark):
    """Labels of ids that no document has push none out, however many there are."""
    rng = random.Random(3)
    text = lambda ends: " ".join("".join(rng.choice(["th", "er", "on", "an"]) for _ in range(3)) + rng.choice(ends) for _ in range(80))
    rows = [(d, text(["", "", "s"] if d % 3 else ["s", "%"]), int(d % 3 > 0)) for d in range(120)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").cache()
    own = spark.createDataFrame([(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int")
    many = own.unionByName(spark.range(1_000, 61_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic"))
    few, all_ = ({r.doc_id: (r.score, r.threshold, r.kept) for r in quality_rules(docs, x).collect()} for x in (own, many))
    assert few == all_ and len({t for _, t, _ in few.values()}) == 1 and {k for _, _, k in few.values()} == {True, False}


def test_ranks_without_order(spark, monkeypatch):
    from dossier.llm import quality

    rng = random.Random(8)
    monkeypatch.setattr(quality, "RANGES", 8)
    for values in ([1.5], [rng.gauss(0, 1) for _ in range(200)] + [1e9, -1e9], [0.25] * 50 + [0.5] * 49 + [0.1]):
        frame = spark.createDataFrame([(v,) for v in values], "s double").cache()
        for rank in {0, (len(values) - 1) // 2, len(values) - 1}:
            assert quality.ranked(frame, rank) == sorted(values)[rank]
