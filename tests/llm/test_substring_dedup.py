import random
import re

from dossier.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, **more).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows)
    for r in got:
        assert sum(s.length for s in r.removed) == r.n_removed


def test_random_texts(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(900)]
    rows = []
    for d in range(80):
        w = []
        for _ in range(rng.randrange(0, 6)):
            if rng.random() < 0.6:
                i = rng.randrange(len(base) - 40)
                w += base[i : i + rng.randrange(5, 40)]
            else:
                w += [f"é{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))]
        rows.append((d * 3 % 83, rng.choice([" ", "\n", "  ", "\t"]).join(w)))
    check(spark, rows, chunk_bytes=2000)
    check(spark, rows)


def test_edges(spark):
    w = [f"w{i}" for i in range(30)]
    t = " ".join(w)
    check(spark, [(1, t), (2, t), (3, None), (4, ""), (5, " \n "), (None, t), (2, t), (6, " ".join(w[:12])), (7, "x " + " ".join(w[3:16]) + " y"), (8, "a " * 50), (9, "a " * 60)])
    check(spark, [])
    assert substring_dedup(spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, chunk int, body string")).count() == 1
