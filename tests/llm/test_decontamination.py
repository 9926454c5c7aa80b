import random
import re

from dossier.llm.decontamination import _begin, decontaminate, edit_search, find_leaks


def brute_search(item, text):
    """Least edits of the item to any run, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def full(a, b):
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        new = [i]
        for j, x in enumerate(b, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_edit_search():
    rng = random.Random(1)
    for _ in range(500):
        item, text = [rng.randrange(4) for _ in range(rng.randrange(1, 12))], [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        edits, end = edit_search(item, text, len(item))
        assert edits == brute_search(item, text)
        assert full(item, text[_begin(item, text, end, edits) : end]) == edits


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(200))
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 60)))) for i in range(40)]
    docs, planted = [], set()
    for d in range(250):
        w = [word() for _ in range(rng.randrange(0, 150))]
        if d % 2:
            i, t = rng.choice(items)
            x = t.upper().split(" ") if d % 3 == 0 else t.split(" ")
            for _ in range(rng.randrange(0, len(x) // 5 + 1)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], [word()], [x[k], word()]])
            k = rng.randrange(len(w) + 1)
            w[k:k] = x
        docs.append((d, rng.choice([" ", "\n"]).join(w)))
    low = lambda t: t.lower().split()
    want = {}
    for d, t in docs:
        for i, x in items:
            e = brute_search(low(x), low(t))
            if e <= len(low(x)) // 5:
                want[d, i] = e
    more = [(900, None), (901, ""), (None, items[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs + more], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items + [(99, None), (98, ""), (None, "x")], "item_id long, text string")
    for how in ({}, {"item_bytes": 1500}):
        got = {(r.doc_id, r.item_id): r for r in find_leaks(df, bench, **how).collect()}
        assert got.pop((None, 0)).edits == 0
        assert set(got) <= set(want)
        assert len(got) >= 0.97 * len(want)
        for k, r in got.items():
            assert r.edits == want[k]
            assert full(low(dict(items)[k[1]]), low(dict(docs)[k[0]])[r.word_start : r.word_end]) == r.edits
    left = {r.doc_id for r in decontaminate(df, bench).collect()}
    assert left == {d for d, _ in docs + more} - {d for d, _ in got} - {None}
    assert find_leaks(df.limit(0), bench).count() == 0 and find_leaks(df, bench.limit(0)).count() == 0


def test_recall_on_the_tables(spark, monkeypatch):
    """Recall against every pair of document and item, whose edits are computed unless too few words are shared."""
    from collections import Counter

    import pyarrow.parquet as pq

    from dossier.llm import decontamination

    path = "/root/testdata/sf0.001"
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = {r["item_id"]: low(r["text"]) for r in pq.read_table(f"{path}/benchmark.parquet").to_pylist()}
    counts, ids = {i: Counter(w) for i, w in items.items()}, {}
    want = {}
    for r in pq.read_table(f"{path}/documents.parquet").to_pylist():
        text = low(r["text"])
        have = Counter(text)
        for i, w in items.items():
            if w and sum(min(n, have[x]) for x, n in counts[i].items()) >= len(w) - len(w) // 5:
                number = lambda x: ids.setdefault(x, len(ids))
                edits, _ = edit_search([number(x) for x in w], [number(x) for x in text], len(w) // 5)
                if edits <= len(w) // 5:
                    want[r["doc_id"], i] = edits
    for portion in (1 << 21, 64):
        monkeypatch.setattr(decontamination, "PORTION", portion)
        got = {(r.doc_id, r.item_id): r.edits for r in find_leaks(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
        assert want and set(got) <= set(want) and all(got[k] == want[k] for k in got)
        assert len(got) >= 0.95 * len(want)
