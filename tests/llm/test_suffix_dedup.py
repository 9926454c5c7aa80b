import random
from collections import Counter

from dossier.llm import suffix_dedup
from dossier.llm.suffix_dedup import blind_trie, deep_shallow, reaches, suffix_array_dedup, suffix_array_filter


def brute(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((d, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def test_sorting():
    rng = random.Random(2)
    for _ in range(300):
        t = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 40))]
        t += rng.choices(t, k=5)
        for shallow in (0, 3, 48):
            assert [t[i] for i in deep_shallow(t, 0, shallow)] == sorted(t)
        assert [t[i] for i in blind_trie(list(range(len(t))), t, 0)] == sorted(t)


def test_reaches():
    rng = random.Random(6)
    for _ in range(300):
        m, n = rng.randrange(2, 14), 10
        ctx = list({(bytes(rng.choice(b"ab") for _ in range(6)), b"x" + bytes(rng.choice(b"ab") for _ in range(7))) for _ in range(m)})
        if len(ctx) < 2:
            continue
        pre = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = []
        for i, (l, r) in enumerate(ctx):
            hit = [(pre(l, a), pre(r, b)) for j, (a, b) in enumerate(ctx) if j != i]
            hit = [h for h in hit if sum(h) >= n]
            want.append((max((h[0] for h in hit), default=0), max((h[1] for h in hit), default=0)))
        assert reaches([c[0] for c in ctx], [c[1] for c in ctx], (n,), 1) == want
        assert [x[:2] for x in reaches([c[0] for c in ctx], [c[1] for c in ctx], (n, n - 3), 1)] == want
        assert [x[2:] for x in reaches([c[0] for c in ctx], [c[1] for c in ctx], (n + 2, n), 1)] == want


def test_documents(spark, monkeypatch):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdé ") for _ in range(1500))
    rows = []
    for d in range(60):
        t = ""
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(base) - 90)
            t += base[i : i + rng.randrange(3, 90)] if rng.random() < 0.7 else "".join(rng.choice("xyz日") for _ in range(rng.randrange(1, 30)))
        rows.append((d, t))
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 200 + "b"), (None, base), (104, base), (104, base), (105, "ab" * 90), (106, base[:23]), (107, base[:24])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    got = suffix_array_dedup(df, length=24, gram=8).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == brute(rows, 24)
    for many in (1_000, 3):
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        got = suffix_array_dedup(df, length=48, passage=24, gram=8).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == brute(rows, 48)
        assert sorted(((r.doc_id, r.n_bytes, r.n_repeated) for r in got), key=str) == sorted((x[:3] for x in brute(rows, 24)), key=str)
    for r in suffix_array_dedup(df, length=24, gram=8, whole_characters=True).collect():
        assert r.kept_text.encode() == bytes(r.kept) and len(r.kept) == r.n_bytes - r.n_removed
    left = suffix_array_filter(df.withColumnRenamed("row", "n_bytes"), length=24, gram=8)
    assert left.columns == ["doc_id", "text", "n_bytes"] and left.where("n_bytes = 1").count() == len(rows)
    assert suffix_array_dedup(df.limit(0)).count() == 0
