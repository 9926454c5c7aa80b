import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from dossier.llm import simhash
from dossier.llm.components import forest
from dossier.llm.simhash import bit_groups, fingerprints, flips, simhash_filter, simhash_near_dedup, thresholds

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=3):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {c: min((d for (d, _), k in zip(rows, comp) if k == c and d is not None), default=None) for c in set(comp)}
    return sorted([(d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp)], key=str)


def texts(n, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["A", "be", "É", "çd", "x"]) + str(rng.randrange(300)) for _ in range(rng.randrange(1, 120))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(9))
        out.append("\n".join(w))
    return out


def test_fingerprints():
    t = [None, "", "a", "A b", "a  b\nc", "a b c d", " \t"] + texts(200, 3)
    assert fingerprints(pa.array(t)).tolist() == [brute_fp(x) for x in t]
    assert fingerprints(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("block", [4096, 3])
def test_components(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = [(i * 7 % 401, t) for i, t in enumerate(texts(300, 8))] + [(900, None), (901, " "), (None, "a b"), (902, "a b"), (902, "a b")]
    got = simhash_near_dedup(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _fp int, _id int")
    left = simhash_filter(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute(rows)})
    assert [r.doc_id for r in simhash_filter(df.where("doc_id is null")).collect()] == [None]
    assert simhash_near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_misses_no_pair():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    bits = ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    m = bits.T @ bits
    for n in (3000, 10**7):
        for parts in (1, 2, 3, 4):
            g = bit_groups(m * n / 3000, n, parts)
            assert sorted(np.concatenate(g).tolist()) == list(range(64))
            _, t = thresholds(m * n / 3000, n, g, 3)
            assert sum(x + 1 for x in t) == 4
            for _ in range(300):
                diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
                assert any((diff & sum(1 << int(b) for b in bits_)).bit_count() <= x for bits_, x in zip(g, t))
    assert len(flips(np.arange(10), 2)) == 1 + 10 + 45


def test_forest():
    a, b = forest(np.array([5, 4, 9, 2], np.uint64), np.array([4, 3, 8, 9], np.uint64))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 3, 4: 3, 9: 2, 8: 2}
