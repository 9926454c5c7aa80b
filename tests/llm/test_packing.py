import itertools
import random
import zlib

import numpy as np
import pytest

from dossier.llm.packing import best_fit_packing, bin_completion, fillings, lower_bound

P = pytest.importorskip("public_tokenizers")


def fewest(items, capacity):
    """Exact by trying every item in every open bin."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_as_few_as_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        cap = rng.choice([10, 23, 60])
        items = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 10))]
        counts = np.bincount(items, minlength=cap + 1) if items else np.zeros(cap + 1, int)
        plan = bin_completion(counts, cap)
        flat = [s for f, n in plan for s, k in f for _ in range(k * n)]
        assert sorted(flat) == sorted(items)
        assert all(sum(s * k for s, k in f) <= cap for f, _ in plan)
        n = sum(n for _, n in plan)
        assert lower_bound(counts, cap) <= n == fewest(items, cap)


def test_many_pieces_meet_the_bound():
    rng = np.random.default_rng(2)
    sizes = np.concatenate([np.minimum(4096, rng.lognormal(6, 1.2, 40_000).astype(int) + 1), np.full(9000, 2100), np.full(2000, 4096)])
    counts = np.bincount(sizes, minlength=4097)
    plan = bin_completion(counts, 4096, 3000)
    assert sum(n for _, n in plan) <= lower_bound(counts, 4096) * 1.001 + 1
    assert fillings(5, np.array([0, 1, 0, 0, 1, 1]), 0) == [((5, 1),)]


def test_pieces(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "the quick brown fox " * 40), (4, "the quick brown fox " * 40), (None, "x"), (6, "hello")]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2L as length"), path, capacity=50).collect()
    want = []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want += [(d, i, s, len(y := ids[s : s + 50]), zlib.crc32(np.array(y, "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 50))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == list(itertools.accumulate([0] + [n for _, n in v]))[:-1] and sum(n for _, n in v) <= 50
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
