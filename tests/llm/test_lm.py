import math
import random
import re
import zlib
from collections import Counter

import pytest

from dossier.llm.lm import lm_score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\0end"]


class Model:
    def __init__(self, texts, order, mu):
        self.c = [Counter() for _ in range(order)]
        for t in texts:
            w = ["\0start", *tokens(t)]
            for i in range(len(w)):
                for k in range(min(order, i + 1)):
                    self.c[k][tuple(w[i - k : i + 1])] += 1
        self.order, self.mu = order, mu
        words = {k: v for k, v in self.c[0].items() if k != ("\0start",)}
        self.n, self.v = sum(words.values()), len(words)

    def p(self, h, w):
        out = (self.c[0][w,] + 1) / (self.n + self.v + 1)
        for k in range(1, min(self.order, len(h) + 1)):
            c = self.c[k - 1][tuple(h[-k:])]
            if c:
                out = (self.c[k][(*h[-k:], w)] + self.mu * out) / (c + self.mu)
        return out

    def score(self, t):
        w = ["\0start", *tokens(t)]
        return sum(math.log10(self.p(w[:i], w[i])) for i in range(1, len(w)))


def texts(n, seed):
    rng = random.Random(seed)
    return [rng.choice([" ", "\n"]).join(rng.choice(["A", "b", "É", "cd"]) + str(int(rng.random() ** 3 * 20)) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    rows = [(i, t) for i, t in enumerate(texts(120, 3))] + [(500, None), (501, ""), (3, "b1 b2"), (3, "b1 b2")]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train = [t for d, t in rows if not held(d)]
    models = [Model(train, order, mu) for mu in (2.0, 50.0)]
    vocab = [k[0] for k in models[0].c[0] if k != ("\0start",)]
    for h in (["\0start"], ["\0start", "b1", "a0"], ["never", "seen"]):
        for m in models:
            assert math.isclose(sum(m.p(h, w) for w in vocab) + m.p(h, "\0none"), 1, rel_tol=1e-9)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, chunk int")
    got = sorted(lm_score(df, order=order, strengths=(2.0, 50.0), chunk_bytes=1500).collect(), key=lambda r: (r.doc_id, r.score))
    want = []
    for d, t in rows:
        c = [models[0].c[0][w,] for w in tokens(t)]
        base = sum(math.log10((x + 1) / (models[0].n + models[0].v + 1)) for x in c)
        want.append((d, held(d), len(c), sum(x > 0 for x in c), models[0].n, base, math.log10(sum(10 ** m.score(t) for m in models) / 2)))
    want.sort(key=lambda r: (r[0], r[6]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9) and math.isclose(g.score, w[6], rel_tol=1e-9)


def test_edges(spark):
    assert lm_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = lm_score(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert (r.doc_id, r.n_tokens, r.held_out) == (None, 1, False)
