import random

import pytest

from dossier.llm import components as cc


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(cc, "IN_ONE", most)
    rng = random.Random(4)
    edges = [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2**62, -(2**62))]
    want = {}
    for a, b in edges:
        if a != b:
            x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
            if x is not y:
                x |= y
                for n in y:
                    want[n] = x
    got = cc.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert len(got) == len(want) and {r.node for r in got} == set(want)
    roots = {r.node: r.root for r in got}
    for r in got:
        assert r.root in want[r.node] and all(roots[n] == r.root for n in want[r.node])
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
