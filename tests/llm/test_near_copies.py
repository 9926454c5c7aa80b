import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("public_tokenizers")


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def kept(rows):
    """Smallest doc_id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    s, comp = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (s[i] == s[j] or len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8) and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return {min(d for (d, _), c in zip(rows, comp) if c == k) for k in set(comp)}


def test_overlaps():
    import numpy as np

    from dossier.llm.near_copies import overlaps

    rng = np.random.default_rng(3)
    for top, n in ((40, 9), (5_000, 60), (12_000, 40)):
        keys = [np.unique(np.concatenate([rng.integers(0, top, rng.integers(0, 400)), np.arange(3_000 if top == 12_000 else 0)])).astype(np.uint64) for _ in range(n)]
        left, right = np.arange(0, n, 2), np.arange(1, n, 3)
        want = [[len(np.intersect1d(keys[i], keys[j])) for j in right] for i in left]
        assert (overlaps(keys, left, right) == np.array(want)).all()
        assert (np.diag(overlaps(keys, np.arange(n), np.arange(n))) == [len(k) for k in keys]).all()


@pytest.mark.parametrize("block", [2_048, 6])
def test_stage_drops_every_near_copy(spark, monkeypatch, block):
    import corpus_pipeline
    from dossier.llm import exchange, near_copies

    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(exchange, "SENT", 2_000_000 if block > 6 else 0)

    rng = random.Random(5)
    text = lambda n: [f"W{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(60):  # near copies on both sides of 0.8
        w = text(rng.randrange(60, 200))
        rows.append((k, " ".join(w)))
        for c in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(rng.randrange(1, 6)):
                v[rng.randrange(len(v))] = "new"
            rows.append((100 + 10 * k + c, "  ".join(v).lower()))
    chain = text(120)
    for k in range(30):  # each links to its neighbours only
        rows.append((1000 + k, " ".join(chain[k * 2 :] + chain[: k * 2])))
    star = text(100)
    for k in range(40):  # a family around a text that isn't there: some pairs are just similar enough
        v = list(star)
        for _ in range(rng.randrange(1, 4)):
            v[rng.randrange(100)] = f"V{rng.randrange(9)}"
        rows.append((4000 + k, " ".join(v)))
    line = text(30)
    rows += [(2000 + k, " ".join(line + text(40))) for k in range(20)]  # a common line links nothing
    rows += [(3000, None), (3001, " "), (3002, "a b"), (3003, "A b"), (3004, "a b c"), (3005, ""), (3006, "a b")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _set int, _bands string")
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(kept(rows))
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_simhash_search_is_a_step_of_the_stage(spark, monkeypatch):
    """Every two texts within 3 bits are joined by the pigeonhole search's pairs, and the stage links by them."""
    import corpus_pipeline
    from test_simhash import brute as brute_groups

    from dossier.llm import near_copies

    rng = random.Random(7)
    rows = []
    for k in range(20):
        w = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows.append((k, " ".join(w)))
        for c in range(2):
            v = list(w)
            v[rng.randrange(400)] = "new"
            rows.append((100 + 10 * k + c, " ".join(v)))
    rows += [(500, None), (501, ""), (502, "One two"), (503, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_copies._signed(docs, 5)
    roots = {r.node: r.root for r in near_copies.components(near_copies.simhash_pairs(signed, 3)).collect()}
    of = {r.doc_id: roots.get(r._set, r._set) for r in signed.select("doc_id", "_set").collect()}
    groups = {d: c for d, _, c in brute_groups(rows)}
    assert len(set(groups.values())) < 40 and all((of[a] == of[b]) == (groups[a] == groups[b]) for a in of for b in of)

    asked, search = [], near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda signed, distance: asked.append(distance) or search(signed, distance))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(kept(rows)) and asked == [3]
