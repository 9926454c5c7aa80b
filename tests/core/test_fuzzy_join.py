"""Citation keys and citations find their paper by the rules in their order."""

from dossier.functions.similarity import last_name, partial, partial_many, word_score, word_scores
from dossier.operators import labels as lb

TITLE = "Sample size planning in cluster randomised trials of community health programmes"
KEY = "row_id string, surname string, words string, year string"
PAPER = "paper_id string, surname string, year string, title string"


def test_many_windows_equal_single_ones():
    import random

    rng = random.Random(4)
    for _ in range(60):
        text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
        a, titles = text(rng.randrange(0, 80)), [text(rng.choice([0, 3, 30, 64, 90])) for _ in range(6)]
        assert [round(x, 9) for x in partial_many(a, titles)] == [round(partial(a, t), 9) for t in titles]
        assert [round(x, 9) for x in word_scores(a, titles)] == [round(word_score(a, t), 9) for t in titles]


def test_bounds_hold_and_spare_most_titles(monkeypatch):
    import random

    import numpy as np

    from dossier.functions.similarity import Titles

    rng = random.Random(1)
    for _ in range(80):
        letters = rng.choice(["ab ", "abcde   ", "abcdefghij  \u00e9-"])
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))
        titles = [text(rng.choice([0, 1, 3, 10, 30, 40, 60])) for _ in range(30)]
        many = [text(rng.choice([0, 1, 3, 10, 30, 45])) for _ in range(4)] + [titles[3][:20], " ".join(titles[5].split()[::-1])]
        t, every = Titles(titles), np.arange(30)
        bound, by_words = t.bounds(many)
        for k, words in enumerate(many):
            exact = np.array([word_score(words, x) for x in titles])
            assert (bound[:, k] >= exact).all()
            ranked = np.sort(exact)[::-1]
            (place, best), (_, second) = t.best_two(words, bound[:, k], by_words[:, k], every)
            assert best == ranked[0] == exact[place] and (best - second >= 10) == (ranked[0] - ranked[1] >= 10)
            floor = rng.choice([30.0, 60.0, 70.0, 90.0])
            got = t.best_two(words, bound[:, k], by_words[:, k], every, floor)
            assert len(got) == min(2, (exact >= floor).sum()) and (not got or got[0][1] == ranked[0])
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 8))) for _ in range(3_000)]
    t = Titles([" ".join(rng.choices(words, k=12))[:60] for _ in range(4_000)])
    seen, whole = [], t.scores
    monkeypatch.setattr(t, "scores", lambda w, which, by: seen.append(len(which)) or whole(w, which, by))
    asked = [x[:40] for x in t.low[:50]]
    bound, by_words = t.bounds(asked)
    for k, w in enumerate(asked):
        assert t.best_two(w, bound[:, k], by_words[:, k], np.arange(4_000))[0] == (k, 100.0)
    assert sum(seen) < 50 * 4_000 / 50


def test_cite_keys(spark):
    papers = [("p1", "doe", "2001", TITLE), ("p2", "doe", "2002", "Blood pressure in seven towns"), ("p3", "roe", "2001", "Point-of-Care testing of children"), ("p4", "roe", "2001", "Sleep of shift workers"), ("p5", "twin", "1", "Walking to school"), ("p6", "twin", "1", "Walking to school"), ("p7", "institute", "9", "A national study of tobacco use in rural clinics")]
    rows = [
        ("unique", "doe", "nothing alike", "2001"), ("no year", "doe", "blood pressure seven towns", ""), ("tie", "roe", "pointof care testing children", "2001"), ("toss", "twin", "walking school", "1"), ("no title", "roe", "entirely other words", "2001"),
        ("corporate", "icu", "national study of tobacco use in rural clinics", "9"), ("unknown", "nobody", "quantum chromodynamics", "9"), ("no author", "", "walking", "1"),
    ]
    got = {r.row_id: (r.paper_id, r.rule) for r in lb.join_cite_key(spark.createDataFrame(rows, KEY), spark.createDataFrame(papers, PAPER), block=1).collect()}
    assert got == {
        "unique": ("p1", "cite_key_author_year"), "no year": ("p2", "cite_key_title_tiebreak"), "tie": ("p3", "cite_key_title_tiebreak"), "toss": (None, ""), "no title": (None, ""), "corporate": ("p7", "title_only_corporate_author"), "unknown": (None, ""), "no author": (None, ""),
    }


def test_author_year(spark):
    papers = [("p1", "doe", 2001, ["doe", "lee"]), ("p2", "roe", 2001, ["roe", "kim", "lee"]), ("p3", "roe", 2001, ["roe", "lee", "kim"]), ("p4", "roe", 2001, ["roe"])]
    rows = [("a", "doe", 2001, "", []), ("b", "doe", 2001, "a", []), ("c", "roe", 2001, "", ["lee"]), ("d", "roe", 2001, "b", ["lee"]), ("e", "roe", 2001, "", []), ("f", "roe", 2001, "", ["kim", "lee", "x"]), ("g", "nobody", 1, "", [])]
    got = {r.row_id: (r.paper_id, r.rule) for r in lb.join_author_year(spark.createDataFrame(rows, "row_id string, surname string, year int, suffix string, extras array<string>"), spark.createDataFrame(papers, "paper_id string, surname string, year int, authors array<string>")).collect()}
    assert got == {"a": ("p1", "author_year"), "b": ("p1", "author_year_suffix_sole_candidate"), "c": ("p3", "author_position"), "d": (None, "ambiguous"), "e": (None, "ambiguous"), "f": (None, "ambiguous"), "g": (None, "none")}
    assert last_name("van der Berg") == "berg"


def test_registered_query_against_brute_force(spark):
    import re

    import pyarrow.parquet as pq

    from dossier.plans.queries import REGISTRY

    path = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "")[:60] for r in pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = {r.row_id: (r.paper_id, r.rule, r.score) for r in REGISTRY["labels_fuzzy_join"](spark, path).collect()}
    assert len(got) == sum(d % 50 == 0 for d in docs)
    for d in (d for d in docs if d % 50 == 0):
        words, name = re.sub("[^A-Za-z]+", " ", docs[d][:40]).lower(), f"name{d % 499}"
        hits = [p for p in docs if d % 1000 and f"name{p % 499}" == name and (d % 100 == 0 or p % 7 == d % 7)]
        ranked = sorted(((round(word_score(words, docs[p]), 6), str(p)) for p in (hits or docs)), reverse=True)
        best, second = ranked[0][0], ranked[1][0] if len(ranked) > 1 else None
        if len(hits) == 1:
            want = (str(hits[0]), "cite_key_author_year", best)
        elif hits:
            want = (ranked[0][1], "cite_key_title_tiebreak", best) if best >= 70 and best - second >= 10 else (None, "", best)
        else:
            want = (ranked[0][1], "title_only_corporate_author", best) if best >= 90 and second < 70 else (None, "", best if best >= 70 else None)
        assert got[f"r{d}"] == want, d
