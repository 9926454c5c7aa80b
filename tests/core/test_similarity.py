"""Titles against whole heads, also when words are broken."""

import random

from dossier.functions.similarity import fold, partial, subsequence, title_ratio, token_set
from dossier.operators.identity import decide

TITLE = "Sample size planning in cluster randomised trials of community health programmes"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = row[:]
        for j, y in enumerate(b):
            row[j + 1] = left[j] + 1 if x == y else max(left[j + 1], row[j])
    return row[-1]


def brute(a, b):
    best = 0.0
    for x, y in [(a, b)] * (len(a) <= len(b)) + [(b, a)] * (len(b) <= len(a)):
        for s in range(1 - len(x), len(y)):
            w = y[max(s, 0) : s + len(x)]
            best = max(best, 200.0 * common(x, w) / (len(x) + len(w)) if x else 0.0)
    return best


def test_best_window():
    rng = random.Random(2)
    for _ in range(150):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 5, 20, 63, 64, 65, 70]))) for _ in range(2))
        assert abs(partial(a, b) - brute(a, b)) < 1e-9
    long = "".join(rng.choice("abcdefgh") for _ in range(150))
    assert partial(long, "x" * 50 + long[:70] + "y" + long[70:] + "z" * 40) > 98 and abs(partial(long, long[::-1]) - brute(long, long[::-1])) < 1e-9


def test_ratio_counts_insertions_and_deletions():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 70))) for _ in range(2))
        assert subsequence(a, b) == common(a, b)
    assert abs(token_set("fuzzy fuzzy was a bear", "fuzzy wuzzy was a bear") - 100.0) < 1e-9 and abs(token_set("new york mets", "new york yankees") - 200 * 8 / (8 + 12)) < 10
    x, y = "a b extra", "a b other words"
    both, one, two = "a b", "a b extra", "a b other words"
    best = max(200 * common(p, q) / (len(p) + len(q)) for p, q in ((both, one), (both, two), (one, two)))
    assert abs(token_set(x, y) - best) < 1e-9


def test_identity_reads_the_whole_head(spark):
    banner, rest = "Journal of Plain Matters 12 (2001) 1-10. " * 5, " by Jane Doe1,2* and others. " + "Some words about nothing in particular. " * 10
    split = TITLE.replace("planning", "plan\nning").replace("randomised", "rando mised").replace("community", "com munity").replace("programmes", "pro\ngrammes").replace("cluster", "clus ter").replace("Sample", "Sam ple")
    heads = {"late": banner + TITLE + rest, "split": banner + split + rest, "other": banner + "A different study" + rest, "anon": banner + TITLE + rest.replace("Doe", "Roe"), "admin": "Summary Statement " + banner + TITLE + rest, "doi": banner + "doi: 10.1000/A\nBC" + rest.replace("Doe", "Roe"), "thin": TITLE, "none": banner + rest.replace("Doe", "Deer")}
    rows = spark.createDataFrame([(k, h, "10.1000/abc", TITLE, ["Doe", "Zo\u00eb"], "2001", "Plain matters") for k, h in heads.items()], "paper_id string, head string, doi string, title string, surnames array<string>, year string, journal string")
    got = {r.paper_id: r for r in decide(rows).collect()}
    assert {k: (r.verdict, r.verdict_reason) for k, r in got.items()} == {
        "late": ("VERIFIED", "TITLE_AUTHOR_MATCH"), "split": ("VERIFIED", "TITLE_AUTHOR_MATCH"), "other": ("WEAK", "AUTHORS_ONLY"), "anon": ("WEAK", "TITLE_NEAR_MATCH"), "admin": ("MISMATCH", "ADMIN_DOCUMENT"), "doi": ("VERIFIED", "DOI_MATCH"), "thin": ("PDF_UNREADABLE", "NO_TEXT"), "none": ("MISMATCH", "NO_MATCH"),
    }
    late = got["late"]
    assert (late.author_count, late.author_hits, late.author_frac, late.year_hit, late.journal_hit, late.other_dois) == (2, 1, 0.5, True, True, [])
    text = fold(heads["late"])
    assert late.title_pos == round(text.find(fold(TITLE)[:45]) / len(text), 3) and got["none"].title_pos == -1.0


def test_registered_ladder_against_its_rules(spark):
    """Verdicts of the registered query follow from its own signals, and scores from the texts."""
    import pyarrow.parquet as pq

    from dossier.plans.queries import REGISTRY

    path = "/root/testdata/sf0.001"
    texts = {str(r["doc_id"]): r["text"] or "" for r in pq.read_table(f"{path}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    for r in REGISTRY["identity_ladder"](spark, path).collect():
        d, text = int(r.paper_id), texts[r.paper_id]
        import hashlib

        head = ("doi 10.1000/" + hashlib.md5(text.encode()).hexdigest() + " " if d % 4 == 0 else "Summary Statement " if d % 9 == 1 else "") + text[:900]
        assert r.head_chars == len(head) and abs(r.title_score - title_ratio(fold(text[:60]), fold(head))) <= 0.051
        rule = ("PDF_UNREADABLE" if r.head_chars < 200 else "MISMATCH" if r.admin_doc else "VERIFIED" if r.doi_hit or r.title_score >= 95 and r.first_author_hit else "WEAK" if r.title_score >= 85 or r.first_author_hit and r.author_frac >= 0.5 else "MISMATCH")
        assert r.verdict == rule
