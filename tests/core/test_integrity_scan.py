"""All eight flags against their rules written in Python, on planted defects and on the registered query."""

import math
import re
from statistics import median

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.plans.queries import REGISTRY

DIR = "/root/testdata/sf0.001"


def brute(text, pages, abstract, middle):
    t, out = (text or "").strip(), []
    solid = [c for c in t if not c.isspace()]
    refs = re.search(r"^\s*(references|bibliography|literature cited)\b", t, re.I | re.M)
    lines = [x.strip() for x in t.splitlines() if len(x.strip()) > 15]
    checks = [
        ("F1_MOJIBAKE", re.search("�|Ã¢â‚¬|Ã©|Ã¨|â€œ|â€\x9d|Ã\xad", t)), ("F2_MULTI_ARTICLE", refs and re.compile(r"^\s*abstract\b", re.I | re.M).search(t, refs.end())),
        ("F3_NO_REFERENCES", t and not re.search(r"\breferences\b|\bbibliography\b|doi:\s*10\.", t, re.I)), ("F4_THIN_PER_PAGE", pages and middle and len(t) / pages < 0.4 * middle),
        ("F5_SHORT_VS_ABSTRACT", abstract and len(t) < 3 * len(abstract)), ("F6_LOW_ALPHA", solid and sum(c.isalpha() for c in solid) / len(solid) < 0.6),
        ("F7_REPETITIVE", len(lines) > 50 and (len(lines) - len(set(lines))) / len(lines) > 0.3),
        ("F8_SUBMISSION_FORM", re.search(r"CONSORT-EHEALTH|Submission\s*/?\s*Publication Form|\bSubmission Form\b|\bPublication Form\b", t[:600], re.I)),
    ]
    return [name for name, found in checks if found]


def test_planted_defects(spark):
    body = "A text of plain words that goes on. " * 30 + "\n"
    texts = [
        body + "References\n1. a", body + "doing well", body + "DOI:  10.1", body + "preferences", body + "references �", body + "references Ã© â€œ",
        body + "References\n1.\n  Abstract\n" + body, "Abstract\n" + body + "References\nto abstract data", body + "References abstract\n", body + "Bibliography\r\nx\rabstract\r", body + "Literature Cited\n\n ABSTRACT (continued)",
        "Submission / Publication Form\nreferences " + body, body + "Submission Form references", "x" * 590 + " CONSORT-EHEALTH references", " " * 700 + "consort-ehealth references",
        "1234 5678 !! references", "", None, "  \x1c", "a repeated line of text " * 60 + "references", "a repeated line of text\x1e" * 50, "  a repeated line of text \x85" * 51,
    ]
    rows = [(i * 3 + k, t, p, a) for i, t in enumerate(texts) for k, (p, a) in enumerate([(1.0, None), (5.0, ""), (0.0, "ab " * 130)])]
    df = spark.createDataFrame(rows, "i int, t string, p double, a string").select("i", tx.integrity_scan(F.col("t"), F.col("p"), F.col("a"), F.lit(800.0)).alias("f")).orderBy("i")
    want = [brute(t, p, a, 800.0) for _, t, p, a in rows]
    assert [r.f for r in df.collect()] == want
    assert len({f for x in want for f in x}) == 8


def test_query(spark):
    rows = []
    for r in pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        d, t = r["doc_id"], r["text"]
        x = {1: t + "\nReferences\n1. One 2001.\n Abstract\nmore", 2: "Submission Form\n" + t, 3: t + "� doi: 10.1", 4: t + " doing"}.get(d % 8, t)
        rows.append((d, x, math.ceil(len(x) / 3000), t if d % 5 == 0 else t[:100]))
    middle = median(len(x) / p for _, x, p, _ in rows if p)
    got = {r.doc_id: r.flags for r in REGISTRY["text_integrity_flags"](spark, DIR).collect()}
    assert got == {d: ";".join(brute(x, p, a, middle)) for d, x, p, a in rows}
