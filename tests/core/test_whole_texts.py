"""Text rules read every document to its end."""

import re

import pyarrow.parquet as pq

from dossier.plans.queries import REGISTRY

DIR = "/root/testdata/sf0.001"
OTHER = r"\b[A-Z][a-z]{2,}\s+(?:et\s+al\.?|and\s+[A-Z][a-z]{2,}|&\s+[A-Z][a-z]{2,})[\s,]*\(?(?:19|20)\d{2}\)?|\b[A-Z][a-z]{2,}\s+\((?:19|20)\d{2}\)"


def brute(d, text):
    t = f"As Smith et al. (2001), Jones 1999 and Smith et al. (2001) say, Lee & Roe, 2020 and The 2019 cohort, not by {text} ({1900 + d % 120})"
    others = "|".join(sorted({x.strip() for x in re.findall(OTHER, t)}))
    rules = re.findall(r"\b[EPD][0-9]{1,2}\b", f"By E{d % 30} and P2, E1, E1, XE5, E123; D7. {text}")
    return others, ",".join(rules), ",".join(dict.fromkeys(x for x in rules if x.startswith("E")))


def check(spark, path):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{path}/documents.parquet").to_pylist()}
    others = {r.doc_id: r.others for r in REGISTRY["text_other_paper_flags"](spark, path).collect()}
    rules = {r.doc_id: (r.cited, r.task_rules) for r in REGISTRY["text_rule_citations"](spark, path).collect()}
    assert {d: (others[d], *rules[d]) for d in others} == {d: brute(d, t) for d, t in docs.items()}
    return others, rules


def test_tables(spark):
    check(spark, DIR)


def test_mentions_at_the_end(spark, tmp_path):
    rows = [(1, "word " * 900 + "as Miller et al. (2014) and by rule E17"), (2, "Brown 1987 " + "word " * 300 + "\nGreen (2003), P9 E17"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    others, rules = check(spark, str(tmp_path))
    assert "Miller et al. (2014)" in others[1] and "Green (2003)" in others[2] and rules[1][1] == "E1,E17"
