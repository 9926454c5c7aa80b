"""Sinks, run records, databases and guards."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from dossier.operators import records as rc
from dossier.operators import stats as st
from dossier.sources import records as rs
from dossier.sources import tables as tb


def test_files_of_one_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.json").write_bytes(b'{"text": "a\xffb", "n": 1}')
    (tmp_path / "in" / "p2.json").write_text("{broken")
    got = {r.paper_id: (r.text, r.n) for r in rs.read_papers(spark, f"{tmp_path}/in", "text string, n int").collect()}
    assert got == {"p1": ("a\ufffdb", 1), "p2": (None, None)}
    rs.write_papers(spark.createDataFrame([("a", "x"), ("b", "y")], "paper_id string, text string"), f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["paper_id=a", "paper_id=b"]
    assert spark.read.json(f"{tmp_path}/out").where("paper_id = 'b'").first().text == "y"


def test_run_records(spark, tmp_path):
    path = f"{tmp_path}/run.json"
    with pytest.raises(FileNotFoundError):
        rs.read_environment(spark, path)
    for effort in ("low", "high"):
        rs.write_environment(spark, path, {"model": "m", "effort": effort})
    assert rs.read_environment(spark, path) == {"model": "m", "effort": "high"}
    rs.write_text(spark, path, "{")
    with pytest.raises(ValueError):
        rs.read_environment(spark, path)
    book = tmp_path / "books"
    for text in (None, "", "v9", "v1"):
        if text is not None:
            (book / "v1").mkdir(parents=True, exist_ok=True)
            (book / "CURRENT").write_text(text)
        if text != "v1":
            with pytest.raises((FileNotFoundError, ValueError)):
                rs.resolve_promptbook(spark, str(book), "exclusion")
    with pytest.raises(FileNotFoundError):
        rs.resolve_promptbook(spark, str(book), "exclusion")
    (book / "v1" / "exclusion.md").write_text("# E\n1. **E1.** x\n")
    assert rs.resolve_promptbook(spark, str(book), "exclusion") == ("v1", "# E\n1. **E1.** x\n")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 'x,"y"'), ("b", None, None)], "k string, n int, t string")
    rs.write_projection(rows, f"{tmp_path}/p", ["t", "k", "missing"])
    back = tb.read_csv(spark, f"{tmp_path}/p", ["t", "k", "missing"])
    assert {tuple(r) for r in back.collect()} == {('x,"y"', "a", ""), ("", "b", "")}
    manifest = lambda *ids: spark.createDataFrame([(i, "DROPPED", "R") for i in ids] + [("z", "DROPPED", "other")], "paper_id string, verdict string, verdict_reason string")
    log = lambda *ids: spark.createDataFrame([(i, f"note {i}") for i in ids], "paper_id string, note string")
    rs.complete_log(log("a", "b", "z"), f"{tmp_path}/log", manifest("a", "b"), "R")
    got = rs.complete_log(log("c"), f"{tmp_path}/log", manifest("b", "c"), "R")
    assert sorted(r.paper_id for r in got.collect()) == ["b", "c"]
    metrics = spark.createDataFrame([("t", 0.5, None)], "task string, accuracy double, kappa double")
    bins = spark.createDataFrame([("t", 1, 3), ("t", 2, 4)], "task string, bin int, n int")
    report = rs.json_report(metrics, bins=bins)
    assert report["t"]["kappa"] is None and [b["n"] for b in report["t"]["bins"]] == [3, 4]
    text = rs.markdown_report("Title", [("One", metrics), ("Two", bins)])
    assert text.startswith("# Title\n\n## One\n| task | accuracy | kappa |\n|-|-|-|\n| t | 0.500 | \u2014 |") and "## Two\n| task | bin | n |" in text
    with pytest.raises(ValueError):
        rs.markdown_report("x", [("long", spark.range(5))], most=3)
    page = rs.html_report("A & B", [("One", spark.createDataFrame([("<b>", 0.25, None)], "t string, v double, n int"))])
    assert "<title>A &amp; B</title>" in page and "<tr><td>&lt;b&gt;</td><td>0.250</td><td>\u2014</td></tr>" in page
    assert rs.output_name("build", None, "s") == "build_latest_any_version_s"
    assert rs.latex_table(spark.createDataFrame([("a_b", 5)], "name string, n int")).splitlines()[2] == r"a\_b & 5 \\"


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    rows = spark.createDataFrame([(i, f"t{i}", i / 2) for i in range(50)], "k long, t string, v double")
    assert rs.write_sqlite(rows, path, "x", ["k"]) == 50 and rs.write_sqlite(rows.where("k = 3").withColumn("t", F.lit("new")), path, "x", ["k"]) == 1
    spark.dataSource.register(rs.Sqlite)
    back = spark.read.format("dossier_sqlite").option("path", path).option("table", "x").option("parts", "4").load()
    assert back.count() == 50 and back.rdd.getNumPartitions() == 4 and back.where("k = 3").first().t == "new" and dict(back.dtypes) == {"k": "bigint", "t": "string", "v": "double"}
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE empty (a INTEGER)")
    assert spark.read.format("dossier_sqlite").option("path", path).option("table", "empty").load().count() == 0


def test_guards(spark):
    runs = spark.createDataFrame([("r1", "t")], "run_id string, task string")
    j = "paper_id string, task string, judgment_index int, decision string, confidence double, run_id string, response_id string"
    log = spark.createDataFrame([("a", "t", 1, "yes", 0.5, "r1", "x1")], j)
    batch = lambda *rows: spark.createDataFrame(list(rows), "paper_id string, task string, decision string, confidence double, run_id string, response_id string")
    out = rc.append_judgments(batch(("a", "t", "no", 0.5, "r1", "x2"), ("b", "t", "no", 0.5, "r1", "x3")), log, runs)
    assert {(r.paper_id, r.judgment_index) for r in out.collect()} == {("a", 2), ("b", 1)}
    for bad in (("a", "t", "no", 0.5, "r1", "x1"), ("a", "t", "no", 1.5, "r1", "x9"), ("a", "t", "no", 0.5, "r2", "x9"), ("a", "t", "perhaps", 0.5, "r1", "x9")):
        with pytest.raises(rc.Refused):
            rc.append_judgments(batch(("b", "t", "no", 0.5, "r1", "x3"), bad), log, runs)
    h = ["task", "split", "promptbook_version", "run_ids", "configuration_status", "configuration_fingerprint"]
    table = lambda *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in h))
    old = table(("t", "build", "v1", "r1", "comparable", "f")).withColumn("nth", F.lit(1))
    assert rc.append_history(table(("t", "build", "v2", "r2", "comparable", "f")), old, h).count() == 2
    for bad in (("t", "build", "v1", "r1", "comparable", "f"), ("t", "build", "v2", "r2", "mixed_configuration", "f")):
        with pytest.raises(rc.Refused):
            rc.append_history(table(bad), old, h)
    with pytest.raises(rc.Refused):
        rc.append_history(table(("t", "build", "v2", "r2", "comparable", "f")), old.withColumn("extra", F.lit(1)), h)


def test_request_schema():
    one, two = rc.request_schema("exclusion"), rc.request_schema("power_analysis", "data_analysis")
    assert "wrong_text" in one["properties"]["decision"]["enum"] and list(two["properties"]) == ["power_analysis", "data_analysis"]
    assert "wrong_text" not in two["properties"]["power_analysis"]["properties"]["decision"]["enum"] and not two["additionalProperties"]


def test_exact_stratified_test(spark):
    import itertools
    import math

    tables = [(3, 2, 1, 4), (5, 1, 2, 2), (0, 3, 2, 1)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    dist, mean = {0: 1.0}, 0.0
    for a, b, c, d in tables:
        r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
        p = {k: math.comb(r1, k) * math.comb(r2, c1 - k) / math.comb(n, c1) for k in range(max(0, c1 - r2), min(r1, c1) + 1)}
        new = {}
        for (x, px), (y, py) in itertools.product(dist.items(), p.items()):
            new[x + y] = new.get(x + y, 0) + px * py
        dist, mean = new, mean + r1 * c1 / n
    seen = sum(t[0] for t in tables)
    want = sum(p for k, p in dist.items() if abs(k - mean) >= abs(seen - mean) - 1e-9)
    assert abs(st.cmh_exact(df).first().p_value - want) < 1e-9


def test_medians(spark):
    import random
    from statistics import median

    from dossier.functions.median import median_by

    rng = random.Random(5)
    rows = [(k, rng.choice([0.0, 1.5, rng.gauss(0, 1e6), float(rng.randrange(5))])) for k in "abc" for _ in range(rng.choice([1, 2, 400, 401]))] + [("d", 7.0)] * 4 + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.median) for r in median_by(df, "v", "k").collect()}
    assert got == {k: (len(v := [x for y, x in rows if y == k and x is not None]), median(v)) for k in "abcd"}
    every = [x for _, x in rows if x is not None]
    assert tuple(median_by(df, "v").first()) == (len(every), median(every))
