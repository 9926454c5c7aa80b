import shutil

import pytest
from pyspark.sql import functions as F

from dossier.operators.judgments import latest_attempts
from dossier.plans.fixtures import Corpus
from dossier.sources import tables as tb
from dossier.streaming import ledger as ld


def test_files(spark, tmp_path):
    assert tb.read_csv(spark, f"{tmp_path}/none.csv", ["a"]).count() == 0
    with pytest.raises(FileNotFoundError):
        tb.read_csv(spark, f"{tmp_path}/none.csv", ["a"], strict=True)
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,\n')
    assert [tuple(r) for r in tb.read_csv(spark, f"{tmp_path}/a.csv", ["a", "b"]).orderBy("a").collect()] == [("1", "x\ny"), ("2", "")]
    (tmp_path / "m.csv").write_text("k,v\na,1\nb,2\na,3\n")
    assert {tuple(r) for r in tb.read_map(spark, f"{tmp_path}/m.csv", ["k", "v"], "k").collect()} == {("a", "3"), ("b", "2")}
    (tmp_path / "a.jsonl").write_text('{"k": "a", "v": 1}\n\n{"k": "a", "v": 2}\n{"k": "b", "v": 3}\n')
    assert {tuple(r) for r in tb.read_json_lines(spark, f"{tmp_path}/a.jsonl", "k string, v int", "k").collect()} == {("a", 2), ("b", 3)}
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    tb.write_upsert(rows(("a", 1), ("b", 1)), f"{tmp_path}/t", "k")
    tb.write_upsert(rows(("b", 2)), f"{tmp_path}/t", "k")
    assert {tuple(r) for r in tb.read_table(spark, f"{tmp_path}/t", "k string, v int").collect()} == {("a", 1), ("b", 2)}
    (tmp_path / "t" / "v00000009").mkdir()  # a version whose job died has no _SUCCESS and doesn't count
    assert tb.current(spark, f"{tmp_path}/t").endswith("v00000002") and tb.current(spark, f"{tmp_path}/none") is None
    tb.write_upsert(rows(("c", 5)), f"{tmp_path}/t", "k")
    assert tb.current(spark, f"{tmp_path}/t").endswith("v00000010")
    for _ in range(2):
        tb.append_new(rows(("a", 9), ("c", 3)), f"{tmp_path}/u", "k")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/u").collect()} == {("a", 9), ("c", 3)}
    names = spark.createDataFrame([("table_9.tex",), ("table_112.tex",), ("x.tex",)], "name string")
    assert tuple(tb.newest(names, r"_([0-9]+)\.tex$").first()) == ("table_112.tex", 112)
    assert tb.partition_of("/x/power_analysis_v2_r3.csv") == {"task": "power_analysis", "version": "v2", "round": "3"}
    paths = ["x/exclusion_r10.csv", "x/exclusion_v1_r2.csv", "x/exclusion_r2.csv", "x/notes.csv"]
    assert [m["round"] for _, m in tb.discover(paths)] == ["2", "2", "10"] and tb.locate(paths, "exclusion", 10) == "x/exclusion_r10.csv" and tb.locate(paths, "exclusion", 2, "v1") == "x/exclusion_v1_r2.csv"
    for bad in (("exclusion", 2), ("data_analysis", 1)):
        with pytest.raises(ValueError):
            tb.locate(paths, *bad)


def test_latex(spark):
    line = " & ".join(str(i) for i in range(21)) + r" \\\\"
    rows = ["% head", "% Entry 1 - a note -", r"\hline " + line, "% " + line, r"Roe\textsuperscript{\cite{roe2001}} & " + line, line, "% Entry 2", "short & row", r"Caf\'e & " + line]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(rows)] + [("g", 0, "% Entry 7"), ("g", 1, line)], "file string, nth long, value string")
    got = {r.entry: r for r in tb.read_latex_table(df).collect()}
    assert set(got) == {1, 2, 7} and got[1].fields[:3] == ["Roe", "0", "1"] and got[1].cite_key == "roe2001" and got[1].note == "a note"
    assert got[2].fields[0] == "Caf\u00e9" and all(len(r.fields) == 22 for r in got.values()) and got[7].fields[20:] == ["20", ""]
    x = tb.read_exclusions(spark.createDataFrame([(" Roe", "2001", "k", "pilot", "10.1/x", "7"), ("Li", "", "", "", None, None)], "first_author string, year string, citation_key string, exclusion_reason string, doi string, pmid string"), "f.csv")
    assert [r.citation_raw for r in x.collect()] == ["Roe (2001)", "Li"]


def test_stream_equals_batch(spark, tmp_path):
    attempts = Corpus(spark, "/root/testdata/sf0.001").attempts()
    for k in range(3):
        attempts.where(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ld.read_ledger(spark, f"{tmp_path}/in", attempts.schema)
    q = ld.latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest_now").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.paper_id, r.attempt, r.event_id) for r in latest_attempts(attempts).collect()}
    assert {(r.paper_id, r.attempt, r.event_id) for r in spark.table("latest_now").collect()} == want
    for _ in range(2):  # a second run with the same checkpoint, and one without, add nothing
        ld.run_to_end(ld.append_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "event_id"))
    shutil.rmtree(tmp_path / "ck")
    ld.run_to_end(ld.append_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "event_id"))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == attempts.count() == out.select("event_id").distinct().count()


def test_lines(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.txt").write_text('{"type": "result"}\n{"type": "assi\n[1]\n\n{"x": 1}\n')
    q = ld.read_lines(spark, f"{tmp_path}/e").writeStream.format("memory").queryName("lines_now").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(str(r.kind) for r in spark.table("lines_now").collect()) == ["None", "result"]
