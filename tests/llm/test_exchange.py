from dossier.llm.exchange import chunks_for, forget, materialize, shared_dir
from dossier.llm.text import slices


def test_materialize_and_forget(spark):
    forget(spark)
    df = materialize(spark.range(5))
    assert shared_dir(spark) in df.inputFiles()[0] and df.count() == 5
    assert forget(spark) == 1
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_chunks_and_slices(spark):
    import pyarrow as pa

    assert chunks_for(spark.createDataFrame([("a" * 10,), (None,), ("é" * 5,)], "text string"), per=7) == 3
    batch = pa.record_batch([pa.array(["aaaa", None, "b" * 50, "c", "", "dd"])], names=["text"])
    parts = [p.column("text").to_pylist() for p in slices(batch, "text", 5)]
    assert sum(parts, []) == ["aaaa", None, "b" * 50, "c", "", "dd"] and ["b" * 50] in parts
