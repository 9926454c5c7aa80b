import random
import zlib

import numpy as np
import pytest

from dossier.llm import token_store as ts

P = pytest.importorskip("public_tokenizers")


def test_checksums_combine():
    rng = np.random.default_rng(1)
    a = [rng.bytes(int(n)) for n in rng.integers(0, 300, 60)]
    b = [rng.bytes(int(n)) for n in rng.integers(0, 300, 60)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = ts.combine_crc(crc(a), crc(b), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_cut_points():
    rng = np.random.default_rng(2)
    for n in (1, 15, 16, 256, 257, 5000, 60_000):
        ids = rng.integers(0, 50_000, n).astype(np.uint32)
        e = ts.cut_points(ids)
        size = np.diff([0, *e])
        assert e[-1] == n and (size <= ts.MOST).all() and (size[:-1] >= ts.LEAST).all()
    flat = np.zeros(40_000, np.uint32)
    assert ts.cut_points(flat)[-1] == 40_000
    tail = rng.integers(0, 50_000, 30_000).astype(np.uint32)
    one, two = ts.cut_points(tail), ts.cut_points(np.concatenate([tail[:77], tail]))
    assert len({x + 77 for x in one} & set(two)) > len(one) // 2


def test_store(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "é", "gamma,", "x\n"]) + str(rng.randrange(99)) for _ in range(4000))
    rows = [(i * 5 % 61, long[i * 50 : i * 50 + rng.randrange(3000)]) for i in range(60)]
    rows += [(100, long), (101, long), (102, None), (103, ""), (None, "n"), (104, "dup"), (104, "dup")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, kind int").repartition(5)
    folder = ts.write_store(df, path, per_part=10)
    want = {}
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.setdefault(d, []).append(t.encode(x or "", add_special_tokens=False).ids + [2])
    at, index = 0, []
    for d, docs in want.items():
        for ids in docs:
            index.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = ts.read_index(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == index
    back = {}
    for r in ts.read_documents(spark, folder).collect():
        back.setdefault(r.doc_id, []).append(r.ids)
    assert back == want
    chunks = ts.read_chunks(spark, folder)
    assert chunks.count() == chunks.select("address").distinct().count()
    spark.read.parquet(f"{folder}/manifest").limit(0).write.mode("overwrite").parquet(f"{folder}/manifest2")
    empty = ts.write_store(df.limit(0), path)
    assert ts.read_index(spark, empty).count() == 0


def test_damage_is_seen(spark):
    path = P.path("byte_bpe_50k.json")
    folder = ts.write_store(spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string"), path)
    r = spark.read.parquet(f"{folder}/recipes").collect()
    spark.createDataFrame([x for x in r if x.doc_id == 1], "part int, nth long, doc_id long, n_tokens long, chunks array<binary>").write.mode("overwrite").parquet(f"{folder}/recipes")
    with pytest.raises(ValueError):
        ts.read_index(spark, folder)


def test_damaged_chunk_is_seen(spark):
    folder = ts.write_store(spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string"), P.path("byte_bpe_50k.json"))
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/raw").where("kind = 1").drop("kind").collect()]
    rows[0]["ids"] = bytes(b ^ 1 for b in rows[0]["ids"])
    schema = spark.read.parquet(f"{folder}/raw").drop("kind").schema
    spark.createDataFrame([tuple(r[c] for c in schema.fieldNames()) for r in rows], schema).write.mode("overwrite").parquet(f"{folder}/raw/kind=1")
    with pytest.raises(Exception, match="damaged"):
        ts.read_index(spark, folder).collect()
