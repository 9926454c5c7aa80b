import random
import sys
from pathlib import Path

import pytest

from test_decontamination import brute_search
from test_packing import best_fit_packing
from test_quality import brute as brute_counts
from test_simhash import brute as brute_groups
from test_suffix_dedup import brute as brute_cut

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é"]) for _ in range(rng.randrange(1, 4))) + str(rng.randrange(30))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, items = text(120), [(i, text(30)) for i in range(5)]
    docs = [(d, text(rng.randrange(20, 200))) for d in range(60)]
    docs += [(100 + d, docs[d][1]) for d in range(8)] + [(200 + d, passage + " " + text(60)) for d in range(6)]
    docs += [(300 + d, text(60) + " " + items[d][1] + " " + text(10)) for d in range(3)] + [(400, "same words " * 80), (401, None), (402, "")]
    docs += [(500 + d, " ".join(w + "%%%" for w in text(90).split())) for d in range(10)]
    full = [(d, t, "en", "src", len(t or "")) for d, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 500), 0) for d, _ in docs if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        frame = stage(spark, frame, str(tmp_path)).cache()
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = {r.doc_id: r.text for r in frame.collect()}
        if k == 0:
            assert all(d in kept and not brute_counts(t)[5] for d, t in rows.items())
            assert not any(d >= 500 for d in rows) and len(rows) >= 0.95 * sum(not brute_counts(t)[5] for d, t in docs if d < 500)
        elif k == 1:
            assert set(rows) == {c for _, _, c in brute_groups(list(kept.items()))}
        elif k == 2:
            assert {d: len(t.encode()) for d, t in rows.items()}.keys() == kept.keys()
            for d, _, _, _, left in brute_cut(list(kept.items()), corpus_pipeline.PASSAGE_BYTES):
                assert 0 <= len(rows[d].encode()) - len(left) <= 8  # whole characters only
            assert all(r.n_chars == len(r.text) for r in frame.collect())
        else:
            leak = {d for d, t in kept.items() if any(brute_search(x.lower().split(), t.lower().split()) <= len(x.split()) // 5 for _, x in items)}
            assert set(rows) == set(kept) - leak and leak
        kept = rows
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(kept)
    want = best_fit_packing(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), corpus_pipeline.tokenizer_path("word_bpe_49k.json")).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len({r.sequence_id for r in got}) == len({r.sequence_id for r in want})
