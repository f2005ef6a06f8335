"""The pipeline on a small corpus: each stage's decisions take effect and clean documents stay."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(1500)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    texts = {k: prose(200) for k in range(80)}
    shared, item = prose(70), prose(30)
    texts[80] = list(texts[10])  # a copy
    texts[81] = [w.upper() + "!!" for w in prose(200)]  # junk
    texts[20][50:50], texts[21][100:100] = shared, shared
    texts[30][20:20] = item
    texts[82] = prose(10)  # too short
    rows = [(k, " ".join(t), "en", "s", len(" ".join(t))) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 80, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "substring dedup":
            kept = {r["doc_id"]: r for r in docs.collect()}
            assert " ".join(shared) in kept[20]["text"] and " ".join(shared) not in kept[21]["text"] and kept[21]["n_chars"] == len(kept[21]["text"])
    clean = set(range(80))
    assert ids["quality rules"] == clean | {80}
    assert ids["SimHash near-dedup"] == ids["substring dedup"] == clean
    assert ids["benchmark decontamination"] == ids["packing"] == clean - {30}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 79


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    text = " ".join(rng.choice(words) for _ in range(120))
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " \n\t"), (5, "word " * 30_000), (None, text + " more"), (6, text + " end"), (None, None)]
    names = ["fp", "row", "spans", "h", "doc", "kept", "doc_id_2", "__id", "own", "words", "n_tokens", "bucket"]
    odd = spark.createDataFrame([(*r, *[str(k)] * len(names), 7) for k, r in enumerate(rows)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names) + ", n_chars bigint")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b"), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, odd.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
            if docs is odd:  # every stage on all odd rows: what it may drop is known
                assert kept == {
                    "quality rules": [(False, 1), (False, 1), (False, 6), (True, 0)],
                    "SimHash near-dedup": [(False, 1), (False, 2), (False, 5), (True, 0), (True, 0)],
                    "substring dedup": [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)],
                    "benchmark decontamination": sorted((r[0] is None, r[0] or 0) for r in rows),
                    "packing": sorted((r[0] is None, r[0] or 0) for r in rows),
                }[name], (name, kept)
            else:
                assert kept == []
