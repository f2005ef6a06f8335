"""Postings are worked out once, only those that a search needs, and agree with the column builders."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrytext.functions import grams as G
from quarrytext.functions import sql
from quarrytext.operators import maintain, search
from quarrytext.operators.index import Index
from quarrytext.sources.chunkers import line_chunks

ODD = ["this is a test", "", "foo_bar x1-Y2", "café ſtop", None, "  \t ", "a", "é", "ABCabc abc", "x" * 70_000, "a.b..c"]


def built(spark, *texts):
    return Index.build(spark.createDataFrame([(k, f"g{k}", t) for k, t in enumerate(texts)], "gid bigint, group_name string, text string"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numpy_grams_are_those_of_the_columns(spark, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", G.word_grams(F.col("t")).alias("g"), G.gram_count("t").alias("n")).collect()
    expected = [sorted(map(G.code_of, r["g"] or [])) for r in rows]
    assert [r["n"] for r in rows] == list(map(len, expected))
    for size in (1 << 21, 8):
        monkeypatch.setattr(G, "_BYTES", size)
        found = [[] for _ in rows]
        for row, code in G.distinct_grams(pa.array(["cut", *[r["t"] for r in rows]])[1:]):
            for r, c in zip(row.tolist(), code.tolist()):
                found[r].append(c)
        assert found == expected
    texts = spark.createDataFrame([(t,) for t in ODD if t is not None], "t string")
    for gram in (".TH", "STO", "TOP", "OP.", ".A.", "X1.", "ABC", "BC.", "F..", ".B."):
        assert texts.filter(G.has_gram(F.col("t"), gram) != F.array_contains(G.word_grams(F.col("t")), gram)).count() == 0


def test_arrays_are_made_once(spark):
    # ``explode`` would add a filter on the size of the array, and work it out for that too.
    index = built(spark, "one two\n")
    assert "size(" not in plan(line_chunks(spark.createDataFrame([(1, "a\n")], "gid bigint, text string")).select("gid", "text")).split("Generate")[1].split("LocalRelation")[0].replace("size(sizes", "").replace("size(parts", "").replace("size(starts", "")
    sql.register(spark, index)
    assert "regexp" not in plan(index.postings)


def test_searches_make_no_other_postings(spark):
    index = built(spark, "one two\nthree\n", "two three\n")
    for found in (search.search(index, ["one", "two"]), search.candidates(index, ["one"]), search.fuzzy(index, ["three"], 60), search.file_search(index, ["one", "three"])):
        assert "MapInArrow" not in plan(found) and "regexp_extract_all" not in plan(found)
        assert plan(found).count("Join") <= 2


@pytest.mark.parametrize("saved", [False, True])
def test_parts_of_an_index(spark, tmp_path, saved):
    make = lambda *rows: spark.createDataFrame(rows, "group_name string, text string").selectExpr("group_name", "timestamp '2024-01-01 00:00:00' last_changed", "text")
    path = str(tmp_path / "index")
    maintain.put(Index.empty(spark), make(("a", "one two\n\none\n"), ("b", "two\n"))).save(path)
    index = maintain.put(maintain.delete(Index.load(spark, path), F.col("group_name") == "b"), make(("c", "one three\n"), ("d", "")))
    index = maintain.add_chunk(index, "a", ["ONE", ".XY"], b"\x01")
    if saved:
        index.save(path)
        index = Index.load(spark, path)
    for state in (index, maintain.compact(index)):
        names = lambda df: sorted((r["group_name"], r["chunk_no"]) for r in df.collect())
        assert names(search.search(state, ["one"])) == [("a", 1), ("a", 3), ("c", 1)]
        assert names(search.candidates(state, grams=[G.code_of("ONE")])) == [("a", 1), ("a", 3), ("a", 4), ("c", 1)]
        assert names(search.candidates(state, grams=[G.code_of(".XY")])) == [("a", 4)]
        assert names(search.fuzzy(state, ["three"], 100)) == [("c", 1)] and search.fuzzy(state, ["threx"], 50).count() == 0
        assert names(search.file_search(state, ["one", "three"])) == [("c", 1)]
        assert state.known([G.code_of("ONE"), G.code_of(".XY"), G.code_of("QQQ")]) == 2
        posted = sorted((r["gid"], r["chunk_no"], r["gram"]) for r in state.postings.collect())
        assert len(posted) == len(set(posted))
    assert sorted((r["group_name"], r["chunk_count"]) for r in index.live.collect()) == [("a", 4), ("c", 1), ("d", 0)]
