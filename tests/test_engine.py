"""Golden vectors of grams, chunkers, searches, output forms and the ordered varint."""

import pytest
from pyspark.sql import functions as F

from quarrytext.functions import grams as G
from quarrytext.functions import output
from quarrytext.operators import maintain, search, stats
from quarrytext.operators.index import Index, current_version
from quarrytext.sources.chunkers import line_chunks, org_chunks, org_elements

SIX = "one\ntwo three\nfour\nfour five\none two three\none three two\n"


def texts(spark, *rows):
    return spark.createDataFrame([(k + 1, name, text) for k, (name, text) in enumerate(rows)], "gid bigint, group_name string, text string")


@pytest.fixture(scope="module")
def six(spark):
    return Index.build(texts(spark, ("six", SIX)))


def hits(df):
    return sorted((r["line"], r["start"], r["offset"]) for r in df.collect())


GRAMS = [
    ("this is a test", ".TH THI HIS IS. .IS .A. .TE TES EST ST.", "THI HIS TES EST"),
    ("a", ".A.", ""),
    ("ab", ".AB AB.", ""),
    ("foo_bar", ".FO FOO OO. .BA BAR AR.", "FOO BAR"),
    ("café au", ".CA CAF AF. .AU AU.", "CAF"),
    ("x1-Y2", ".X1 X1. .Y2 Y2.", ""),
    ("\u017ftop", ".TO TOP OP.", "TOP"),
    ("  \t ", "", ""),
    ("", "", ""),
]


def test_grams_of_texts(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in GRAMS], "t string")
    rows = df.select("t", G.word_grams(F.col("t")).alias("w"), G.partial_grams(F.col("t")).alias("p")).collect()
    for (text, word, partial), row in zip(GRAMS, rows):
        assert sorted(row["w"]) == sorted(word.split()) == G.query_grams([text])
        assert sorted(row["p"]) == sorted(partial.split()) == G.query_grams([text], True)


def test_gram_codes(spark):
    assert G.code_of("TH.") == 41736 == 0xA308
    known = ".th thi his hi. .is is. .a. .te tes est st. 0Z9".split()
    df = spark.createDataFrame([(g.upper(),) for g in known], "g string")
    for row in df.select("g", G.gram_code(F.col("g")).alias("c")).withColumn("b", G.gram_text(F.col("c"))).withColumn("h", G.gram_hex(F.col("c"))).collect():
        assert row["b"] == row["g"] and row["c"] == G.code_of(row["g"]) and row["h"] == f"{row['c']:04x}"
        assert G.text_of(row["c"]) == row["g"]
    assert G.parse_gram("a308", "hex") == G.parse_gram("41736", "decimal") == G.parse_gram("th.")
    assert G.text_of(G.parse_gram("a..")) == ".A." and G.text_of(G.parse_gram("a.b")) == "..B"
    with pytest.raises(ValueError):
        G.parse_gram("abcd")


def test_line_offsets(six):
    rows = six.chunks.orderBy("line").select("line", "rune_off", "rune_len", "text").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 4, "one"), (2, 4, 10, "two three"), (3, 14, 5, "four"), (4, 19, 10, "four five"), (5, 29, 14, "one two three"), (6, 43, 14, "one three two")]


def test_lines_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "é\r\n\nx"), (2, ""), (3, None), (4, "no end")], "gid bigint, text string")
    rows = [tuple(r) for r in line_chunks(df).orderBy("gid", "line").select("gid", "line", "rune_off", "byte_off", "byte_len", "text").collect()]
    assert rows == [(1, 1, 0, 0, 4, "é\r"), (1, 2, 3, 4, 1, "")]
    kept = [tuple(r) for r in line_chunks(df, keep_tail=True).orderBy("gid", "line").select("gid", "line", "rune_len", "text").collect()]
    assert kept == [(1, 1, 3, "é\r"), (1, 2, 1, ""), (1, 3, 1, "x"), (4, 1, 6, "no end")]


@pytest.mark.parametrize("use_index", [True, False])
def test_golden_searches(six, use_index):
    find = lambda *a, **o: hits(search.search(six, list(a), use_index=use_index, **o))
    assert find("one two") == [(5, 29, 0)]
    assert find("one", "two") == [(5, 29, 0), (6, 43, 0)]
    assert find("two", "one") == [(5, 29, 4), (6, 43, 10)]
    assert find("ONE") == [(1, 0, 0), (5, 29, 0), (6, 43, 0)]
    assert find("thre") == [] and find("one", "five") == []
    assert find("thre", partial=True) == [(2, 4, 4), (5, 29, 8), (6, 43, 4)]
    assert find("on", partial=True) == [] and find("our", partial=True) == [(3, 14, 1), (4, 19, 1)]
    assert find("one", limit=2) == [(1, 0, 0), (5, 29, 0)] and find("one", limit=0) == []
    assert find("one", pattern="two$") == [(6, 43, 0)]


def test_candidates_fuzzy_and_files(spark, six):
    assert sorted(r["line"] for r in search.candidates(six, ["one two"]).collect()) == [5, 6]
    score = lambda a, p, **o: sorted((r["line"], round(r["percent"], 6)) for r in search.fuzzy(six, a, p, **o).collect())
    assert score(["three"], 50) == [(2, 100.0), (5, 100.0), (6, 100.0)]
    assert score(["three four"], 40) == [(2, 60.0), (3, 40.0), (4, 40.0), (5, 60.0), (6, 60.0)]
    assert score(["three four"], 70) == [] and score(["one twa"], 50) == []
    assert score(["one twa"], 50, unknown_grams="ignore") == [(1, 50.0), (5, 50.0), (6, 50.0)]
    two = Index.build(texts(spark, ("a", "one\nx two\n"), ("b", "one\none\n"), ("c", "two one\n")))
    found = sorted((r["group_name"], r["line"], r["start"], r["offset"]) for r in search.file_search(two, ["one", "two"]).collect())
    assert found == [("a", 1, 0, 0), ("c", 1, 0, 0)]


def test_matching_edges(spark):
    index = Index.build(texts(spark, ("g", "aab\noneone\nfoo one\n_one_\né one2 one\n")))
    assert hits(search.search(index, ["ab"], partial=True, use_index=False)) == []
    assert hits(search.search(index, ["aab"], partial=True)) == [(1, 0, 0)]
    assert hits(search.search(index, ["one"])) == [(3, 11, 4), (4, 19, 1), (5, 25, 7)]
    with pytest.raises(ValueError):
        search.search(index, ["one", ""])


def test_coverage(six):
    grams = {r["threshold"]: r["grams"] for r in stats.coverage(six).collect()}
    assert grams[0.7] == 19 and grams[0.99] == 19 and grams[0.3] == grams[0.2] == 4 and grams[0.1] == 0
    sizes = stats.posting_sizes(six).first()
    assert (sizes["grams"], sizes["longest"], sizes["shortest"]) == (19, 3, 1)


ORG = [
    ("* Head one\nPara line a\npara line b\n\nPara two\n", [(1, "HEADLINE", 0, 10), (2, "PARAGRAPH", 11, 34), (5, "PARAGRAPH", 36, 44)]),
    ("* H\n:PROPERTIES:\n:ID: 1\n:END:\nbody\n", [(1, "HEADLINE", 0, 3), (2, "DRAWER", 4, 29), (5, "PARAGRAPH", 30, 34)]),
    ("- item a\n  continued text\n- item b\n\n  more\nflush para\n", [(1, "LIST_ITEM", 0, 25), (3, "LIST_ITEM", 26, 42), (6, "PARAGRAPH", 43, 53)]),
    ("| a | b |\n|---+---|\n| 1 | 2 |\n", [(1, "TABLE_LINE", 0, 9), (2, "TABLE_LINE", 10, 19), (3, "TABLE_LINE", 20, 29)]),
    ("#+BEGIN: clocktable\nrow\n#+END:\nafter\n", [(1, "DYNBLOCK", 0, 30), (4, "PARAGRAPH", 31, 36)]),
    ("#+TITLE: x\n-----\n[fn:1] note\n# comment\n  * starred\n1) one\n1. two\n", [(1, "KEYWORD", 0, 10), (2, "HR", 11, 16), (3, "FOOTNOTE", 17, 28), (4, "PARAGRAPH", 29, 57), (7, "LIST_ITEM", 58, 64)]),
    ("\\begin{eq}\nx\n\\end{eq}\n", [(1, "PARAGRAPH", 0, 21)]),
    ("#+begin_src sh\necho hi\n#+end_src\nafter text\n* H\n", [(1, "BLOCK", 0, 32), (4, "PARAGRAPH", 33, 43), (5, "HEADLINE", 44, 47)]),
    ("- a\n  bb\n", [(1, "LIST_ITEM", 0, 8)]),
    ("- a\n  bbb\n", [(1, "LIST_ITEM", 0, 9)]),
    ("- a", [(1, "LIST_ITEM", 0, 3)]),
    ("#+begin_src", [(1, "BLOCK", 0, 11)]),
    ("", []),
]


@pytest.mark.parametrize("text,expected", ORG)
def test_org_elements(text, expected):
    assert list(org_elements(text)) == expected


def test_org_strict():
    assert list(org_elements(ORG[7][0], True)) == [(1, "BLOCK", 0, 47)]
    assert list(org_elements("- a\n  bb\n", True)) == [(1, "LIST_ITEM", 0, 3), (2, "PARAGRAPH", 4, 8)]
    assert list(org_elements("- a\n  bbb\n", True)) == [(1, "LIST_ITEM", 0, 9)]


def test_org_chunks(spark):
    df = spark.createDataFrame([(1, "* é x\n-----\nb\n"), (2, None), (3, "")], "gid bigint, text string")
    rows = [tuple(r) for r in org_chunks(df).orderBy("gid", "line").select("gid", "elem_type", "rune_off", "byte_off", "byte_len", "text").collect()]
    assert rows == [(1, "HEADLINE", 0, 0, 6, "* é x"), (1, "PARAGRAPH", 12, 13, 1, "b")]


VARINTS = "0:00 127:7f 128:8080 4095:8fff 4096:901000 1048575:9fffff 1048576:a0100000 268435455:afffffff 268435456:b010000000 68719476735:bfffffffff 68719476736:c01000000000 17592186044415:cfffffffffff 17592186044416:d0100000000000 4503599627370495:dfffffffffffff 4503599627370496:e010000000000000 1152921504606846975:efffffffffffffff 1152921504606846976:f01000000000000000 18446744073709551615:f0ffffffffffffffff"


def test_varint(spark):
    pairs = [(int(a), b) for a, b in (x.split(":") for x in VARINTS.split())]
    for n, shown in pairs:
        assert output.ordered_varint(n).hex() == shown and output.read_varint(bytes.fromhex(shown) + b"x") == (n, b"x")
    assert sorted(b for _, b in pairs) == [b for _, b in pairs]
    df = spark.createDataFrame([(str(a), b) for a, b in pairs], "n string, b string")
    assert df.select(output.varint_hex(F.col("n").cast("decimal(20,0)")).alias("v"), "b").filter("v <> b").count() == 0


def test_formats(spark):
    index = Index.build(texts(spark, ("f", 'say "hi"\\\tone\n')))
    found = search.search(index, ["one"])
    assert output.formatted(found).first()["output"] == 'f:1:say \\"hi\\"\\\\\\tone'
    assert output.formatted(found, output.SEXP).first()["output"] == '(:filename "f" :line 1 :offset 10 :text "say \\"hi\\"\\\\\\tone" :char-offset 0 :percent 0.000000)'
    odd = spark.createDataFrame([("a\x00\x1b\u00a0é\u200b\ufeff\U000e0001z",), ("plain é",)], "t string")
    assert [r[0] for r in odd.select(output.escape(F.col("t"))).collect()] == ["a\\x00\\x1b\\u00a0é\\u200b\\ufeff\\U000e0001z", "plain é"]
    assert output.numbers(found).first()["output"] == "f:1"
    assert output.printed(output.numbers(found).collect(), "<%[6]s>\n", "</%[6]s>\n") == "<f>\nf:1\n</f>\n"
    assert output.split_terms('one "two three"') == ["one", "two three"]
    assert '"line":1' in output.as_json(found).first()["output"]


def test_maintenance(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "one two\n"), ("b", "2024-01-01 00:00:00", "one\n"), ("c", "2024-01-01 00:00:00", "zz\n")]
    make = lambda rows: spark.createDataFrame(rows, "group_name string, t string, text string").selectExpr("group_name", "cast(t as timestamp) last_changed", "text")
    path = str(tmp_path / "index")
    index = maintain.put(Index.empty(spark), make(rows))
    assert index.save(path) == 1 and current_version(spark, path) == 1
    index = Index.load(spark, path)
    names = lambda i, t: sorted(r["group_name"] for r in search.search(i, [t]).collect())
    assert names(index, "one") == ["a", "b"]
    assert maintain.put(index, make(rows)).groups.count() == 3  # nothing is new
    gone = maintain.delete(index, F.col("group_name") == "a")
    assert names(gone, "one") == ["b"] and gone.chunks.count() == 3
    small = maintain.compact(gone)
    assert names(small, "one") == ["b"] and small.chunks.count() == 2 and small.groups.count() == 2
    assert search.fuzzy(gone, ["two"], 100).count() == 0 and stats.totals(gone).first()["deleted_chunks"] == 1
    later = make([("a", "2024-01-01 00:00:00", "one two\n"), ("b", "2024-02-01 00:00:00", "three\n")])
    plan = sorted(tuple(r)[:2] for r in maintain.update_plan(index.groups, later).collect())
    assert plan == [("b", "input"), ("c", "delete")]
    index = maintain.add_chunk(maintain.add_empty(index, spark.createDataFrame([("e",)], "group_name string")), "mine", ["abc"], b"\x01")
    done = maintain.maintain(index, later)
    assert names(done, "one") == ["a"] and names(done, "three") == ["b"]
    assert sorted(r["group_name"] for r in done.groups.collect()) == ["a", "b", "e", "mine"]
    assert [bytes(r["data"]) for r in maintain.chunk_data(done, "mine").collect()] == [b"\x01"]
    done.save(path)
    assert names(Index.load(spark, path), "three") == ["b"] and names(Index.load(spark, path, 1), "three") == []
    with pytest.raises(search.StaleGroupError):
        search.fresh(Index.load(spark, path, 1), make([(n, "2024-03-01 00:00:00", "") for n in "abc"]))
    with pytest.raises(search.MissingGroupError):
        search.fresh(Index.load(spark, path, 1), later.filter("group_name = 'b' AND false"))
    assert names(search.fresh(Index.load(spark, path, 1), later, "skip"), "one") == ["a"]


def test_ids_are_not_used_again(spark):
    make = lambda t: spark.createDataFrame([("a", t), ("b", "one\n")], "group_name string, text string").selectExpr("group_name", "timestamp '2024-01-01 00:00:00' last_changed", "text")
    names = lambda i, **o: sorted(r["group_name"] for r in search.search(i, ["one"], **o).collect())
    index = maintain.put(Index.empty(spark), make("one two\n"))
    again = maintain.put(maintain.delete(index, F.col("group_name") == "a"), make("one two\n"))
    for state in (again, maintain.compact(again)):
        assert names(state) == names(state, use_index=False) == ["a", "b"]
    assert maintain.compact(again).groups.count() == 2 and again.groups.count() == 3


def test_segments(spark, tmp_path):
    import os

    from quarrytext.operators.index import vacuum

    path = str(tmp_path / "index")
    make = lambda *rows: spark.createDataFrame(rows, "group_name string, text string").selectExpr("group_name", "timestamp '2024-01-01 00:00:00' last_changed", "text")
    names = lambda t: sorted(r["group_name"] for r in search.search(Index.load(spark, path), [t]).collect())
    maintain.put(Index.empty(spark), make(("a", "one two\n" * 50), ("b", "rare\n"))).save(path)
    maintain.put(Index.load(spark, path), make(("c", "one rare\n"))).save(path)
    assert Index.load(spark, path).stored.segments == ("v1/0", "v2/0") and not os.path.exists(f"{path}/v2/1")
    assert names("rare") == ["b", "c"] and names("one") == ["a"] * 50 + ["c"] and names("nowhere") == []
    maintain.delete(Index.load(spark, path), F.col("group_name") == "b").save(path)
    assert os.listdir(f"{path}/v3") == ["groups"] and names("rare") == ["c"]
    assert [r["group_name"] for r in search.file_search(Index.load(spark, path), ["one", "rare"]).collect()] == ["c"]
    maintain.compact(Index.load(spark, path)).save(path)
    vacuum(spark, path)
    assert sorted(os.listdir(path)) == ["v1", "v2", "v3", "v4", "versions"] and os.listdir(f"{path}/v1") == [] and names("rare") == ["c"]


def test_long_texts_have_right_offsets(spark):
    text = "".join(f"é{'x' * (k % 7)}\n" for k in range(1000))
    rows = line_chunks(spark.createDataFrame([(1, text)], "gid bigint, text string")).orderBy("line").collect()
    at = 0
    for r in rows:
        assert r["rune_off"] == at and r["byte_off"] == len(text[:at].encode())
        at += r["rune_len"]
    assert len(rows) == 1000 and at == len(text)


def test_file_list(spark):
    index = Index.build(texts(spark, ("b", "x\n"), ("A", "x\n"), ("a", "x\n"), ("C", "x\n")))
    assert [r["group_name"] for r in stats.file_list(index).collect()] == ["A", "a", "b", "C"]


def test_stream(spark, tmp_path):
    from quarrytext.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("hello stream\n")
    path = str(tmp_path / "index")
    for text in (None, "hello again\n"):
        if text:
            (tmp_path / "in" / "y.txt").write_text(text)
        ingest.ingest(ingest.watch_files(spark, str(tmp_path / "in")), path, str(tmp_path / "checkpoint")).awaitTermination()
    assert search.search(Index.load(spark, path), ["hello"]).count() == 2


def test_command_line(spark, tmp_path, capsys):
    import io

    from quarrytext import cli

    file, path = tmp_path / "six.txt", str(tmp_path / "index")
    file.write_text(SIX)

    def run(*argv):
        out = io.StringIO()
        return cli.run(spark, list(argv), out), out.getvalue()

    assert run("search", path, "one")[0] == cli.NO_INDEX
    assert run("create", path) == (0, "")
    assert run("input", path, str(file)) == (0, "")
    assert run("search", path, "one two") == (0, f"{file}:5:one two three\n")
    assert run("search", "-n", path, "five") == (0, f"{file}:4\n")
    assert run("search", path, "nowhere") == (cli.NOTHING, "")
    assert run("search", "--fuzzy", "70", "--file", path, "x")[0] == cli.USAGE
    assert run("grams", "ab") == (0, ".AB AB.\n")
    assert "chunks: 6" in run("info", path)[1]
    assert run("info", path, "nothing")[0] == cli.NO_GROUP
    assert run("chunk", "--data", "01ff", "--dx", path, "mine", "abc,def") == (0, "")
    assert run("files", path) == (0, f"{file}\nmine\n")
    assert run("update", "-t", path) == (0, "") and run("update", path) == (0, "")
    assert run("data", "--dx", path, "mine") == (0, "01ff\n")
    assert run("delete", path, str(file)) == (0, "") and run("search", path, "one")[0] == cli.NOTHING
    assert run("compact", path) == (0, "") and "groups: 1" in run("info", path)[1]
