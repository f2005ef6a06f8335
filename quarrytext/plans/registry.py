"""The registered queries over the driver's tables, and their DuckDB SQL.

A document is a group and a line is a chunk; group names are the ids as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrytext.functions import grams as G
from quarrytext.functions import output, sql
from quarrytext.operators import maintain, search, stats
from quarrytext.operators.index import Index
from quarrytext.sources.chunkers import exploded, line_chunks, line_kind, org_chunks
from quarrytext.sources.tables import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("gid"), F.col("doc_id").cast("string").alias("group_name"), "text")


def index(spark: SparkSession, sf_dir: str, postings: bool = False) -> Index:
    return Index.build(documents(spark, sf_dir), postings=postings)


_LINES = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
 c AS (SELECT doc_id, unnest(range(1, len(a))) AS line_no, a FROM l),
 chunks AS (SELECT doc_id, line_no, a[line_no] AS line,
   CAST(coalesce(sum(length(a[line_no]) + 1) OVER w, 0) AS BIGINT) AS rune_off,
   CAST(coalesce(sum(strlen(a[line_no]) + 1) OVER w, 0) AS BIGINT) AS byte_off
   FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_GRAMS = (
    _LINES
    + """,
 w AS (SELECT doc_id, line_no, upper(unnest(regexp_extract_all(line, '[0-9A-Za-z]+'))) AS w FROM chunks),
 postings AS (SELECT DISTINCT doc_id, line_no, substr('.' || w || '.', i, 3) AS gram
   FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w))"""
)
_ALPHABET = G.ALPHABET


def _code_sql(gram: str) -> str:
    place = lambda k: f"(strpos('{_ALPHABET}', substr({gram}, {k}, 1)) - 1)"
    return f"CAST(({place(1)} * 37 + {place(2)}) * 37 + {place(3)} AS INTEGER)"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _word_regex(arg: str) -> str:
    return f"(?is)^(|.*?[^0-9A-Za-z]){_quoted(arg)}(?:[^0-9A-Za-z]|\\z)"


def _search_sql(args: list[str], extra: str = "", columns: str = "", tail: str = "") -> str:
    tests = " AND ".join(f"regexp_matches(line, '{_word_regex(a)}')" for a in args)
    columns = columns or "CAST(doc_id AS VARCHAR) AS group_name, doc_id AS gid, line_no AS line, rune_off AS start, \"offset\", line AS text"
    return _LINES + f""",
 hits AS (SELECT *, CAST(length(regexp_extract(line, '{_word_regex(args[0])}', 1)) AS BIGINT) AS "offset" FROM chunks WHERE {tests} {extra})
SELECT {columns} FROM hits {tail}"""


_SHOWN = ("group_name", "gid", "line", "start", "offset", "text")


# Chunks, grams, postings ------------------------------------------------------------------------------


@query("line_chunks", _LINES + "\nSELECT doc_id AS gid, line_no AS line, rune_off, CAST(length(line) + 1 AS BIGINT) AS rune_len, byte_off, CAST(strlen(line) + 1 AS BIGINT) AS byte_len, line AS text FROM chunks")
def line_chunks_query(spark, sf_dir):
    return line_chunks(documents(spark, sf_dir)).select("gid", "line", "rune_off", "rune_len", "byte_off", "byte_len", "text")


@query("line_gram_counts", _GRAMS + "\nSELECT c.doc_id AS gid, c.line_no AS line, CAST(count(gram) AS INTEGER) AS gram_count FROM chunks c LEFT JOIN postings p USING (doc_id, line_no) GROUP BY ALL")
def line_gram_counts(spark, sf_dir):
    return line_chunks(documents(spark, sf_dir)).select("gid", "line", "gram_count")


@query("gram_postings", _GRAMS + f"\nSELECT {_code_sql('gram')} AS gram, doc_id AS gid, line_no AS chunk_no FROM postings")
def gram_postings(spark, sf_dir):
    return index(spark, sf_dir, True).postings


@query(
    "partial_grams",
    """WITH w AS (SELECT item_id, upper(unnest(regexp_extract_all(text, '[0-9A-Za-z]+'))) AS w FROM benchmark)
SELECT DISTINCT item_id, substr(w, i, 3) AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)""",
)
def partial_grams(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(G.partial_grams(F.col("text"))).alias("gram"))


@query("gram_codes", _GRAMS + f", d AS (SELECT DISTINCT gram FROM postings)\nSELECT gram, {_code_sql('gram')} AS code, lpad(lower(hex(CAST({_code_sql('gram')} AS BIGINT))), 4, '0') AS hex, gram AS back FROM d")
def gram_codes(spark, sf_dir):
    found = exploded(line_chunks(documents(spark, sf_dir)).select(G.word_grams(F.col("text")).alias("gram")), "gram").distinct()
    coded = found.select("gram", G.gram_code(F.col("gram")).alias("code"))
    return coded.select("gram", "code", G.gram_hex(F.col("code")).alias("hex"), G.gram_text(F.col("code")).alias("back"))


@query("gram_df", _GRAMS + f"\nSELECT {_code_sql('gram')} AS gram, count(*) AS chunks FROM postings GROUP BY ALL")
def gram_df(spark, sf_dir):
    return stats.gram_df(index(spark, sf_dir))


@query(
    "gram_coverage",
    _GRAMS
    + ", d AS (SELECT gram, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM chunks) AS share FROM postings GROUP BY gram),\n t(threshold) AS (VALUES "
    + ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in stats.THRESHOLDS)
    + ")\nSELECT threshold, count(*) FILTER (WHERE share <= threshold) AS grams FROM t, d GROUP BY threshold",
)
def gram_coverage(spark, sf_dir):
    return stats.coverage(index(spark, sf_dir))


@query("posting_sizes", _GRAMS + ", d AS (SELECT gram, count(*) AS n FROM postings GROUP BY gram)\nSELECT count(*) AS grams, CAST(sum(n) AS BIGINT) AS postings, min(n) AS shortest, max(n) AS longest, (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) FROM chunks) AS chunk_bytes, CAST(sum(n) * 16 + count(*) * 4 AS BIGINT) AS gram_bytes, CAST(sum(n) * 16 + count(*) * 4 + (SELECT sum(strlen(line) + 1) FROM chunks) AS BIGINT) AS total_bytes FROM d")
def posting_sizes(spark, sf_dir):
    return stats.posting_sizes(index(spark, sf_dir))


@query(
    "index_totals",
    _GRAMS + "\nSELECT (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS names, (SELECT count(*) FROM documents) AS groups, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS deleted_groups, CAST(0 AS BIGINT) AS stale_groups, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks WHERE doc_id % 10 = 0) AS deleted_chunks, (SELECT count(DISTINCT gram) FROM postings) AS grams",
)
def index_totals(spark, sf_dir):
    return stats.totals(maintain.delete(index(spark, sf_dir), F.col("gid") % 10 == 0))


@query("chunks_per_group", "SELECT CAST(doc_id AS VARCHAR) AS group_name, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS chunk_count FROM documents")
def chunks_per_group(spark, sf_dir):
    return index(spark, sf_dir).groups.select("group_name", "chunk_count")


@query("group_chunks", _LINES + "\nSELECT line_no AS line, rune_off + 1 AS position, byte_off AS \"offset\", CAST(length(line) + 1 AS BIGINT) AS length, line AS text FROM chunks WHERE doc_id = 1")
def group_chunks(spark, sf_dir):
    return stats.group_chunks(index(spark, sf_dir), "1")


# Searches ---------------------------------------------------------------------------------------------


@query("search_word", _search_sql(["that"]))
def search_word(spark, sf_dir):
    return search.search(index(spark, sf_dir), ["that"]).select(*_SHOWN)


@query("search_multi", _search_sql(["the", "with"]))
def search_multi(spark, sf_dir):
    return search.search(index(spark, sf_dir), ["the", "with"]).select(*_SHOWN)


@query("search_multi_indexed", _search_sql(["the", "with"]))
def search_multi_indexed(spark, sf_dir):
    return search.search(index(spark, sf_dir, True), ["the", "with"]).select(*_SHOWN)


@query("search_phrase", _search_sql(["of the"]))
def search_phrase(spark, sf_dir):
    return search.search(index(spark, sf_dir), ["of the"]).select(*_SHOWN)


@query("search_filter", _search_sql(["the"], "AND regexp_matches(line, '[0-9]{3}')"))
def search_filter(spark, sf_dir):
    return search.search(index(spark, sf_dir), ["the"], pattern="[0-9]{3}").select(*_SHOWN)


_PARTIAL = _LINES + """
SELECT CAST(doc_id AS VARCHAR) AS group_name, doc_id AS gid, line_no AS line, rune_off AS start,
  CAST(strpos(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tion') - 1 AS BIGINT) AS "offset", line AS text
FROM chunks WHERE contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tion')"""


@query("search_partial", _PARTIAL)
def search_partial(spark, sf_dir):
    return search.search(index(spark, sf_dir), ["tion"], partial=True).select(*_SHOWN)


@query("search_limit", _search_sql(["the"], tail="QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rune_off) <= 2"))
def search_limit(spark, sf_dir):
    return search.search(index(spark, sf_dir), ["the"], limit=2).select(*_SHOWN)


_CANDIDATES = _GRAMS + """,
 found AS (SELECT doc_id, line_no FROM postings WHERE gram IN ({grams}) GROUP BY ALL HAVING count(*) = {n})
SELECT CAST(doc_id AS VARCHAR) AS group_name, doc_id AS gid, line_no AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, line AS text
FROM found JOIN chunks USING (doc_id, line_no)"""


def _listed(found: list[str]) -> str:
    return ", ".join(f"'{g}'" for g in found)


@query("search_candidates", _CANDIDATES.format(grams=_listed(G.query_grams(["the", "with"])), n=len(G.query_grams(["the", "with"]))))
def search_candidates(spark, sf_dir):
    return search.candidates(index(spark, sf_dir, True), ["the", "with"]).select("group_name", "gid", "line", "n", "text")


@query("search_candidates_grams", _CANDIDATES.format(grams="'.TH', 'ING'", n=2))
def search_candidates_grams(spark, sf_dir):
    codes = [G.parse_gram("0468", "hex"), G.code_of("ING")]
    return search.candidates(index(spark, sf_dir, True), grams=codes).select("group_name", "gid", "line", "n", "text")


@query("search_numbers", _search_sql(["that"], columns="CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR) AS output"))
def search_numbers(spark, sf_dir):
    return output.numbers(search.search(index(spark, sf_dir), ["that"])).select("output")


_ESCAPED = "replace(replace(replace(replace(replace(line, '\\', '\\\\'), '\"', '\\\"'), chr(9), '\\t'), chr(13), '\\r'), chr(10), '\\n')"


@query("search_format", _search_sql(["that"], columns=f"CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR) || ':' || {_ESCAPED} AS output"))
def search_format(spark, sf_dir):
    return output.formatted(search.search(index(spark, sf_dir), ["that"])).select("output")


@query(
    "search_sexp",
    _search_sql(["that"], columns=f"'(:filename \"' || CAST(doc_id AS VARCHAR) || '\" :line ' || line_no || ' :offset ' || \"offset\" || ' :text \"' || {_ESCAPED} || '\" :char-offset ' || rune_off || ' :percent 0.000000)' AS output"),
)
def search_sexp(spark, sf_dir):
    return output.formatted(search.search(index(spark, sf_dir), ["that"]), output.SEXP).select("output")


def _fuzzy_sql(args: list[str], percent: float, columns: str, tail: str = "") -> str:
    wanted = G.query_grams(args, True)
    return _GRAMS + f""",
 known AS (SELECT count(DISTINCT gram) AS k FROM postings WHERE gram IN ({_listed(wanted)})),
 scored AS (SELECT doc_id, line_no, count(*) / CAST({len(wanted)} AS DOUBLE) AS match FROM postings, known
   WHERE gram IN ({_listed(wanted)}) AND k = {len(wanted)} GROUP BY ALL HAVING count(*) / CAST({len(wanted)} AS DOUBLE) >= CAST({percent} AS DOUBLE) / 100)
SELECT {columns} FROM scored JOIN chunks USING (doc_id, line_no) {tail}"""


_FUZZY = 'CAST(doc_id AS VARCHAR) AS group_name, doc_id AS gid, line_no AS line, rune_off AS start, CAST(0 AS BIGINT) AS "offset", match * 100 AS percent, line AS text'


@query("fuzzy", _fuzzy_sql(["ther", "with"], 60, _FUZZY))
def fuzzy(spark, sf_dir):
    return search.fuzzy(index(spark, sf_dir, True), ["ther", "with"], 60).select(*_SHOWN, "percent")


@query("fuzzy_sorted", _fuzzy_sql(["ther", "with"], 60, "row_number() OVER (ORDER BY match, CAST(doc_id AS VARCHAR), rune_off) AS rank, CAST(doc_id AS VARCHAR) AS group_name, line_no AS line, match * 100 AS percent"))
def fuzzy_sorted(spark, sf_dir):
    # Ranks come from the range-partitioned global sort: offsets of the partitions plus the place inside.
    found = search.ordered(search.fuzzy(index(spark, sf_dir, True), ["ther", "with"], 60), "worst")
    # They are written with the rows, so that nothing below depends on a second run of the sort.
    placed = written(found.select("group_name", "line", "percent", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "sorted")
    from pyspark.sql import Window as W

    inside = placed.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("seq")))
    sizes = inside.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.orderBy("part")) - F.col("size")).select("part", "before")
    return inside.join(before, "part").select((F.col("at") + F.col("before")).cast("bigint").alias("rank"), "group_name", "line", "percent")


def _file_sql(args: list[str]) -> str:
    places = ", ".join(f"({k}, '{_word_regex(a)}')" for k, a in enumerate(args))
    return _LINES + f""",
 q(arg, re) AS (VALUES {places}),
 hits AS (SELECT doc_id, arg, line_no, rune_off, line, CAST(length(regexp_extract(line, '{_word_regex(args[0])}', 1)) AS BIGINT) AS o0, {", ".join(f"CAST(length(regexp_extract(line, '{_word_regex(a)}', 1)) AS BIGINT) AS p{k}" for k, a in enumerate(args))} FROM chunks, q
   WHERE {" OR ".join(f"(arg = {k} AND regexp_matches(line, '{_word_regex(a)}'))" for k, a in enumerate(args))}),
 placed AS (SELECT *, CASE {" ".join(f"WHEN arg = {k} THEN p{k}" for k in range(len(args)))} END AS place, count(DISTINCT arg) OVER (PARTITION BY doc_id) AS args FROM hits)
SELECT CAST(doc_id AS VARCHAR) AS group_name, doc_id AS gid, line_no AS line, rune_off AS start, place AS "offset", line AS text FROM placed
WHERE args = {len(args)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rune_off, place) = 1"""


@query("file_search", _file_sql(["the", "with"]))
def file_search(spark, sf_dir):
    return search.file_search(index(spark, sf_dir), ["the", "with"]).select(*_SHOWN)


@query("file_search_indexed", _file_sql(["the", "with"]))
def file_search_indexed(spark, sf_dir):
    return search.file_search(index(spark, sf_dir, True), ["the", "with"]).select(*_SHOWN)


def stored(spark: SparkSession, sf_dir: str) -> Index:
    """An index of the documents, saved and loaded again."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index(spark, sf_dir).save(path)
    return Index.load(spark, path)


@query("stored_search", _search_sql(["the", "with"]))
def stored_search(spark, sf_dir):
    return search.search(stored(spark, sf_dir), ["the", "with"]).select(*_SHOWN)


@query("stored_search_rare", _search_sql(["idiot"]))
def stored_search_rare(spark, sf_dir):
    return search.search(stored(spark, sf_dir), ["idiot"]).select(*_SHOWN)


@query("stored_file_search", _file_sql(["idiot", "clown"]))
def stored_file_search(spark, sf_dir):
    return search.file_search(stored(spark, sf_dir), ["idiot", "clown"]).select(*_SHOWN)


@query("stored_fuzzy", _fuzzy_sql(["ther", "with"], 60, _FUZZY))
def stored_fuzzy(spark, sf_dir):
    return search.fuzzy(stored(spark, sf_dir), ["ther", "with"], 60).select(*_SHOWN, "percent")


@query("sql_search", _search_sql(["that"], columns="CAST(doc_id AS VARCHAR) AS group_name, doc_id AS gid, line_no AS line, rune_off AS start, line AS text"))
def sql_search(spark, sf_dir):
    sql.register(spark, index(spark, sf_dir, True))
    return spark.sql("SELECT group_name, gid, line, start, text FROM quarry_search('that')")


@query("sql_grams", _GRAMS + f"\nSELECT doc_id AS gid, line_no AS line, {_code_sql('gram')} AS code, gram FROM postings")
def sql_grams(spark, sf_dir):
    sql.register(spark, index(spark, sf_dir))
    return spark.sql("SELECT gid, line, gram_code(gram) AS code, gram_text(gram_code(gram)) AS gram FROM (SELECT gid, line, explode_outer(grams) AS gram FROM (SELECT gid, line, word_grams(text) AS grams FROM quarry_chunks)) WHERE gram IS NOT NULL")


@query("file_list", "SELECT CAST(doc_id AS VARCHAR) AS group_name, lower(CAST(doc_id AS VARCHAR)) AS folded FROM documents WHERE doc_id % 10 <> 0")
def file_list(spark, sf_dir):
    return stats.file_list(maintain.delete(index(spark, sf_dir), F.col("gid") % 10 == 0))


# Maintenance ------------------------------------------------------------------------------------------


@query("delete_then_search", _search_sql(["the", "with"], "AND doc_id % 10 <> 0"))
def delete_then_search(spark, sf_dir):
    return search.search(maintain.delete(index(spark, sf_dir), F.col("gid") % 10 == 0), ["the", "with"]).select(*_SHOWN)


@query("compact_postings", _GRAMS + f"\nSELECT {_code_sql('gram')} AS gram, count(*) AS chunks FROM postings WHERE doc_id % 10 <> 0 GROUP BY ALL")
def compact_postings(spark, sf_dir):
    return stats.gram_df(maintain.compact(maintain.delete(index(spark, sf_dir, True), F.col("gid") % 10 == 0)))


_OLD = "timestamp '2024-01-01 00:00:00'"


def _timed(spark, sf_dir) -> tuple[Index, DataFrame]:
    """An index of 2024-01-01 and the files later: every seventh is gone, every third changed."""
    docs = documents(spark, sf_dir).withColumn("last_changed", F.expr(_OLD))
    now = docs.filter("gid % 7 <> 0").withColumn("last_changed", F.when(F.col("gid") % 3 == 0, F.col("last_changed") + F.expr("interval 1 hour")).otherwise(F.col("last_changed")))
    return Index.build(docs, postings=False), now


@query("delete_then_input", _search_sql(["the", "with"], columns='CAST(doc_id AS VARCHAR) AS group_name, line_no AS line, "offset"'))
def delete_then_input(spark, sf_dir):
    return search.search(_again(spark, sf_dir), ["the", "with"]).select("group_name", "line", "offset")


@query("compact_after_reinput", _search_sql(["the", "with"], columns='CAST(doc_id AS VARCHAR) AS group_name, line_no AS line, "offset"'))
def compact_after_reinput(spark, sf_dir):
    return search.search(maintain.compact(_again(spark, sf_dir)), ["the", "with"]).select("group_name", "line", "offset")


def _again(spark, sf_dir) -> Index:
    """Every third file is input, deleted and input again with the same time."""
    docs = documents(spark, sf_dir).select("group_name", F.expr(_OLD).alias("last_changed"), "text")
    made = maintain.put(Index.empty(spark), docs)
    return maintain.put(maintain.delete(made, F.col("group_name").cast("bigint") % 3 == 0), docs)


@query("delete_then_chunk", "SELECT 'mine' AS group_name, CAST(1 AS BIGINT) AS chunk_no, '02' AS data")
def delete_then_chunk(spark, sf_dir):
    made = maintain.add_chunk(Index.empty(spark), "mine", ["ABC"], b"\x01")
    made = maintain.add_chunk(maintain.delete(made, F.col("group_name") == "mine"), "mine", ["ABC"], b"\x02")
    found = search.candidates(maintain.compact(made), grams=[G.code_of("ABC")])
    return found.select("group_name", "chunk_no", F.lower(F.hex("data")).alias("data"))


@query("update_plan", "SELECT CAST(doc_id AS VARCHAR) AS group_name, CASE WHEN doc_id % 7 = 0 THEN 'delete' ELSE 'input' END AS action, false AS org FROM documents WHERE doc_id % 7 = 0 OR doc_id % 3 = 0")
def update_plan(spark, sf_dir):
    built, now = _timed(spark, sf_dir)
    return maintain.update_plan(built.groups, now)


@query("update_then_search", _search_sql(["the", "with"], "AND doc_id % 7 <> 0", 'CAST(doc_id AS VARCHAR) AS group_name, line_no AS line, "offset"'))
def update_then_search(spark, sf_dir):
    built, now = _timed(spark, sf_dir)
    return search.search(maintain.maintain(built, now), ["the", "with"], use_index=False).select("group_name", "line", "offset")


@query("stale_groups", "SELECT CAST(doc_id AS VARCHAR) AS group_name, CASE WHEN doc_id % 7 = 0 THEN 'NOT AVAILABLE' ELSE 'CHANGED' END AS status FROM documents WHERE doc_id % 7 = 0 OR doc_id % 3 = 0")
def stale_groups(spark, sf_dir):
    built, now = _timed(spark, sf_dir)
    return stats.stale_groups(built, now).select("group_name", "status")


@query("group_status", "SELECT CAST(doc_id AS VARCHAR) AS group_name, false AS org, CASE WHEN doc_id % 10 = 0 THEN 'DELETED' WHEN doc_id % 7 = 0 THEN 'NOT AVAILABLE' WHEN doc_id % 3 = 0 THEN 'CHANGED' ELSE '' END AS status FROM documents")
def group_status(spark, sf_dir):
    built, now = _timed(spark, sf_dir)
    return stats.group_status(maintain.delete(built, F.col("gid") % 10 == 0), now)


@query("search_skip_stale", _search_sql(["the", "with"], "AND doc_id % 7 <> 0 AND doc_id % 3 <> 0"))
def search_skip_stale(spark, sf_dir):
    built, now = _timed(spark, sf_dir)
    return search.search(search.fresh(built, now, "skip"), ["the", "with"]).select(*_SHOWN)


@query("empty_groups", "SELECT group_name, chunk_count FROM (SELECT CAST(doc_id AS VARCHAR) AS group_name, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS chunk_count FROM documents UNION ALL SELECT 'notes', CAST(0 AS BIGINT))")
def empty_groups(spark, sf_dir):
    names = spark.createDataFrame([("notes",), ("1",), ("notes",)], "group_name string")
    return maintain.add_empty(index(spark, sf_dir), names).groups.select("group_name", "chunk_count")


@query("custom_chunk", "SELECT 'mine' AS group_name, CAST(1 AS BIGINT) AS chunk_no, CAST(1 AS BIGINT) AS n, 'cafe' AS data")
def custom_chunk(spark, sf_dir):
    made = maintain.add_chunk(Index.empty(spark), "mine", ["TH.", "ABC"], bytes.fromhex("cafe"))
    return search.candidates(made, grams=[G.code_of("ABC"), G.code_of("TH.")]).select("group_name", "chunk_no", "n", F.lower(F.hex("data")).alias("data"))


@query("chunk_data", "SELECT CAST(1 AS BIGINT) AS chunk_no, 'cafe' AS data UNION ALL SELECT 2, 'beef'")
def chunk_data(spark, sf_dir):
    made = maintain.add_chunk(Index.empty(spark), "mine", ["TH."], bytes.fromhex("cafe"))
    made = maintain.add_chunk(made, "mine", ["a308"], bytes.fromhex("beef"), "hex")
    return maintain.chunk_data(made, "mine").select("chunk_no", F.lower(F.hex("data")).alias("data"))


# Scalars ----------------------------------------------------------------------------------------------


def _varint_sql(value: str) -> str:
    forms = " ".join(f"WHEN v < {1 << (4 + 8 * more)} THEN '{0x7 + more:x}' || lpad(lower(hex(v)), {2 * more + 1}, '0')" for more in range(1, 8))
    return f"SELECT doc_id AS gid, CASE WHEN v < 128 THEN lpad(lower(hex(v)), 2, '0') {forms} ELSE 'f0' || lpad(lower(hex(v)), 16, '0') END AS varint FROM (SELECT doc_id, {value} AS v FROM documents)"


@query("ordered_varint", _varint_sql("CAST((doc_id + 1) * pow(2, doc_id % 46) AS BIGINT)"))
def ordered_varint(spark, sf_dir):
    value = F.col("gid") + 1
    return documents(spark, sf_dir).select("gid", output.varint_hex((value * F.pow(F.lit(2.0), F.pmod("gid", F.lit(46))).cast("bigint"))).alias("varint"))


@query("highlight", _LINES + "\nSELECT doc_id AS gid, line_no AS line, regexp_replace(line, '(?i)(tion)', '[\\1]', 'g') AS text FROM chunks")
def highlight(spark, sf_dir):
    return line_chunks(documents(spark, sf_dir)).select("gid", "line", output.highlight(F.col("text"), "tion").alias("text"))


ORG_SAMPLE = "* Head one\nPara line a\npara line b\n\n- item a\n  continued\n- item b\n| a | b |\n#+TITLE: x\n:PROPERTIES:\n:ID: 1\n:END:\n#+begin_src sh\necho hi\n#+end_src\nafter text\n"


_GOLDEN = [
    (1, "HEADLINE", "* Head one"),
    (2, "PARAGRAPH", "Para line a\npara line b"),
    (5, "LIST_ITEM", "- item a\n  continued"),
    (7, "LIST_ITEM", "- item b"),
    (8, "TABLE_LINE", "| a | b |"),
    (9, "KEYWORD", "#+TITLE: x"),
    (10, "DRAWER", ":PROPERTIES:\n:ID: 1\n:END:"),
    (13, "BLOCK", "#+begin_src sh\necho hi\n#+end_src"),
    (16, "PARAGRAPH", "after text"),
]


def _golden_sql() -> str:
    rows = ", ".join(f"({line}, '{kind}', replace('{text}', '~', chr(10)))" for line, kind, text in ((n, k, t.replace("\n", "~")) for n, k, t in _GOLDEN))
    sample = ORG_SAMPLE.replace("\n", "~")
    return f"SELECT CAST(1 AS BIGINT) AS gid, CAST(l AS BIGINT) AS line, k AS elem_type, CAST(strpos(replace('{sample}', '~', chr(10)), t) - 1 AS BIGINT) AS rune_off, CAST(length(t) AS BIGINT) AS rune_len, t AS text FROM (VALUES {rows}) AS v(l, k, t)"


@query("org_chunks", _golden_sql())
def org_chunks_query(spark, sf_dir):
    return org_chunks(spark.createDataFrame([(1, ORG_SAMPLE)], "gid bigint, text string")).select("gid", "line", "elem_type", "rune_off", "rune_len", "text")


_KIND_SQL = """CASE WHEN ltrim(line, ' ' || chr(9)) = '' THEN 'BLANK' WHEN starts_with(line, '*') THEN 'HEADLINE'
  WHEN regexp_matches(line, '(?i)^[ \\t]*\\[fn:[^\\]]') THEN 'FOOTNOTE' WHEN regexp_matches(line, '^[ \\t]*-----') THEN 'HR'
  WHEN regexp_matches(line, '(?i)^[ \\t]*:[a-z0-9_]+[ \\t]*:') THEN 'DRAWER'
  WHEN regexp_matches(line, '(?s)^[ \\t]*#\\+.') THEN CASE WHEN regexp_matches(line, '(?i)^[ \\t]*#\\+begin_[a-z0-9_]+') THEN 'BLOCK'
    WHEN regexp_matches(line, '(?i)^[ \\t]*#\\+begin:') THEN 'DYNBLOCK' WHEN regexp_matches(line, '^[ \\t]*#\\+[a-zA-Z0-9_]+:') THEN 'KEYWORD' ELSE 'PARAGRAPH' END
  WHEN regexp_matches(line, '(?i)^[ \\t]*(?:[+-]|(?:[0-9]*|[a-z])\\.)(?:[ \\t]|\\z)') THEN 'LIST_ITEM'
  WHEN regexp_matches(line, '^[ \\t]*(?:\\||\\+-)') THEN 'TABLE_LINE' ELSE 'PARAGRAPH' END"""
#: What the lines are given in front, so that all kinds occur.
_FRONTS = ["", "* ", "  - ", "| ", ":PROPERTIES:", "#+TITLE: ", " [fn:1] ", "-----", "#+begin_src ", "#+BEGIN: ", "1. ", "b. ", "   ", "# ", "#+", "+-", "+", " * "]


@query("line_kinds", _LINES.replace("a[line_no] AS line,", f"[{', '.join(repr(f) for f in _FRONTS)}][line_no % {len(_FRONTS)} + 1] || a[line_no] AS line,") + f"\nSELECT doc_id AS gid, line_no AS line, {_KIND_SQL} AS kind FROM chunks")
def line_kinds(spark, sf_dir):
    front = F.element_at(F.array(*map(F.lit, _FRONTS)), (F.pmod("line", F.lit(len(_FRONTS))) + 1).cast("int"))
    return line_chunks(documents(spark, sf_dir)).select("gid", "line", line_kind(F.concat(front, "text")).alias("kind"))


# Lines in a row are paragraphs, other kinds stand alone; the documents open no block or drawer, and indent nothing.
_ORG_SQL = f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
 c AS (SELECT doc_id, text, unnest(range(1, len(a) + 1)) AS n, a FROM l),
 p AS (SELECT doc_id, text, n, a[n] AS line, CAST(coalesce(sum(length(a[n]) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM c),
 k AS (SELECT *, {_KIND_SQL} AS kind FROM p),
 i AS (SELECT *, CASE WHEN kind = 'PARAGRAPH' THEN n - row_number() OVER (PARTITION BY doc_id, kind ORDER BY n) ELSE -n END AS island FROM k WHERE kind <> 'BLANK'),
 e AS (SELECT doc_id, kind, island, min(n) AS line, min(off) AS start, any_value(text) AS text, max(off + length(line)) AS stop FROM i GROUP BY ALL),
 t AS (SELECT doc_id, line, kind, start, rtrim(substr(text, start + 1, stop - start), ' ' || chr(9) || chr(10)) AS piece FROM e),
 w AS (SELECT *, unnest(regexp_extract_all(piece, '[0-9A-Za-z]+')) AS word FROM t),
 g AS (SELECT DISTINCT doc_id, line, kind, start, piece, substr('.' || upper(word) || '.', q, 3) AS gram FROM (SELECT *, unnest(range(1, len(word) + 1)) AS q FROM w))
SELECT doc_id AS gid, line, kind AS elem_type, start AS rune_off, CAST(length(piece) AS BIGINT) AS rune_len, CAST(count(*) AS INTEGER) AS gram_count FROM g GROUP BY ALL"""


@query("org_documents", _ORG_SQL)
def org_documents(spark, sf_dir):
    return org_chunks(documents(spark, sf_dir)).select("gid", "line", "elem_type", "rune_off", "rune_len", "gram_count")
