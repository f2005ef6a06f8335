"""The engine from SQL: views of an index, functions over texts and grams, and a search as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarrytext.functions.grams import BASE
from quarrytext.operators.index import Index

_BORDERED = "concat('.', upper(array_join(regexp_extract_all(t, '([0-9A-Za-z]+)', 1), '.')), '.')"
_ASCII = lambda k: f"ascii(substr(upper(g), {k}, 1))"
_PLACE = lambda k: f"CASE WHEN {_ASCII(k)} < 48 THEN 0 WHEN {_ASCII(k)} < 65 THEN {_ASCII(k)} - 47 ELSE {_ASCII(k)} - 54 END"
_DIGIT = lambda power: f"c DIV {BASE**power} % {BASE}"
_CHAR = lambda power: f"char(CASE WHEN {_DIGIT(power)} = 0 THEN 46 WHEN {_DIGIT(power)} < 11 THEN {_DIGIT(power)} + 47 ELSE {_DIGIT(power)} + 54 END)"

#: Signature and body of each function.
FUNCTIONS = {
    "word_grams(t STRING) RETURNS ARRAY<STRING>": f"array_distinct(regexp_extract_all({_BORDERED}, '(?=(.[0-9A-Z].))', 1))",
    "partial_grams(t STRING) RETURNS ARRAY<STRING>": f"array_distinct(regexp_extract_all({_BORDERED}, '(?=([0-9A-Z]{{3}}))', 1))",
    "gram_code(g STRING) RETURNS INT": f"CAST((({_PLACE(1)}) * {BASE} + ({_PLACE(2)})) * {BASE} + ({_PLACE(3)}) AS INT)",
    "gram_text(c INT) RETURNS STRING": f"concat({_CHAR(2)}, {_CHAR(1)}, {_CHAR(0)})",
    "has_word(t STRING, term STRING) RETURNS BOOLEAN": r"t RLIKE concat(r'(?is)(?:^|[^0-9A-Za-z])\Q', replace(term, r'\E', r'\E\\E\Q'), r'\E(?:[^0-9A-Za-z]|\z)')",
}


def register(spark: SparkSession, index: Index | None = None, prefix: str = "quarry") -> None:
    """Make the functions callable from SQL, and with an index its views ``<prefix>_groups``, ``_chunks`` and
    ``_postings`` and the table function ``<prefix>_search(term)``."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    if index is None:
        return
    for name, table in (("groups", index.groups), ("chunks", index.chunks), ("postings", index.with_postings().postings)):
        table.createOrReplaceTempView(f"{prefix}_{name}")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_search(term STRING)
        RETURNS TABLE (group_name STRING, gid BIGINT, line BIGINT, start BIGINT, text STRING)
        RETURN SELECT g.group_name, c.gid, c.line, c.rune_off, c.text FROM {prefix}_chunks c JOIN {prefix}_groups g ON c.gid = g.gid
        WHERE NOT g.deleted AND has_word(c.text, term)"""
    )
