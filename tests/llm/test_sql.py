"""The operators that SQL can express, against DuckDB; all operators keep every row."""

import collections
import os

import duckdb
import pytest

from quarrytext.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    one, two = queries.QUERIES[name](spark, SF).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    names = sorted(one.column_names)
    assert names == sorted(two.column_names)
    bags = [collections.Counter(map(repr, zip(*[t[n].to_pylist() for n in names]))) for t in (one, two)]
    assert bags[0] == bags[1]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op2_passages"}))
def test_one_row_per_row(spark, name):
    source = "pages" if name.startswith("op4_") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
