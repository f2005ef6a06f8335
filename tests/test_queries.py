"""Every registered query against DuckDB on the smallest tables, and laws between searches."""

import collections
import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__
from quarrytext.functions import grams as G
from quarrytext.operators import search
from quarrytext.operators.index import Index
from quarrytext.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def bag(table):
    names = sorted(table.column_names)
    return names, collections.Counter(map(repr, zip(*[table[n].to_pylist() for n in names])))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert bag(registry.QUERIES[name](spark, SF).toArrow()) == bag(duck.sql(registry.ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["the", "tion", "with", "ea", "die", "x", "of the", "é"]), min_size=1, max_size=3))
def test_index_and_scan_agree(spark, args):
    index = Index.build(registry.documents(spark, SF)).with_postings()
    for partial in (False, True):
        rows = [sorted(map(tuple, search.search(index, args, partial, use_index=u).select("gid", "line", "offset").collect())) for u in (True, False)]
        assert rows[0] == rows[1]
        held = {(r["gid"], r["line"]) for r in search.candidates(index, args, partial=partial).collect()}
        assert {(g, n) for g, n, _ in rows[0]} <= held
    if all(len(a) >= 3 and a.isascii() for a in args) and G.query_grams(args, True):
        word, part = (search.search(index, args, p, use_index=False).count() for p in (False, True))
        assert part >= word
