"""The queries that have SQL against DuckDB, over whole tables."""

import os
from collections import Counter

import duckdb
import pytest

from wayline.llm.entry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    rel = c.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    assert Counter(rel.fetchall()) == Counter(tuple(r[n] for n in rel.columns) for r in df.collect())
