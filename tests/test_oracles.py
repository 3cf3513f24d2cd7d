"""Every query with SQL against DuckDB on the smallest tables, and some on larger ones, rows and values."""

import math
import os
from collections import Counter

import duckdb
import pytest

from wayline.plans import catalog

ROOT = "/root/testdata"
#: Queries whose values lie near edges of rounding, or whose state runs long: also on ten times the rows.
LARGER = ["phase_unwrap", "nll_huber", "output_smoother", "gnss_state", "rejection_resets", "synced_table", "header_key", "csv_quoting", "multi_key_order", "calibration_table", "outage_log", "emission_scores", "matcher_rate", "history_lookup"]


@pytest.fixture(scope="session")
def ducks():
    out = {}
    for sf in ("sf0.001", "sf0.01"):
        out[sf] = duckdb.connect()
        for f in os.listdir(f"{ROOT}/{sf}"):
            out[sf].sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{ROOT}/{sf}/{f}'")
    return out


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name, sf", [(n, "sf0.001") for n in sorted(catalog.queries())] + [(n, "sf0.01") for n in LARGER])
def test_query(spark, ducks, name, sf):
    df = catalog.queries()[name](spark, f"{ROOT}/{sf}")
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    sql = catalog.oracles().get(name)
    if sql is None:
        assert got
        return
    rel = ducks[sf].sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert len(got) == len(want) and not (d := Counter(map(str, got)) - Counter(map(str, want))), list(d)[:3]
