"""The driver's contract on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the given tables aren't here")
def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 5
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 100


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the given tables aren't here")
@pytest.mark.parametrize("name", ["total_sales", "agg_median_by_segment", "trend_week", "filter_ne", "profile_counts_orders", "top3_per_dimension", "clean_all", "keyword_topk"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{TABLES}/{f}'")
    got = entry.queries()[name](spark, TABLES)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)
