"""Registered queries against their SQL twins, on the smallest tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shortlist.catalog import load, sqlviews
from shortlist.operators import metrics
from shortlist.sources import tables
from tools.check_oracles import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "slice_report", "band_pairs", "consensus_rerank", "miss_anatomy", "ensemble_report",
    "split_group", "weighted_draws", "collision_profile", "tanimoto_topk", "threshold_sweep",
    "checkpoint_rule", "registration_score",
)
NAMES = sorted(load()) if os.environ.get("SHORTLIST_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    entry = load()[name]
    df = entry.run(spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if entry.sql is None:
        return
    cur = con.execute(entry.sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, cur.fetchall())


def test_judged_rows_of_a_query_are_read_where_they_lie(spark):
    summary = metrics.query_summary(tables.queries(spark, FOLDER), tables.judged(spark, FOLDER))
    assert "Exchange hashpartitioning" not in summary._jdf.queryExecution().executedPlan().toString()


def test_runs_draw_by_their_own_digits(spark, con):
    sql = f"WITH {sqlviews.judged_views(tables.ALL_RUNS)} SELECT run, query_id, raw, ord FROM raw_c"
    got = tables.raw_candidates(spark, FOLDER, tables.ALL_RUNS).select("run", "query_id", "raw", "ord").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(sql).fetchall())
