"""The registered queries against their SQL on the smallest data, where the data is at hand."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import norm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SOME = ["tpch_q02", "tpch_q13", "tpch_q21", "exists_or_mark", "lateral_top1", "group_collect_list", "cte_nonlinear_delta", "relvar_replace_moves_end", "tx_rollback", "p1_found", "p2_found", "p5_found", "p5_report", "p6_found", "p6_akas"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    df = entry.queries()[name](spark, DATA)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert norm([tuple(r) for r in df.select(*cols).collect()]) == norm(rel.fetchall())
