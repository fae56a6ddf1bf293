import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from windprint.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ("source_area_80", "tail_share", "cover_share", "window_stats", "wind_rose_cube", "track_touchdowns", "interp4", "case_params", "stream_k0k1")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
