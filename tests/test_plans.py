import os

import pytest

import __spark_entry__ as driver
from lonepoint import workload

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

PLANNED = [
    "single_pmcod", "single_slicing", "single_parallel", "single_advanced_vp", "single_2d_grid", "rk_psod",
    "rkws_sop", "point_status", "neighbor_histogram", "range_join_events", "topk_recent_neighbors", "dense_anti_join",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_joins(spark, name):
    plan = plan_of(workload.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(workload.QUERIES["single_pmcod"](spark, SF))
    schemas = {part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]}
    assert schemas <= {"event_id:bigint,value:double", "event_id:bigint"}


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 9 and {"e", "n_outliers"} == set(rows[0].asDict())


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(workload.QUERIES) - set(workload.ORACLE) == {"vantage_assign"}


ORACLE = [
    "window_membership", "slide_assign", "grid1d_assign", "dense_cells", "single_slicing", "single_2d_grid",
    "rk_sop", "rkws_psod", "expiry_schedule", "k_skyband", "k_skyband_long", "layered_skyband", "search_unbounded",
    "ball_meets", "vantage_meets",
]


@pytest.mark.parametrize("name", ORACLE)
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    result = con.execute(workload.ORACLE[name])
    names = [d[0] for d in result.description]
    expected = sorted(repr([v for _, v in sorted(zip(names, r))]) for r in result.fetchall())
    df = workload.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr([v for _, v in sorted(zip(df.columns, r))]) for r in df.collect())
    assert got == expected


@pytest.mark.parametrize("name", ["ball_meets", "vantage_meets"])
def test_places_are_found_once(spark, name):
    plan = plan_of(workload.QUERIES[name](spark, SF))
    assert "is_home" in plan and "ArrowEvalPython" not in plan and "_vd" not in plan


@pytest.mark.parametrize("name", ["topk_recent_per_band", "merge_recent_neighbors", "k_skyband", "k_skyband_long"])
def test_lists_need_no_pairs_of_a_join(spark, name):
    plan = plan_of(workload.QUERIES[name](spark, SF))
    assert "chunk" not in plan and "FlatMapGroupsInPandas" in plan
