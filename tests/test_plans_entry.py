"""Driver contract, oracle agreement for every registered query, and plan shape."""

import re

import pytest

import __spark_entry__ as E
from check_oracles import compare, duck
from georisk.functions.grid import GridSpec
from georisk.plans import inspect as I
from georisk.queries import QUERIES
from georisk.sources.incidents import incidents_from_tables

from conftest import SF0001


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.dtypes == [("Count", "bigint"), ("Box", "int"), ("Month", "int"), ("DayOfWeekNum", "int"),
                         ("DayPeriod", "int")]
    assert df.count() == 3360


def test_registry_shape():
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert len(qs) >= 45 and len(oracles) >= 38


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_and_stays_in_jvm(spark, con, name):
    ok, msg = compare(spark, con, SF0001, name, E.queries()[name], E.oracle_sql().get(name))
    assert ok is not False, msg
    assert not I.has_python_eval(E.queries()[name](spark, SF0001))


def test_flagship_plan(spark):
    df = QUERIES["box_agg"](spark, SF0001)
    plan = I.plan_text(df, "simple")
    assert I.count_exchanges(df) == 1
    assert "partial_count" in plan
    schemas = I.read_schemas(df)
    assert len(schemas) == 1
    cols = re.findall(r"(\w+):", schemas[0])
    assert set(cols) == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"}


def _scans(df, table):
    return I.plan_text(df, "simple").count(f"{table}.parquet")


def test_metrics_scan_once(spark):
    for name in ("confusion_matrix", "baseline_predictions", "stage_counts"):
        assert _scans(QUERIES[name](spark, SF0001), "lineitem") == 1, name


def test_scoring_reads_requests_once_and_broadcasts(spark):
    df = QUERIES["score_requests"](spark, SF0001)
    plan = I.plan_text(df, "simple")
    assert _scans(df, "events") == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_bbox_prefilter_reaches_parquet(spark, tmp_path):
    g = GridSpec()
    path = str(tmp_path / "incidents.parquet")
    incidents_from_tables(spark, SF0001, keep_out_of_bounds=True).write.parquet(path)
    df = spark.read.parquet(path).filter(g.prefilter("X", "Y") & g.in_bounds("X", "Y")).select("Box")
    pushed = " ".join(I.pushed_filters(df))
    assert "GreaterThanOrEqual(X" in pushed and "LessThanOrEqual(Y" in pushed
    exact = spark.read.parquet(path).filter(g.in_bounds("X", "Y")).count()
    assert df.count() == exact


def test_parquet_sink_prunes_years_and_pushes_box(spark, tmp_path):
    from georisk.sources import parquet as PQ
    g = GridSpec()
    path = str(tmp_path / "pq")
    everything = incidents_from_tables(spark, SF0001, keep_out_of_bounds=True).drop("in_bounds")
    PQ.write_incidents(everything, path)
    df = PQ.read_incidents(spark, path, g, years=(1994, 1995))
    plan = I.plan_text(df, "formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*Year", plan)
    assert "GreaterThanOrEqual(X" in " ".join(I.pushed_filters(df))
    want = incidents_from_tables(spark, SF0001).filter("year(Timestamp) BETWEEN 1994 AND 1995")
    assert df.count() == want.count() > 0
