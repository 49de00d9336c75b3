"""Registered queries on the driver's tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from dalyworks import runtime
from dalyworks.workload import oracle, queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "enrich_dims", "nullsafe_join", "cause_totals", "diff_national", "na_sum", "who_region_rollup", "ihme_region_diff",
    "income_costs", "map_join", "region_pct_gdp", "region_bars", "bins_dalys", "inputs_stack", "table1_indexed", "table2",
    "table_appendix", "headline_metrics", "mc_ci", "mc_rr_grid", "mc_walker", "mc_wide_long", "region_choropleth",
    "region_full_join", "region_members", "scan_gdp", "window_totals", "report_table1", "report_appendix",
    "workbook_dims", "asof_indicator", "interval_overlap", "mc_place_range", "mc_sketch_runs",
    "burden_cube", "yearly_change", "largest_places", "distinct_customers",
)
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert len(queries.queries()) >= 75


@needs_data
@pytest.mark.parametrize("key", SAMPLE)
def test_query_matches_sql(spark, key):
    assert compare(spark, connect(FOLDER), FOLDER, key) == ""


@needs_data
def test_entry(spark):
    table = entry.entry(spark)
    slices = table.select("sex_id", "year").distinct().count()
    assert slices > 2 and 50 * slices < table.count() <= 60 * slices


@needs_data
def test_line_items_are_scanned_once(spark):
    """What follows the cells reads the staged cells, not the line items."""
    plan = entry.queries()["headline_metrics"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "l_extendedprice" not in plan


@needs_data
@pytest.mark.parametrize("key", ["region_full_join", "ihme_region_diff", "table2", "headline_metrics"])
def test_no_full_outer_join(spark, key):
    """A full outer join brings all rows without a code into one task."""
    plan = queries.queries()[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan


@needs_data
def test_staged_tables_go_with_their_scope(spark):
    root = os.path.join(runtime.checkpoint_root(spark).removeprefix("file:"), "dalyworks")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with runtime.staging(spark):
        assert queries.queries()["table1"](spark, FOLDER).count() > 0
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before


@needs_data
def test_report_scans_the_line_items_once(spark, monkeypatch):
    """Every output starts from staged tables."""
    from dalyworks.plans import report

    context = queries.Context(spark, FOLDER)
    made = report.report(context.inputs, 1e2, 1e6)
    for df in (made.table1, made.table2, made.appendix, made.headlines, *made.charts.values()):
        assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString()
