"""Physical-plan properties that matter at scale."""

import pytest
from pyspark.sql import functions as F

from snapdeck.operators import ranking, snapshots
from snapdeck.plans.catalog import QUERIES
from snapdeck.sources import driver

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    p = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_topn_prunes_before_shuffle(spark):
    p = _plan(ranking.topn_items(driver.panel(spark, SF), n=10))
    assert "WindowGroupLimit" in p


def test_dims_are_broadcast_and_columns_pruned(spark):
    df = driver.panel_plan(spark, SF).select("snapshot_date", "author", "downloads")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in p
    # orders is read with only the columns the projection needs
    scans = [ln for ln in p.splitlines() if "FileScan parquet" in ln and "o_custkey" in ln]
    assert scans and all("o_orderpriority" not in ln and "o_orderstatus" not in ln for ln in scans)


def test_snapshot_selection_prunes_partitions(spark):
    p = driver.panel(spark, SF)
    sel = snapshots.restrict(p, p.select("snapshot_date").distinct().filter(F.col("snapshot_date") >= "2001-01-01"))
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "dynamicpruning" in plan.lower()


def test_id_lookup_pushed_to_scan(spark):
    p = driver.panel(spark, SF).filter(F.col("id") == "Customer#000000007")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,Customer#000000007)]" in _plan(p)


TOP_N_QUERIES = ["topn_items", "topn_accounts", "account_ranks", "weekly_spikes", "growth_since_baseline",
                 "ever_in_pool", "topn_membership", "explore", "rank_accounts", "top_share", "impact_top", "explore_paper", "org_pool",
                 "volume_share"]


@pytest.mark.parametrize("name", TOP_N_QUERIES)
def test_top_n_queries_use_window_group_limit(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_joins(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def _static_plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _plan(df())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["weekly_spikes", "newly_added", "newly_added_cumulative", "latest_attrs", "series_bounds"])
def test_no_exchange_on_id(spark, name):
    p = _static_plan(spark, lambda: QUERIES[name](spark, SF))
    assert "hashpartitioning(_id#" not in p and "Bucketed: true" in p


def test_growth_has_no_window_over_the_panel(spark):
    p = _static_plan(spark, lambda: QUERIES["growth_since_baseline"](spark, SF))
    windows = [ln for ln in p.splitlines() if "Window [" in ln]
    assert windows and all("windowspecdefinition(snapshot_date#" in ln for ln in windows)


def test_lookup_by_id_skips_row_groups(spark, tmpdir_path):
    from snapdeck.sources.by_id import write_by_id
    # ids in no order by _id, small row groups, no dictionary that could stand in for the filter
    rows = spark.range(60_000).select(F.xxhash64("id").alias("_id"), F.lit(0).alias("t"), F.concat(F.lit("name/"), "id").alias("id"))
    small = {"parquet.block.size": "65536", "parquet.page.size": "8192", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1000"}
    with_filter = write_by_id(rows, f"{tmpdir_path}/a", "lookup_a", rows_per_bucket=20_000, options=small)
    without = write_by_id(rows, f"{tmpdir_path}/b", "lookup_b", lookup=(), rows_per_bucket=20_000, options=small)

    def scanned(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            out = df.filter(F.col("id") == "name/4711")
            assert out.count() == 1
            plan = out._jdf.queryExecution().executedPlan()
            out._jdf.collectToPython()
            return plan.collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scanned(without) == 60_000 and scanned(with_filter) < 30_000
