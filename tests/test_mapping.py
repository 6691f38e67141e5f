"""The driver-table panel reaches the rules that the SQL comparison is meant to check."""

from pyspark.sql import functions as F

from snapdeck.plans.catalog import QUERIES, rejoined
from snapdeck.sources import driver

SF = "/root/testdata/sf0.001"


def _frozen(spark):
    return {str(r["snapshot_date"]) for r in QUERIES["frozen_snapshots"](spark, SF).filter("frozen").collect()}


def test_frozen_runs_are_found(spark):
    assert _frozen(spark) >= {m for run in driver.FROZEN_RUNS.values() for m in run}
    assert QUERIES["frozen_diff"](spark, SF).filter("side = 'unexpected'").count() > 0


def test_smoothing_changes_inner_runs_only(spark):
    p = rejoined(spark, SF)
    raw = p.groupBy("snapshot_date", "org_type").agg(F.sum("downloadsAllTime").alias("raw"))
    j = QUERIES["smoothed_series"](spark, SF).join(raw, ["snapshot_date", "org_type"])
    moved = {str(r[0]) for r in j.filter("dlat <> raw").select("snapshot_date").distinct().collect()}
    assert moved and moved <= _frozen(spark)
    assert "2001-08-01" not in moved  # a trailing run stays as it is


def test_all_time_stands_still_in_frozen_months(spark):
    p = driver.panel(spark, SF).filter(F.col("snapshot_date").isin("1998-02-01", "1998-04-01"))
    g = p.groupBy("_id").agg(F.countDistinct("downloadsAllTime").alias("d"), F.count(F.lit(1)).alias("n"))
    assert g.filter("n <> 2 OR d <> 1").count() == 0 and g.count() > 0


def test_missing_authors_and_pages(spark):
    p = driver.panel(spark, SF)
    assert p.filter(F.col("author").isNull()).count() > 0
    assert QUERIES["left_enrich"](spark, SF).filter("author IS NOT NULL AND followers IS NULL").count() > 0
    assert QUERIES["account_ranks"](spark, SF).filter(F.col("author").isNull()).count() > 0


def test_last_complete_snapshot_is_full(spark):
    assert QUERIES["top_latest"](spark, SF).count() > 5


def test_cards_keep_the_first_row_of_a_slug(spark):
    c = QUERIES["page_cards"](spark, "/root/testdata/sf0.01")
    assert c.count() > 10 and c.filter("org_type IS NULL").count() > 0 and c.filter("followers >= 1000000").count() > 0
    raw = driver.listing_pages(spark, "/root/testdata/sf0.01").filter(F.col("html").contains("followers"))
    assert raw.filter("page_id > 1000000000").count() > c.count()
