"""Properties of catalogue results on the sf0.001 tables."""

from collections import defaultdict

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _sums(rows, key, val):
    acc = defaultdict(float)
    for r in rows:
        if r[val] is not None:
            acc[tuple(r[k] for k in key)] += float(r[val])
    return acc


@pytest.mark.parametrize("name,key,val", [
    ("type_shares", ["snapshot_date"], "share"),
    ("license_shares", ["snapshot_date", "org_group"], "share_n"),
    ("presence_outcome", ["snapshot_date"], "presence_share"),
    ("presence_outcome", ["snapshot_date"], "outcome_share"),
    ("topn_sankey", ["snapshot_date"], "value_share"),
    ("country_top_rest", ["snapshot_date"], "share"),
])
def test_shares_sum_to_one(spark, name, key, val):
    rows = E.queries()[name](spark, SF).collect()
    sums = _sums(rows, key, val)
    assert sums
    for k, v in sums.items():
        assert v == pytest.approx(1.0, abs=1e-4) or v == 0.0, (k, v)


def test_pool_always_contains_latest_and_smoothing_keeps_fresh_weeks(spark):
    sel = [r[0] for r in E.queries()["snapshot_every_nth"](spark, SF).collect()]
    latest = max(r[0] for r in E.queries()["frozen_snapshots"](spark, SF).select("snapshot_date").collect())
    assert latest in sel
    frozen = {r["snapshot_date"] for r in E.queries()["frozen_snapshots"](spark, SF).collect() if r["frozen"]}
    sm = E.queries()["smoothed_series"](spark, SF).collect()
    raw = {(r["snapshot_date"], r["org_type"]): r for r in E.queries()["type_vectors"](spark, SF).collect()}
    for r in sm:
        if r["snapshot_date"] not in frozen:
            assert r["lk"] == raw[(r["snapshot_date"], r["org_type"])]["lk"]


def test_concentration_is_monotone(spark):
    for r in E.queries()["concentration"](spark, SF).collect():
        if r["c1"] is not None:
            assert r["c1"] <= r["c10"] <= r["c50"] <= 1
