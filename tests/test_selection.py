"""Distributed selection against sorting."""

import math
import random

import pytest

from snapdeck.operators.selection import at_index, nearest, select_ranks, share


def _sorted_groups(rows):
    out = {}
    for k, v, w in rows:
        if v is not None:
            out.setdefault(k, []).append((v, w))
    return {k: sorted(x, key=lambda y: y[0]) for k, x in out.items()}


@pytest.mark.parametrize("per_octave", [1, 32])
def test_ranks_weights_and_tops(spark, per_octave):
    r = random.Random(1)
    draw = [lambda: r.randint(-50, 50), lambda: r.choice([0, 7, 7, 7]), lambda: r.randint(10 ** 6, 10 ** 9), lambda: int(10 ** r.uniform(0, 12))]
    # group "a" has most rows, one group is NULL, one has a single row, one no weight at all
    rows = [(k, d(), r.choice([None, 0, 1, 9, 1000])) for k, n in (("a", 3000), ("b", 200), (None, 150)) for d in draw for _ in range(n // 4)]
    rows += [("one", 5, 3), ("zero", 1, 0), ("zero", 2, None), ("b", None, 4)]
    df = spark.createDataFrame(rows, "k string, v long, w long").filter("v IS NOT NULL").repartition(3)
    groups = _sorted_groups(rows)
    qs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    got = {x.k: x for x in select_ranks(df, ["k"], "v", {f"q{i}": nearest(q) for i, q in enumerate(qs)}, per_octave=per_octave).collect()}
    assert got.keys() == groups.keys()
    for k, g in groups.items():
        values = [v for v, _ in g]
        assert (got[k].n, got[k].tot, got[k].sum_v, got[k].max_v) == (len(g), len(g), sum(values), values[-1])
        assert [got[k][f"q{i}"] for i in range(len(qs))] == [values[math.floor((len(g) - 1) * q + 0.5)] for q in qs]
    low = {x.k: x for x in select_ranks(df, ["k"], "v", {f"q{i}{s}": at_index(q, s == "b") for i, q in enumerate(qs) for s in "ab"}, per_octave=per_octave).collect()}
    for k, g in groups.items():
        for i, q in enumerate(qs):
            h = (len(g) - 1) * q
            assert (low[k][f"q{i}a"], low[k][f"q{i}b"]) == (g[math.floor(h)][0], g[math.ceil(h)][0])
    heavy = {x.k: x for x in select_ranks(df, ["k"], "v", {f"q{i}": share(q) for i, q in enumerate(qs)}, weight="w", per_octave=per_octave).collect()}
    for k, g in groups.items():
        total = sum(w or 0 for _, w in g)
        assert heavy[k].tot == total and heavy[k].n == len(g)
        for i, q in enumerate(qs):
            run, want = 0, None
            for v, w in g:
                run += w or 0
                if run >= total * q:
                    want = v
                    break
            assert heavy[k][f"q{i}"] == want
    needs = {"t1": lambda n: n * 0 + 1, "t7": lambda n: n * 0 + 7, "half": lambda n: (n + 1) / 2, "all": lambda n: n}
    tops = {x.k: x for x in select_ranks(df, ["k"], "v", needs, top=True, per_octave=per_octave).collect()}
    for k, g in groups.items():
        down = [v for v, _ in g][::-1]
        if len(down) >= 7:
            assert tops[k].t7 == sum(down[:7])
        assert (tops[k].t1, tops[k].half, tops[k]["all"]) == (down[0], sum(down[:(len(down) + 1) // 2]), sum(down))


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert select_ranks(df, [], "v", {"m": nearest(0.5)}).collect()[0].m == 50.0
    empty = df.filter("v < 0")
    assert select_ranks(empty.selectExpr("1 k", "v"), ["k"], "v", {"m": nearest(0.5)}).count() == 0


def test_only_wanted_slices_are_ordered(spark):
    """The second pass hands on the rows of the median's slice, not the group."""
    df = spark.range(1, 50_001).selectExpr("1 k", "id v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = select_ranks(df, ["k"], "v", {"m": nearest(0.5)})
        assert out.collect()[0].m == 25_001
        plan = out._jdf.queryExecution().executedPlan()
        out._jdf.collectToPython()
        text = plan.toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Window" in text
    rows = []

    def walk(node):
        if node.nodeName() == "Generate":
            rows.append(node.metrics().get("numOutputRows").get().value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
    walk(plan)
    assert rows and max(rows) < 2_000
