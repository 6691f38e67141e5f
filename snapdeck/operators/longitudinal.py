"""Longitudinal operators over the panel (D4-D6, D8, D11, E28, E29, F4, F5,
F7-F11, I1, I5).

"Previous" always means the previous *available* snapshot: windows are
partitioned by the entity key and ordered by the snapshot ordinal ``t``; a
lag counts as consecutive only when ``t - lag(t) = 1``.  Entity windows are
naturally balanced (at most one row per entity and snapshot); the few
windows over per-snapshot or per-type aggregates run on tiny inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ORG_TYPES
from ..functions.numeric import round_sig
from .ranking import top_rows
from .snapshots import densify, snapshot_dim, type_grid


def spikes(panel: DataFrame, metric: str = "downloads", top: int = 5) -> DataFrame:
    """D4 + F4: week-over-week delta per ``_id`` between consecutive snapshots
    (first appearances excluded), top ``top`` per snapshot by delta."""
    w = Window.partitionBy("_id").orderBy("t")
    d = (panel.select("snapshot_date", "t", "_id", "id", "org_type", metric)
         .withColumn("_pt", F.lag("t").over(w)).withColumn("downloads_prev", F.lag(metric).over(w))
         .filter(F.col("t") - F.col("_pt") == 1)
         .withColumn("delta", F.col(metric) - F.col("downloads_prev")))
    return top_rows(d, ["snapshot_date"], "delta", "_id", top).select(
        "snapshot_date", "t", "_id", "id", "org_type", "downloads_prev", F.col(metric).alias("downloads"),
        "delta", F.col("rk").cast("int").alias("rk"))


def spike_summary(sp: DataFrame, top: int = 25) -> DataFrame:
    """Per ``_id`` its largest spike (earliest on ties) and how often it
    made the weekly top list; the ``top`` largest overall."""
    best = F.max_by(F.struct("snapshot_date", "id", "org_type", "downloads_prev", "downloads", "delta"),
                    F.struct(F.col("delta"), -F.col("t")))
    s = sp.groupBy("_id").agg(best.alias("b"), F.count(F.lit(1)).alias("topK_appearances"))
    return (s.select("_id", "b.*", "topK_appearances")
            .orderBy(F.col("delta").desc(), F.col("_id").asc()).limit(top))


def like_gain(acc: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Per account, likes now minus likes in the previous snapshot
    (accounts absent there have no gain).  ``part`` adds keys such as a hub
    or mode column."""
    w = Window.partitionBy(*part, "author").orderBy("t")
    return (acc.withColumn("_pt", F.lag("t").over(w)).withColumn("lk_prev", F.lag("lk").over(w))
            .filter(F.col("t") - F.col("_pt") == 1)
            .select(*part, "snapshot_date", "t", "author", "lk", "lk_prev", (F.col("lk") - F.col("lk_prev")).alias("lkd")))


def first_seen(panel: DataFrame) -> DataFrame:
    """Rows of an ``_id``'s first snapshot (duplicates in that week all count)."""
    return (panel.withColumn("_first", F.min("t").over(Window.partitionBy("_id")))
            .filter(F.col("t") == F.col("_first")).drop("_first"))


def newly_added(panel: DataFrame, by: str = "org_type", types: Sequence[str] = ORG_TYPES) -> DataFrame:
    """first appearances per (snapshot, type); the first snapshot is the
    baseline (all rows new)."""
    g = first_seen(panel.select("snapshot_date", "t", "_id", by)).groupBy("snapshot_date", by).agg(
        F.count(F.lit(1)).alias("new"))
    grid = type_grid(panel.select("snapshot_date").distinct(), types, by)
    return densify(g, grid, ["snapshot_date", by], {"new": 0})


def newly_added_cumulative(panel: DataFrame) -> DataFrame:
    """newly added per snapshot and the running total."""
    dim = snapshot_dim(panel)
    g = first_seen(panel.select("snapshot_date", "t", "_id")).groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("newly_added"))
    d = dim.join(g, "snapshot_date", "left").fillna({"newly_added": 0})
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per snapshot
    return d.select("snapshot_date", "newly_added", F.sum("newly_added").over(w).cast("long").alias("cumulative"))


def running(totals: DataFrame) -> DataFrame:
    """Per snapshot (total, newly_added, t): ``delta`` to the previous total (first 0) and ``cumulative`` newly added."""
    w = Window.orderBy("t")  # one row per snapshot
    return (totals.withColumn("delta", F.coalesce(F.col("total") - F.lag("total").over(w), F.lit(0)))
            .withColumn("cumulative", F.sum("newly_added").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))


def baseline(panel: DataFrame, metric: str = "downloadsAllTime", key: str = "_id") -> DataFrame:
    """(key, base), the first tracked (non-null) value of each key.  A mergeable minimum: with a stored baseline only
    keys that it lacks need new weeks (an anti-join).  Keyless rows have none."""
    first = F.min(F.struct("t", metric))
    return (panel.filter(F.col(metric).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(first.alias("_first"))
            .select(key, F.col(f"_first.{metric}").alias("base")))


def growth(panel: DataFrame, metric: str = "downloadsAllTime", top: int = 1000, key: str = "_id", base: DataFrame | None = None,
           cut: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """D8 + F11: growth since the first tracked value per key, the weekly top pool by growth.

    No row's growth exceeds its value by more than the least value of all is below 0. So the growth of the ``top`` rows by
    value gives each week a floor, and only rows that can reach it are candidates for the pool: the history
    of no other key is joined or shuffled, and no window runs over the panel.  ``base`` is a stored baseline (key, base);
    without it the candidates' baselines are taken from the panel.  ``cut`` stores intermediate rows (given a
    name) and reads them back, after which their size is known to the planner.
    """
    v = panel.filter(F.col(metric).isNotNull() & F.col(key).isNotNull()).select("snapshot_date", "t", key, metric)

    def grown(rows: DataFrame, keys: DataFrame) -> DataFrame:
        b = baseline(v.join(keys, key, "left_semi"), metric, key) if base is None else base
        return rows.join(b, key).withColumn("g", F.col(metric) - F.col("base"))

    lead = cut(top_rows(v, ["snapshot_date"], metric, key, top).drop("rk"), "growth_lead")
    # at most ``top`` keys per snapshot
    floor = grown(lead, F.broadcast(lead.select(key).distinct())).groupBy("snapshot_date").agg(
        F.when(F.count(F.lit(1)) >= top, F.min("g")).alias("_floor"))
    least = v.agg(F.least(F.min(metric), F.lit(0))).scalar()
    near = (v.join(F.broadcast(floor), "snapshot_date")  # one row per snapshot
            .filter(F.col("_floor").isNull() | (F.col(metric) - least >= F.col("_floor"))).drop("_floor"))
    near = cut(near, "growth_near")
    return top_rows(grown(near, near.select(key).distinct()), ["snapshot_date"], "g", key, top).select(
        "snapshot_date", key, "base", F.col(metric).alias("value"), "g", F.col("rk").cast("int").alias("rk"))


def with_growth(panel: DataFrame, metric: str = "downloadsAllTime", key: str = "_id") -> DataFrame:
    """D8 as a column: ``growth`` = value - first tracked value of the key
    (NULL where the metric is NULL), for explorer queries ranking by growth."""
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(F.col(metric), ignorenulls=True).over(w)
    return panel.withColumn("growth", F.col(metric) - base)


def latest_attrs(panel: DataFrame, cols: Sequence[str] = ("id", "author", "tags"), key: str = "_id") -> DataFrame:
    """F8: latest-wins attributes per key; org type = latest non-null."""
    return panel.groupBy(key).agg(
        F.max_by(F.struct(*cols), "t").alias("a"),
        F.max_by("org_type", F.when(F.col("org_type").isNotNull(), F.col("t"))).alias("org_type"),
        F.max("t").alias("last_t")).select(key, "a.*", "org_type", "last_t")


def series_bounds(panel: DataFrame, metrics: Sequence[str], key: str = "_id") -> DataFrame:
    """F9 + F10: first and last snapshot ordinal with a value, per key and metric."""
    aggs = []
    for m in metrics:
        aggs += [F.min(F.when(F.col(m).isNotNull(), F.col("t"))).alias(f"{m}_start"),
                 F.max(F.when(F.col(m).isNotNull(), F.col("t"))).alias(f"{m}_end")]
    return panel.groupBy(key).agg(*aggs)


def entity_series(panel: DataFrame, pool: DataFrame, key: str = "_id", sig: int = 3) -> DataFrame:
    """Weekly values of the pooled entities, 3 significant figures for the
    volume series, exact likes."""
    p = panel.join(pool.select(key), key, "left_semi")
    return p.select(key, "snapshot_date", "t",
                    round_sig("downloads", sig).alias("dl"), round_sig("downloadsAllTime", sig).alias("dlat"),
                    F.col("likes").alias("lk"))


def entity_history(panel: DataFrame, ident: str) -> DataFrame:
    """D11 + J9: resolve ``_id`` from the latest snapshot carrying ``id`` and
    return every row of that ``_id`` (so renames do not cut the history).
    An unknown ``id`` is an error when the result is read."""
    target = panel.filter(F.col("id") == ident).agg(
        F.coalesce(F.max_by("_id", "t"), F.raise_error(F.lit(f"unknown id: {ident}"))).alias("_id"))
    return panel.join(target, "_id", "left_semi")


def trimmed_series(panel: DataFrame, metrics: Sequence[str], key: str = "_id") -> DataFrame:
    """(key, metric, t, value) from a key's first to its last value of the
    metric; snapshots without a value in between are NULL rows.  Keys without
    any value have no series.  A key contributes at most one row per snapshot
    and metric."""
    long = panel.select(key, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col("t"), F.col(m).alias("value")) for m in metrics])).alias("s")).select(
        key, "s.*").filter(F.col("value").isNotNull())
    axis = long.groupBy(key, "metric").agg(F.min("t").alias("a"), F.max("t").alias("b")).select(
        key, "metric", F.explode(F.sequence("a", "b")).alias("t"))
    return axis.join(long, [key, "metric", "t"], "left")


def frozen(panel: DataFrame) -> DataFrame:
    """Snapshots whose (row count, likes sum) signature equals the
    previous snapshot's."""
    return frozen_weeks(panel.groupBy("snapshot_date", "t").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("likes"), F.lit(0)).cast("long").alias("lk")))


def frozen_weeks(s: DataFrame) -> DataFrame:
    """E28 from the signatures (snapshot_date, t, n, lk)."""
    w = Window.orderBy("t")  # one row per snapshot
    return s.select("snapshot_date", "n", "lk",
                    F.coalesce((F.col("n") == F.lag("n").over(w)) & (F.col("lk") == F.lag("lk").over(w)),
                               F.lit(False)).alias("frozen"))


def diff_expected(found: DataFrame, expected: DataFrame, col: str = "snapshot_date") -> DataFrame:
    """H5: observed-but-not-expected and expected-but-not-observed dates."""
    f, e = found.select(col), expected.select(col)
    return (f.exceptAll(e).withColumn("side", F.lit("unexpected"))
            .unionByName(e.exceptAll(f).withColumn("side", F.lit("missing"))))


def smooth_frozen(series: DataFrame, frozen_t: DataFrame, part: Sequence[str], value: str) -> DataFrame:
    """inside each frozen run, spread the next fresh value's increment
    linearly over the run and that week (half-even to an integer).  Needs a
    non-null anchor just before the run and a non-null fresh value after it;
    trailing runs and runs without anchors stay as they are.

    ``series`` is dense in ``t`` per partition; ``frozen_t`` lists frozen ``t``.
    """
    # frozen snapshots: at most one row per snapshot (calendar-bounded)
    s = series.join(F.broadcast(frozen_t.select("t").withColumn("_fz", F.lit(True))), "t", "left") \
        .withColumn("_fz", F.coalesce("_fz", F.lit(False)))
    fresh = F.when(~F.col("_fz"), F.struct(F.col("t").alias("at"), F.col(value).alias("av")))
    wb = Window.partitionBy(*part).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    wf = Window.partitionBy(*part).orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    s = s.withColumn("_a", F.last(fresh, ignorenulls=True).over(wb)).withColumn("_b", F.first(fresh, ignorenulls=True).over(wf))
    span = F.col("_b.at") - F.col("_a.at")
    m = F.col("t") - F.col("_a.at")
    a = F.col("_a.av").cast("decimal(38,0)")
    d = (F.col("_b.av") - F.col("_a.av")).cast("decimal(38,0)")
    interp = F.bround((a * span + d * m) / span, 0).cast("long")
    ok = F.col("_fz") & F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_a.av").isNotNull() \
        & F.col("_b.av").isNotNull()
    return s.withColumn(value, F.when(ok, interp).otherwise(F.col(value))).drop("_fz", "_a", "_b")


def drivers(panel: DataFrame, types: Sequence[str] = ORG_TYPES) -> DataFrame:
    """Stacked per-type series of all-time downloads and likes with
    frozen-week smoothing.  A missing type has NULL all-time and 0 likes;
    all-time is NULL for untracked snapshots."""
    g = panel.groupBy("snapshot_date", "org_type").agg(
        F.coalesce(F.sum("downloadsAllTime"), F.lit(0)).cast("long").alias("dlat"),
        F.coalesce(F.sum("likes"), F.lit(0)).cast("long").alias("lk"))
    gate = panel.groupBy("snapshot_date").agg(F.count("downloadsAllTime").alias("tracked"))
    return smoothed_drivers(g, gate, snapshot_dim(panel), frozen(panel), types)


def smoothed_drivers(g: DataFrame, gate: DataFrame, dim: DataFrame, frozen_flags: DataFrame,
                     types: Sequence[str] = ORG_TYPES) -> DataFrame:
    """I5 from the sums (snapshot_date, org_type, dlat, lk), the rows with an all-time value per snapshot
    (``tracked``), the snapshots dim and the frozen flags."""
    # dim / gate: one row per snapshot (calendar-bounded)
    grid = type_grid(dim, types).join(F.broadcast(dim), "snapshot_date")
    d = (grid.join(g, ["snapshot_date", "org_type"], "left").join(F.broadcast(gate), "snapshot_date")
         .withColumn("dlat", F.when(F.col("tracked") > 0, F.col("dlat")))
         .withColumn("lk", F.coalesce("lk", F.lit(0).cast("long"))).drop("tracked"))
    fz = frozen_flags.filter("frozen").join(F.broadcast(dim), "snapshot_date").select("t")
    d = smooth_frozen(d, fz, ["org_type"], "dlat")
    d = smooth_frozen(d, fz, ["org_type"], "lk")
    return d.select("snapshot_date", "org_type", "dlat", "lk")
