"""Per-snapshot totals by organisation type, hub totals and shares (E1-E4,
E8, E11, E27).

All of these aggregate the panel to (snapshot, group) first — a map-side
partial aggregate followed by one shuffle of at most snapshots x groups
rows — and only then window over the tiny result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ORG_TYPES
from .snapshots import densify, snapshot_dim, type_grid

METRICS = ("downloads", "likes", "downloadsAllTime")


def _zsum(c: str):
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def metric_by_type(panel: DataFrame, metrics: Sequence[str] = METRICS, by: str = "org_type",
                   types: Sequence[str] = ORG_TYPES, since: str | None = None) -> DataFrame:
    """Σ metric per (snapshot, type); missing cells are 0 (pandas-style sum)."""
    p = panel if since is None else panel.filter(F.col("snapshot_date") >= F.lit(since).cast("date"))
    g = p.groupBy("snapshot_date", by).agg(*[_zsum(m).alias(m) for m in metrics])
    grid = type_grid(p.select("snapshot_date").distinct(), types, by)
    return densify(g, grid, ["snapshot_date", by], {m: 0 for m in metrics})


def count_by_type(panel: DataFrame, by: str = "org_type", types: Sequence[str] = ORG_TYPES) -> DataFrame:
    """Rows per (snapshot, type), the snapshot total and its
    week-over-week delta (first snapshot = 0)."""
    g = panel.groupBy("snapshot_date", by).agg(F.count(F.lit(1)).alias("n"))
    dim = snapshot_dim(panel)
    d = densify(g, type_grid(dim, types, by), ["snapshot_date", by], {"n": 0})
    # dim: one row per snapshot (calendar-bounded)
    tot = d.groupBy("snapshot_date").agg(F.sum("n").alias("total")).join(F.broadcast(dim), "snapshot_date")
    w = Window.orderBy("t")  # one row per snapshot
    tot = tot.withColumn("delta", F.coalesce(F.col("total") - F.lag("total").over(w), F.lit(0)))
    return d.join(tot, "snapshot_date").select(
        "snapshot_date", by, F.col("n").cast("long").alias("n"), F.col("total").cast("long").alias("total"),
        F.col("delta").cast("long").alias("delta"))


def type_vectors(panel: DataFrame, types: Sequence[str] = ORG_TYPES) -> DataFrame:
    """Per (snapshot, type) dl, dlat, lk, n, new over the canonical types.

    ``dlat`` is NULL for every type of a snapshot where the all-time metric is
    not tracked at all (no non-null value), else 0-filled.  ``new`` counts
    first appearances of ``_id`` (the first snapshot counts every row).
    """
    first = F.min("t").over(Window.partitionBy("_id"))
    p = panel.withColumn("_new", (F.col("t") == first).cast("int"))
    g = p.groupBy("snapshot_date", "org_type").agg(
        _zsum("downloads").alias("dl"), _zsum("downloadsAllTime").alias("dlat"),
        _zsum("likes").alias("lk"), F.count(F.lit(1)).alias("n"), _zsum("_new").alias("new"))
    gate = panel.groupBy("snapshot_date").agg(F.count("downloadsAllTime").alias("_tracked"))
    grid = type_grid(gate.select("snapshot_date"), types)
    d = densify(g, grid, ["snapshot_date", "org_type"], {"dl": 0, "dlat": 0, "lk": 0, "n": 0, "new": 0})
    return (d.join(F.broadcast(gate), "snapshot_date")  # gate: one row per snapshot
            .withColumn("dlat", F.when(F.col("_tracked") > 0, F.col("dlat")))
            .select("snapshot_date", "org_type", "dl", "dlat", "lk", F.col("n").cast("long").alias("n"),
                    F.col("new").cast("long").alias("new")))


def hub_totals(panel: DataFrame, flag: str | None = None) -> DataFrame:
    """Hub totals per snapshot (n, dl, dlat, lk) and the same over rows
    where ``flag`` is true (e.g. has_paper).  ``dlat`` stays NULL while the
    metric is untracked; likes are 0-filled."""
    aggs = [F.count(F.lit(1)).alias("n"), _zsum("downloads").alias("dl"),
            F.sum("downloadsAllTime").cast("long").alias("dlat"), _zsum("likes").alias("lk")]
    if flag:
        f = F.col(flag)
        aggs += [F.count_if(f).alias("n_flag"),
                 F.coalesce(F.sum(F.when(f, F.col("downloads"))), F.lit(0)).cast("long").alias("dl_flag"),
                 F.when(F.count("downloadsAllTime") > 0,
                        F.coalesce(F.sum(F.when(f, F.col("downloadsAllTime"))), F.lit(0))).cast("long").alias("dlat_flag"),
                 F.coalesce(F.sum(F.when(f, F.col("likes"))), F.lit(0)).cast("long").alias("lk_flag")]
    return panel.groupBy("snapshot_date").agg(*aggs)


def account_totals(acc: DataFrame) -> DataFrame:
    """Hub totals from account aggregates (dl, lk, dlat, n_repo, n_auth)."""
    return acc.groupBy("snapshot_date").agg(
        _zsum("dl").alias("dl"), _zsum("lk").alias("lk"), F.sum("dlat").cast("long").alias("dlat"),
        _zsum("n").alias("n_repo"), F.count(F.lit(1)).alias("n_auth"))


def type_shares(by_type: DataFrame, value: str, by: str = "org_type", exclude: Sequence[str] = (),
                scale: int = 6) -> DataFrame:
    """Share of each type in the snapshot total after dropping
    ``exclude`` types (the denominator changes with the exclusion), plus the
    snapshot total line."""
    d = by_type.filter(~F.col(by).isin(*exclude)) if exclude else by_type
    tot = F.sum(value).over(Window.partitionBy("snapshot_date"))
    return d.select("snapshot_date", by, F.col(value).alias("value"), tot.cast("long").alias("total"),
                    F.try_divide(F.col(value).cast("double"), tot).cast(f"decimal(20,{scale})").alias("share"))


def presence_outcome(panel: DataFrame, outcome: str = "downloadsAllTime") -> DataFrame:
    """Per type, share of rows (presence) vs share of the outcome, plus the
    organisation / individual split of both, per snapshot."""
    g = panel.groupBy("snapshot_date", "org_type").agg(F.count(F.lit(1)).alias("n"), _zsum(outcome).alias("outcome"))
    w = Window.partitionBy("snapshot_date")
    grp = F.when(F.col("org_type") == "individual", F.lit("individual")).otherwise(F.lit("organisation"))
    wg = Window.partitionBy("snapshot_date", "_grp")
    return (g.withColumn("_grp", grp)
            .select("snapshot_date", "org_type", F.col("_grp").alias("side"), "n", "outcome",
                    F.try_divide(F.col("n").cast("double"), F.sum("n").over(w)).cast("decimal(20,6)").alias("presence_share"),
                    F.try_divide(F.col("outcome").cast("double"), F.sum("outcome").over(w)).cast("decimal(20,6)").alias("outcome_share"),
                    F.try_divide(F.sum("n").over(wg).cast("double"), F.sum("n").over(w)).cast("decimal(20,6)").alias("side_presence_share"),
                    F.try_divide(F.sum("outcome").over(wg).cast("double"), F.sum("outcome").over(w)).cast("decimal(20,6)").alias("side_outcome_share")))


def group_order(by_type: DataFrame, value: str, by: str = "org_type") -> DataFrame:
    """Order of the groups by their value in the latest snapshot (largest
    first, ties by name) — e.g. the stacking order of a chart."""
    last = by_type.agg(F.max("snapshot_date").alias("snapshot_date"))
    return order_groups(by_type.join(F.broadcast(last), "snapshot_date", "left_semi"), value, by)  # one row


def order_groups(groups: DataFrame, value: str, by: str = "org_type") -> DataFrame:
    """G4 by any value with one row per group: largest first, NULL last, ties by name."""
    w = Window.orderBy(F.col(value).desc_nulls_last(), F.col(by).asc())  # one row per group
    return groups.select(by, F.col(value).alias("value"), F.row_number().over(w).alias("position"))
