"""The snapshots dimension: dates, ordinals, selection, alignment, dense grids.

A panel has one row per entity and snapshot.  Everything that needs "the
previous snapshot" goes by the ordinal ``t`` (previous *available* snapshot),
never by calendar arithmetic.  The snapshots dimension is bounded by the
calendar (one row per week or month), so it is the only thing that is ever
windowed without a partition key or broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ORG_TYPES


def snapshot_dim(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """(date, t): distinct snapshot dates with a 0-based ordinal.

    The unpartitioned window runs over the distinct dates only (one row per
    snapshot), never over panel rows.
    """
    d = df.select(date_col).distinct()
    return d.withColumn("t", (F.dense_rank().over(Window.orderBy(date_col)) - 1).cast("int"))


def with_ordinal(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Attach ``t`` to every row via a broadcast join with the snapshots dim."""
    return df.join(F.broadcast(snapshot_dim(df, date_col)), date_col)  # one row per snapshot


def select_snapshots(dim: DataFrame, since: str | None = None, until: str | None = None,
                     limit: int | None = None, smoke: bool = False, every: int | None = None,
                     date_col: str = "snapshot_date") -> DataFrame:
    """Snapshot selection on the dim.

    * ``smoke``: first, middle (``n // 2``) and last (all when fewer than 3)
    * otherwise ``since`` / ``until`` inclusive, then the first ``limit``
    * ``every``: every n-th of what is left, plus always the latest
    """
    d = dim.select(date_col)
    if smoke:
        w = Window.orderBy(date_col)
        d = (d.withColumn("_i", F.row_number().over(w) - 1)
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
             .filter((F.col("_n") < 3) | F.col("_i").isin(0) | (F.col("_i") == F.floor(F.col("_n") / 2))
                     | (F.col("_i") == F.col("_n") - 1))
             .drop("_i", "_n"))
    else:
        if since:
            d = d.filter(F.col(date_col) >= F.lit(since).cast("date"))
        if until:
            d = d.filter(F.col(date_col) <= F.lit(until).cast("date"))
        if limit:
            d = d.withColumn("_i", F.row_number().over(Window.orderBy(date_col))).filter(F.col("_i") <= limit).drop("_i")
    if every:
        d = (d.withColumn("_i", F.row_number().over(Window.orderBy(date_col)) - 1)
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
             .filter((F.col("_i") % every == 0) | (F.col("_i") == F.col("_n") - 1))
             .drop("_i", "_n"))
    return d


def restrict(panel: DataFrame, selected: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Keep the panel rows of the selected snapshots (partition pruning on a
    date-partitioned table through dynamic partition pruning)."""
    return panel.join(F.broadcast(selected.select(date_col)), date_col, "left_semi")  # <= one row per snapshot


def align_snapshots(a: DataFrame, b: DataFrame, how: str = "inner", date_col: str = "snapshot_date") -> DataFrame:
    """Dates of two hubs: ``inner`` = common dates, ``outer`` = master axis."""
    da, db = a.select(date_col).distinct(), b.select(date_col).distinct()
    out = da.intersect(db) if how == "inner" else da.union(db).distinct()
    return out


def type_grid(dim: DataFrame, types: Sequence[str] = ORG_TYPES, by: str = "org_type",
              date_col: str = "snapshot_date") -> DataFrame:
    """Every snapshot x every type, generated per snapshot row (no join)."""
    return dim.select(date_col, F.explode(F.array(*[F.lit(t) for t in types])).alias(by))


def densify(values: DataFrame, grid: DataFrame, keys: Sequence[str], fill: dict) -> DataFrame:
    """Full outer join of aggregated values with a dense grid; fill holes.

    Keys outside the grid (e.g. a non-canonical type) are kept as they are.
    """
    out = grid.join(values, list(keys), "full_outer")
    return out.select(*keys, *[F.coalesce(F.col(c), F.lit(v)).alias(c) if v is not None else F.col(c)
                               for c, v in fill.items()],
                      *[c for c in values.columns if c not in keys and c not in fill])


def first_tracked(panel: DataFrame, metric: str) -> Column:
    """aggregate expression for the first snapshot ordinal with data."""
    return F.min(F.when(F.col(metric).isNotNull(), F.col("t")))
