"""Exact order statistics by distributed selection.

A few ranks of a group need no sort of the group. The first pass counts rows by (group, value slice), slices
being contiguous value ranges: a map-side combined aggregate whose result is small whatever the rows.
Running counts over the slices tell which slice holds each wanted rank. The second pass reads
the rows again, keeps those of the wanted slices only, and orders these by value. So what is shuffled and
sorted is a slice or two per rank instead of every nearly distinct value, and one group with most of the rows is
no different from the others: neither pass gathers a group.

Totals, maxima and sums come out of the slices as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE = 32


def slice_key(v: Column, per_octave: int) -> Column:
    """Monotone, value-derived slice number: ``per_octave`` slices per
    doubling of |v| (signed), so slices are contiguous value ranges and need
    no extra pass over the data to place.  NULL, NaN and the infinities are
    slices of their own, placed where Spark sorts them."""
    x = v.cast("double")
    m = F.floor(F.log2(F.abs(x) + F.lit(1.0)) * F.lit(per_octave))
    return (F.when(x.isNull(), F.lit(-(1 << 63)).cast("long"))
            .when(F.isnan(x), F.lit((1 << 63) - 1).cast("long"))
            .when(x == F.lit(float("inf")), F.lit((1 << 63) - 2).cast("long"))
            .when(x == F.lit(float("-inf")), F.lit(-(1 << 63) + 1).cast("long"))
            .otherwise((F.signum(x) * m).cast("long")))


def attach(df: DataFrame, groups: DataFrame, part: Sequence[str], how: str = "inner") -> DataFrame:
    """``groups`` (one row per group: snapshots x a few types or countries) to the rows of their group; a NULL key is a
    group.  Without keys there is one row, whose columns enter as scalar subqueries (no join)."""
    part = list(part)
    rest = [c for c in groups.columns if c not in part]
    if not part:
        return df.withColumns({c: groups.select(c).scalar() for c in rest})
    keys = [f"_k{i}" for i in range(len(part))]
    small = groups.withColumnsRenamed(dict(zip(part, keys, strict=True)))
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(k)) for p, k in zip(part, keys, strict=True)])
    return df.join(F.broadcast(small), same, how).drop(*keys)


def select_ranks(df: DataFrame, part: Sequence[str], value: str, needs: dict[str, Callable[[Column], Column]], weight: str | None = None,
                 top: bool = False, per_octave: int = PER_OCTAVE) -> DataFrame:
    """One row per group: ``n`` rows, ``tot`` (Σ weight, n without one), ``sum_v``, ``max_v``, and for each ``needs`` entry the
    first value, ascending, at which the running weight reaches ``need(tot)``.  With ``top`` values descend and the entry is the
    sum of the first ``need(tot)`` rows (no weight).

    NULL values sort first; callers drop what does not count.
    """
    part = list(part)
    rows = df.withColumn("_s", slice_key(F.col(value), per_octave))
    aggs = [F.count(F.lit(1)).alias("_c"), F.sum(value).alias("_v"), F.max(value).alias("_max")]
    measure = "_c"
    if weight:
        aggs.append(F.coalesce(F.sum(weight), F.lit(0)).alias("_w"))
        measure = "_w"
    every = Window.partitionBy(*part)
    earlier = every.orderBy(F.col("_s").desc() if top else F.col("_s").asc()).rowsBetween(Window.unboundedPreceding, -1)
    t = (rows.groupBy(*part, "_s").agg(*aggs)
         .withColumn("_before", F.coalesce(F.sum(measure).over(earlier), F.lit(0)))
         .withColumn("_over", F.coalesce(F.sum("_v").over(earlier), F.lit(0)))
         .withColumn("_tot", F.sum(measure).over(every)))
    wanted = []
    for k, need in needs.items():
        at = F.when(F.col("_before") + F.col(measure) >= need(F.col("_tot")),
                    F.struct("_s", "_before", "_over", need(F.col("_tot")).cast("double").alias("_need"), F.lit(k).alias("_name")))
        wanted.append(F.max(at) if top else F.min(at))
    groups = t.groupBy(*part).agg(
        F.sum("_c").alias("n"), F.max("_tot").alias("tot"), F.sum("_v").alias("sum_v"), F.max("_max").alias("max_v"),
        F.array_compact(F.array(*wanted)).alias("_wanted"))
    hit = F.explode(F.filter("_wanted", lambda x: x["_s"] == F.col("_s"))).alias("_t")
    cols = [F.col(value).alias("_val"), *([F.col(weight).alias("_wt")] if weight else [])]
    f = (attach(rows, groups.select(*part, "_wanted"), part).select(*part, *cols, hit)
         .groupBy(*part, "_t", "_val").agg(F.count(F.lit(1)).alias("_c"), *([F.coalesce(F.sum("_wt"), F.lit(0)).alias("_w")] if weight else [])))
    upto = Window.partitionBy(*part, "_t").orderBy(F.col("_val").desc() if top else F.col("_val").asc())
    f = f.withColumn("_cum", F.col("_t._before") + F.sum(measure).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if top:
        take = F.least(F.greatest(F.col("_t._need") - (F.col("_cum") - F.col("_c")), F.lit(0)).cast("long"), F.col("_c"))
        picks = [F.max(F.when(F.col("_t._name") == k, F.col("_t._over"))) + F.sum(F.when(F.col("_t._name") == k, F.col("_val") * take)) for k in needs]
    else:
        picks = [F.min(F.when((F.col("_t._name") == k) & (F.col("_cum") >= F.col("_t._need")), F.col("_val"))) for k in needs]
    found = f.groupBy(*part).agg(*[p.alias(k) for p, k in zip(picks, needs, strict=True)])
    return attach(groups.drop("_wanted"), found, part)


def nearest(q: float) -> Callable[[Column], Column]:
    """Nearest rank: the element at index round((n - 1) q), ties away from zero."""
    return lambda n: F.floor((n - 1) * F.lit(q) + F.lit(0.5)) + 1


def share(q: float) -> Callable[[Column], Column]:
    """Inverse CDF: the running weight reaches q of the total."""
    return lambda n: n * F.lit(q)


def at_index(q: float, round_up: bool) -> Callable[[Column], Column]:
    """The order statistic below or above (n - 1) q, for linear interpolation."""
    return lambda n: (F.ceil if round_up else F.floor)((n - 1) * F.lit(q)) + 1
