"""Distribution statistics.

Scale rule: a single organisation type can hold most rows, so raw rows are
never windowed by type.  Quantiles, top shares and grid limits come from
distributed selection (``selection``): a slice histogram finds the slices that hold
the wanted ranks, and only their rows are ordered.  Rank densities need every rank: they go
through *frequency rows* (``groupBy(part, value).count()`` with a map-side partial
aggregate), whose running counts are computed per value slice.  Densities are histograms on an
80-bin grid; a group's at most 80 cells are smoothed inside one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CONCENTRATION_PS, DENSITY_BINS, LOG_SIGMA, RANK_SIGMA_BINS
from .selection import at_index, attach, nearest, select_ranks, share, slice_key

BOX_QUANTS = [("p5", 0.05), ("q1", 0.25), ("med", 0.5), ("q3", 0.75), ("p95", 0.95), ("p99", 0.99)]


def freq(df: DataFrame, part: Sequence[str], value: str, weight: str | None = None,
         descending: bool = False, per_octave: int = 64) -> DataFrame:
    """Frequency rows (part, v, c[, w]) with ``cum`` (inclusive running count
    in value order), ``cum_w`` when weighted, and the group size ``n``.

    Running sums never run in one task per group: the window runs per
    (group, value slice) — slices are contiguous value ranges
    (``per_octave`` per doubling of |v|) — and a small per-slice table adds
    the counts of the slices before, so a type holding most rows, even with a
    near-continuous value such as byte sizes, is spread over many tasks.  The
    slices of a group number at most a few thousand per ``per_octave``,
    whatever the rows.
    """
    part = list(part)
    aggs = [F.count(F.lit(1)).alias("c")]
    if weight:
        aggs.append(F.coalesce(F.sum(weight), F.lit(0)).alias("w"))
    order = F.col("v").desc() if descending else F.col("v").asc()
    g = df.groupBy(*part, F.col(value).alias("v")).agg(*aggs).withColumn("_s", slice_key(F.col("v"), per_octave))
    wl = Window.partitionBy(*part, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("_lc", F.sum("c").over(wl))
    sums = [F.sum("c").alias("_sc")]
    if weight:
        g = g.withColumn("_lw", F.sum("w").over(wl))
        sums.append(F.sum("w").alias("_sw"))
    t = g.groupBy(*part, "_s").agg(*sums)  # one row per (group, slice)
    so = F.col("_s").desc() if descending else F.col("_s").asc()
    wo = Window.partitionBy(*part).orderBy(so).rowsBetween(Window.unboundedPreceding, -1)
    wa = Window.partitionBy(*part)
    t = (t.withColumn("_oc", F.coalesce(F.sum("_sc").over(wo), F.lit(0)))
         .withColumn("n", F.sum("_sc").over(wa)))
    if weight:
        t = (t.withColumn("_ow", F.coalesce(F.sum("_sw").over(wo), F.lit(0)))
             .withColumn("tot_w", F.sum("_sw").over(wa)))
    keys = [*part, "_s"]
    t = t.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]  # a NULL group is a group
    g = g.join(t, same).withColumn("cum", F.col("_oc") + F.col("_lc"))
    if weight:
        g = g.withColumn("cum_w", F.col("_ow") + F.col("_lw"))
    keep = [*part, "v", "c", "cum", "n"] + (["w", "cum_w", "tot_w"] if weight else [])
    return g.select(*keep)


def box_stats(df: DataFrame, col: str, part: Sequence[str] = ("org_type",), positive: bool = False) -> DataFrame:
    """E12 (+D12): per group: rows, share of non-null rows with value >= 1,
    nearest-rank quantiles, mean and max over the rows >= 1.  Groups without
    a row >= 1 vanish.  ``positive`` uses value > 0 instead (E19: sized rows,
    coverage share and quantiles in bytes)."""
    part = list(part)
    keep = (F.col(col) > 0) if positive else (F.col(col) >= 1)
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(keep.cast("double")).alias("share"))
    q = select_ranks(df.filter(keep), part, col, {k: nearest(p) for k, p in BOX_QUANTS})
    return attach(q, counts, part).select(
        *part, "n_rows", F.col("share").cast("decimal(20,6)").alias("share"), *[k for k, _ in BOX_QUANTS],
        (F.col("sum_v").cast("double") / F.col("n")).cast("decimal(24,6)").alias("mean"), F.col("max_v").alias("max"))


def concentration(df: DataFrame, value: str, part: Sequence[str] = ("org_type",),
                  ps: Sequence[float] = CONCENTRATION_PS) -> DataFrame:
    """E13 (+E14): share of the total carried by the top p of items,
    k = max(1, ceil(p n)), NULL counted as 0, every item counts; plus the
    quantile segments top1 / next9 / next40 / bottom50."""
    part = list(part)
    rows = df.withColumn("_v", F.coalesce(F.col(value), F.lit(0)))
    g = select_ranks(rows, part, "_v", {f"_t{i}": (lambda n, p=p: F.greatest(F.lit(1), F.ceil(n * F.lit(p)))) for i, p in enumerate(ps)}, top=True)
    g = g.withColumnRenamed("sum_v", "total")
    names = {0.01: "c1", 0.1: "c10", 0.5: "c50"}
    out = g.select(*part, "n", F.col("total").cast("long").alias("total"),
                   *[F.try_divide(F.col(f"_t{i}").cast("double"), F.col("total")).alias(names.get(p, f"c{i}"))
                     for i, p in enumerate(ps)])
    if list(ps) == list(CONCENTRATION_PS):
        out = (out.withColumn("top1", F.col("c1")).withColumn("next9", F.col("c10") - F.col("c1"))
               .withColumn("next40", F.col("c50") - F.col("c10")).withColumn("bottom50", F.lit(1.0) - F.col("c50")))
        cols = ["c1", "c10", "c50", "top1", "next9", "next40", "bottom50"]
        out = out.select(*part, "n", "total", *[F.col(c).cast("decimal(20,6)").alias(c) for c in cols])
    return out


def size_stats(df: DataFrame, x: str, weights: dict[str, str], part: Sequence[str] = ("org_type",)) -> DataFrame:
    """N, mean and population SD of x, and for each weight the weighted
    mean and SD (NULL weight = 0; Σw = 0 -> NULL; var = max(0, E[x²] - E[x]²))."""
    part = list(part)
    aggs = [F.count(F.lit(1)).alias("cnt"), F.avg(x).alias("u_m"), F.stddev_pop(x).alias("u_s")]
    for k, w in weights.items():
        wc = F.coalesce(F.col(w), F.lit(0)).cast("double")
        aggs += [F.try_divide(F.sum(wc * F.col(x)), F.sum(wc)).alias(f"{k}_m"),
                 F.try_divide(F.sum(wc * F.col(x) * F.col(x)), F.sum(wc)).alias(f"_{k}_x2")]
    g = df.groupBy(*part).agg(*aggs)
    sel = [*part, "cnt", F.col("u_m").cast("decimal(20,6)").alias("u_m"), F.col("u_s").cast("decimal(20,6)").alias("u_s")]
    for k in weights:
        m = F.col(f"{k}_m")
        sel += [m.cast("decimal(20,6)").alias(f"{k}_m"),
                F.when(m.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col(f"_{k}_x2") - m * m))).cast("decimal(20,6)").alias(f"{k}_s")]
    return g.select(*sel)


BUCKET_NAMES = ["c", "sx", "sx2", "sw", "swx", "swx2"]


def bucket_stats(rows: DataFrame, ranks: DataFrame, x: str, weight_of: dict[str, str],
                 buckets: Sequence[int], part: Sequence[str] = ()) -> DataFrame:
    """Additive sufficient statistics (c, Σx, Σx², Σw, Σwx, Σwx²) per
    (part, variant, metric, rank bucket, type).  Rows are bucketed by their
    author's rank (``ranks`` from ``account_ranks``: part, author, metric,
    variant, rk); ranks beyond the last bucket are dropped.  The rows are
    summed per account and type first, so a row meets its up to six ranks as
    one account sum instead of six times."""
    part = list(part)
    bkt = None
    for i, b in enumerate(buckets):
        bkt = F.when(F.col("rk") <= b, F.lit(i)) if bkt is None else bkt.when(F.col("rk") <= b, F.lit(i))
    r = ranks.withColumn("bkt", bkt).filter(F.col("bkt").isNotNull())
    xc = F.col(x)
    aggs = [F.count(F.lit(1)).alias("c"), F.sum(xc).alias("sx"), F.sum(xc * xc).alias("sx2")]
    for k, c in weight_of.items():
        w = F.coalesce(F.col(c), F.lit(0)).cast("double")
        aggs += [F.sum(w).alias(f"sw_{k}"), F.sum(w * xc).alias(f"swx_{k}"), F.sum(w * xc * xc).alias(f"swx2_{k}")]
    j = rows.groupBy(*part, "author", "org_type").agg(*aggs).join(r, [*part, "author"])
    picked = None  # the sums weighted by the rank's own metric
    for k in weight_of:
        t = F.struct(*[F.col(f"{n}_{k}").alias(n) for n in BUCKET_NAMES[3:]])
        picked = F.when(F.col("metric") == k, t) if picked is None else picked.when(F.col("metric") == k, t)
    return (j.withColumn("_w", picked).groupBy(*part, "variant", "metric", "bkt", "org_type")
            .agg(*[F.sum(n).alias(n) for n in BUCKET_NAMES[:3]],
                 *[F.coalesce(F.sum(f"_w.{n}"), F.lit(0.0)).alias(n) for n in BUCKET_NAMES[3:]]))


def prefix_stats(b: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Combine a bucket prefix into exact top-N cohort statistics:
    mean ± population SD of x, unweighted and weighted."""
    part = list(part)
    w = Window.partitionBy(*part, "variant", "metric", "org_type").orderBy("bkt") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = b.select(*part, "variant", "metric", "org_type", "bkt", *[F.sum(c).over(w).alias(c) for c in BUCKET_NAMES])
    m = F.col("sx") / F.col("c")
    wm = F.try_divide(F.col("swx"), F.col("sw"))
    return s.select(*part, "variant", "metric", "org_type", "bkt", F.col("c").cast("long").alias("c"),
                    m.cast("decimal(20,6)").alias("mean"),
                    F.sqrt(F.greatest(F.lit(0.0), F.col("sx2") / F.col("c") - m * m)).cast("decimal(20,6)").alias("sd"),
                    wm.cast("decimal(20,6)").alias("w_mean"),
                    F.when(wm.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col("swx2") / F.col("sw") - wm * wm)))
                    .cast("decimal(20,6)").alias("w_sd"))


def account_hist(df: DataFrame, col: str, edges: Sequence[float], part: Sequence[str] = ("author",)) -> DataFrame:
    """Per group the count of rows per bin, bin = number of edges <= value
    (irregular edges); NULL values are dropped."""
    b = sum((F.col(col) >= F.lit(e)).cast("int") for e in edges)
    return df.filter(F.col(col).isNotNull()).groupBy(*part, b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))


def account_hists(df: DataFrame, cols: dict[str, str], edges: dict[str, Sequence[float]],
                  part: Sequence[str] = ("author",)) -> DataFrame:
    """E17 for several columns in one pass: (part, bin, c, key)."""
    cells = [F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"),
                    sum((F.col(c) >= F.lit(e)).cast("int") for e in edges[k]).alias("bin"))) for k, c in cols.items()]
    return (df.select(*part, F.explode(F.array_compact(F.array(*cells))).alias("_h"))
            .groupBy(*part, F.col("_h.bin").alias("bin"), F.col("_h.key").alias("key"))
            .agg(F.count(F.lit(1)).alias("c")).select(*part, "bin", "c", "key"))


def np_bin(x: Column, lo: Column, step: Column, bins: int) -> Column:
    """Bin of x on the grid ``lo + k * step`` (k = 0..bins, last edge closed)
    exactly as a histogram over ``linspace`` edges assigns it: a first guess
    by division, then one correction against the computed edges, so values
    that fall on an edge land where floating-point comparison puts them."""
    def edge(k):
        return k.cast("double") * step + lo
    cand = F.least(F.greatest(F.floor((x - lo) / step), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (F.when(x < edge(cand), cand - 1)
            .when((cand < bins - 1) & (x >= edge(cand + 1)), cand + 1)
            .otherwise(cand))


def _smooth(hist: DataFrame, part: Sequence[str], sigma: str, bins: int) -> DataFrame:
    """Gaussian smoothing of (part, bin, h) on a fixed ``bins`` grid: zero-padded 'same' convolution with a kernel
    of radius ceil(4σ), up to its constant sum, which peak-normalised curves don't need.  A group has at most
    ``bins`` cells, gathered into one row; the result is (part, ds) with the dense array of smoothed cells.
    ``sigma`` is a column that is constant in a group."""
    g = hist.groupBy(*part).agg(F.map_from_entries(F.collect_list(F.struct("bin", "h"))).alias("_cells"), F.first(sigma).alias("_s"))
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    reach = F.least(F.ceil(F.lit(4.0) * F.col("_s")), F.lit(bins - 1)).cast("int")  # farther offsets leave the grid
    g = g.withColumn("_r", reach).withColumn("_kernel", F.transform(F.sequence(-F.col("_r"), F.col("_r")), lambda j: F.exp(F.lit(-0.5) * F.pow(j / F.col("_s"), 2))))
    edge = F.array_repeat(F.lit(0.0), F.col("_r"))
    g = g.withColumn("_h", F.concat(edge, F.transform(every, lambda i: F.coalesce(F.col("_cells")[i], F.lit(0.0))), edge))

    def cell(i):
        near = F.zip_with(F.slice("_h", i + 1, 2 * F.col("_r") + 1), "_kernel", lambda h, k: h * k)
        return F.aggregate(near, F.lit(0.0), lambda acc, x: acc + x)
    return g.select(*part, F.transform(every, cell).alias("ds"))


def log_density(df: DataFrame, value: str, part: Sequence[str] = ("org_type",), lower: str | None = None,
                bins: int = DENSITY_BINS, sigma: float = LOG_SIGMA, lo_q: float = 0.001, hi_q: float = 0.999,
                min_value: float = 1.0, strict_positive: bool = False, pool: Sequence[str] = ()) -> DataFrame:
    """Peak-normalised smoothed histogram of log10(value) per group.

    Grid: ``bins`` equal bins on [0, pooled nearest p99.9] (E18, values >= 1)
    or on [pooled p0.1, p99.9] when ``lower`` is set (E19, values > 0); the
    right edge is closed and values outside the grid are dropped.  The grid
    limits are pooled over everything, or per ``pool`` group (e.g. snapshot
    and metric).  A grid without width (all values equal) puts everything,
    unsmoothed, into bin 0.
    """
    part = list(part)
    cond = (F.col(value) > 0) if strict_positive else (F.col(value) >= F.lit(min_value))
    pool = list(pool)
    rows = df.filter(cond).select(*part, F.col(value).alias("v"))
    lim = select_ranks(rows, pool, "v", {"hi": nearest(hi_q), **({"lo": nearest(lo_q)} if lower else {})})
    flat = F.col("hi") <= F.col("lo")
    width = F.when(flat, F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / F.lit(bins))
    lim = (lim.select(*pool, F.log10("hi").alias("hi"), (F.log10("lo") if lower else F.lit(0.0)).alias("lo"))
           .withColumn("width", width).withColumn("s", F.when(flat, F.lit(1e-3)).otherwise(F.lit(sigma) / F.col("width"))))
    xs = attach(rows.withColumn("x", F.log10("v")), lim, pool)  # one row per pool group
    xs = xs.filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    b = np_bin(F.col("x"), F.col("lo"), F.col("width"), bins)
    hist = xs.groupBy(*part, b.alias("bin"), "lo", "hi", "s").agg(F.count(F.lit(1)).cast("double").alias("h"))
    sm = _smooth(hist, [*part, "lo", "hi"], "s", bins)
    return (sm.select(*part, "lo", "hi", F.posexplode("ds").alias("bin", "d"), F.array_max("ds").alias("_peak"))
            .select(*part, "bin", F.col("lo").cast("decimal(20,6)").alias("lo"), F.col("hi").cast("decimal(20,6)").alias("hi"),
                    F.try_divide(F.col("d"), F.col("_peak")).cast("decimal(20,6)").alias("d")))


def rank_density(acc: DataFrame, value: str, part: Sequence[str] = ("org_type",), width: float = 1.0,
                 bins: int = DENSITY_BINS, sigma_bins: float = RANK_SIGMA_BINS) -> DataFrame:
    """Share of a type's volume by account-rank percentile (the last
    ``part`` column is the type; the maximum is global over the types).

    x = (i + 0.5) / N over *all* accounts of the type (zero-volume accounts
    rank last and carry no weight), weights v / Σv for v >= 1, ``bins`` bins on
    [0, width], Gaussian σ in bins, normalised by the global maximum.  Ranks
    come from frequency rows: accounts with equal v hold a consecutive rank
    interval, which is split across bins arithmetically.
    """
    part = list(part)
    v = F.coalesce(F.col(value), F.lit(0))
    f = freq(acc.withColumn("_v", v), part, "_v", descending=True).withColumn("_before", F.col("cum") - F.col("c"))
    tot = f.groupBy(*part).agg(F.sum(F.when(F.col("v") >= 1, F.col("v") * F.col("c"))).alias("_tot"))
    f = f.filter(F.col("v") >= 1)
    f = attach(f, tot, part)
    # rank i (0-based) sits at x_i = (i + 0.5) / N on edges k * width / bins.
    # A frequency row holds ranks i0..i1; it spans bins bin(x_i0)..bin(x_i1),
    # and bin b holds the ranks lo(b) .. lo(b + 1) - 1 where lo(b) is the
    # first rank with x_i >= edge_b (checked in floating point around the
    # algebraic solution, so boundary ranks fall where a histogram puts them).
    step = F.lit(width / bins)
    n = F.col("n")

    def x(i):
        return (i + F.lit(0.5)) / n

    def lo(b):
        e = b.cast("double") * step
        c0 = F.ceil(e * n - F.lit(0.5)).cast("long")
        first = F.when(x(c0 - 1) >= e, c0 - 1).when(x(c0) >= e, c0).otherwise(c0 + 1)
        return F.when(b <= 0, F.lit(0).cast("long")).otherwise(F.greatest(first, F.lit(0).cast("long")))

    m0 = F.floor(F.lit(width) * n - F.lit(0.5)).cast("long")
    last_rank = F.when(x(m0 + 1) <= F.lit(width), m0 + 1).when(x(m0) <= F.lit(width), m0).otherwise(m0 - 1)
    f = (f.withColumn("_i0", F.col("_before")).withColumn("_i1", F.col("_before") + F.col("c") - 1)
         .withColumn("_last", last_rank).filter(F.col("_i0") <= F.col("_last")))
    b_first = np_bin(x(F.col("_i0")), F.lit(0.0), step, bins)
    b_last = np_bin(x(F.least(F.col("_i1"), F.col("_last"))), F.lit(0.0), step, bins)
    e = f.select(*part, "v", "c", "n", "_tot", "_i0", "_i1", "_last",
                 F.explode(F.sequence(b_first, b_last)).alias("bin"))
    i_lo = F.greatest(F.col("_i0"), lo(F.col("bin")))
    i_hi = F.least(F.col("_i1"), F.col("_last"),
                   F.when(F.col("bin") < bins - 1, lo(F.col("bin") + 1) - 1).otherwise(F.col("_last")))
    cnt = F.greatest(i_hi - i_lo + 1, F.lit(0))
    hist = e.groupBy(*part, "bin").agg(F.sum(cnt * F.col("v") / F.col("_tot")).alias("h"))
    smooth = _smooth(hist.withColumn("s", F.lit(float(sigma_bins))), part, "s", bins)
    sm = attach(acc.select(*part).distinct(), smooth, part, "left")  # every type, even all-zero ones
    gmax = F.max(F.array_max("ds")).over(Window.partitionBy(*part[:-1]))  # global over the types: one row per type
    zero = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.lit(0.0))
    return (sm.withColumn("ds", F.coalesce("ds", zero)).withColumn("_max", gmax)
            .select(*part, "_max", F.posexplode("ds").alias("bin", "d"))
            .select(*part, "bin", F.lit(width).alias("width"), F.try_divide(F.col("d"), F.col("_max")).cast("decimal(20,6)").alias("d")))


def weighted_quantiles(df: DataFrame, x: str, w: str | None, part: Sequence[str] = ("org_type",),
                       qs: Sequence[tuple[str, float]] = (("q1", 0.25), ("med", 0.5), ("q3", 0.75))) -> DataFrame:
    """Inverse-CDF quantiles (first x whose cumulative weight reaches q
    of the total), unweighted when ``w`` is None, plus n and Σw."""
    part = list(part)
    g = select_ranks(df.filter(F.col(x).isNotNull()), part, x, {k: share(q) for k, q in qs}, weight=w)
    if not w:
        return g.select(*part, *[k for k, _ in qs], "n")
    # without any weight no value reaches a share of it
    return g.select(*part, *[F.when(F.col("tot") > 0, F.col(k)).alias(k) for k, _ in qs], "n", F.col("tot").cast("long").alias("sum_w"))


def country_stats(df: DataFrame, part: Sequence[str] = ("country",)) -> DataFrame:
    """Per country Σ all-time downloads, n, n with a size, and linear
    quartiles of log10(size > 0)."""
    part = list(part)
    base = df.groupBy(*part).agg(F.coalesce(F.sum("downloadsAllTime"), F.lit(0)).cast("long").alias("dl"),
                                 F.count(F.lit(1)).alias("n"), F.count_if(F.col("mainSize") > 0).alias("n_size"))
    qs = (("q1", .25), ("med", .5), ("q3", .75))
    needs = {f"{k}{side}": at_index(p, side == "b") for k, p in qs for side in "ab"}
    s = select_ranks(df.filter(F.col("mainSize") > 0).withColumn("_x", F.log10("mainSize")), part, "_x", needs)
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    q = s.select(*part, *[(F.col(f"{k}a") + (at(p) - F.floor(at(p))) * (F.col(f"{k}b") - F.col(f"{k}a"))).cast("decimal(20,6)").alias(k) for k, p in qs])
    return base.join(q, part, "left")


def distinct_accounts(df: DataFrame, part: Sequence[str] = ("org_type",)) -> DataFrame:
    """Distinct accounts per group; a NULL author counts as one more
    account (as a null-aware unique count does)."""
    return df.groupBy(*part).agg(
        (F.count_distinct("author") + F.max(F.col("author").isNull().cast("int"))).alias("n_accounts"))


def top_k_with_rest(df: DataFrame, k: int, key: str, value: str, part: Sequence[str] = (),
                    rest: str = "others") -> DataFrame:
    """The top-k keys by value, everything else rolled into ``rest``
    (with its member count), each with its share of the total."""
    part = list(part)
    w = Window.partitionBy(*part).orderBy(F.col(value).desc(), F.col(key).asc())
    r = df.withColumn("_rk", F.row_number().over(w))
    lab = F.when(F.col("_rk") <= k, F.col(key)).otherwise(F.lit(rest))
    g = r.groupBy(*part, lab.alias(key)).agg(F.sum(value).cast("long").alias(value), F.count(F.lit(1)).alias("members"))
    tot = F.sum(value).over(Window.partitionBy(*part))
    return g.withColumn("share", F.try_divide(F.col(value).cast("double"), tot).cast("decimal(20,6)"))
