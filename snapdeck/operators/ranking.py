"""Top-N, pools, ranks and shares.

Every top-N is ``row_number() <= N`` over a partitioned window with a total
order (metric DESC, then key ASC).  Spark plans this as a WindowGroupLimit:
each map task keeps only its local top N per group before the shuffle, so a
hot group (e.g. ``individual`` with most rows) ships N rows per task, not
its whole population.  ``collect_list`` is never used to rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ORG_TYPES
from .snapshots import densify, type_grid


def _zsum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def top_rows(df: DataFrame, part: Sequence[str], metric: str, key: str, n: int, rk: str = "rk") -> DataFrame:
    """Rows with rank <= n per partition (metric DESC, key ASC with a NULL key
    last); NULL metrics never rank."""
    w = Window.partitionBy(*part).orderBy(F.col(metric).desc(), F.col(key).asc_nulls_last())
    return (df.filter(F.col(metric).isNotNull()).withColumn(rk, F.row_number().over(w))
            .filter(F.col(rk) <= n))


def latest(panel: DataFrame) -> DataFrame:
    """Rows of the latest snapshot.  The date is a scalar subquery on the
    partition column, so only that snapshot's files are read."""
    return panel.filter(F.col("snapshot_date") == panel.agg(F.max("snapshot_date").alias("d")).scalar())


def complete(panel: DataFrame) -> DataFrame:
    """Rows of all snapshots but the last, which may still be filling."""
    return panel.filter(F.col("snapshot_date") < panel.agg(F.max("snapshot_date").alias("d")).scalar())


def topn_items(panel: DataFrame, n: int = 10, metric: str = "downloads", by: str = "org_type",
               types: Sequence[str] = ORG_TYPES) -> DataFrame:
    """per (snapshot, type) the total of ``metric`` and the sum of its top-N rows."""
    tot = panel.groupBy("snapshot_date", by).agg(_zsum(metric).alias("total"))
    top = (top_rows(panel, ["snapshot_date", by], metric, "_id", n)
           .groupBy("snapshot_date", by).agg(_zsum(metric).alias("topn")))
    grid = type_grid(panel.select("snapshot_date").distinct(), types, by)
    v = tot.join(top, ["snapshot_date", by], "left")
    return densify(v, grid, ["snapshot_date", by], {"total": 0, "topn": 0})


def by_account(panel: DataFrame, by_type: bool = False, keep_null_author: bool = False) -> DataFrame:
    """Per (snapshot, author): dl, lk, dlat, n and the org type.

    Null authors are dropped (pandas / dashboard semantics) unless
    ``keep_null_author`` (the org-type trends keep them as one group).
    ``dlat`` is 0 when the hub does not track it.  The org type is the
    smallest non-null stored value (functional in author, so a deterministic
    pick)."""
    keys = ["snapshot_date", "t", "author"] + (["org_type"] if by_type else [])
    aggs = [_zsum("downloads").alias("dl"), _zsum("likes").alias("lk"), _zsum("downloadsAllTime").alias("dlat"),
            F.count(F.lit(1)).alias("n")]
    if not by_type:
        aggs.append(F.min("org_type").alias("org_type"))
    p = panel if keep_null_author else panel.filter(F.col("author").isNotNull())
    return p.groupBy(*keys).agg(*aggs)


def tracked_snapshots(panel: DataFrame, metric: str = "downloadsAllTime") -> DataFrame:
    """Snapshots where ``metric`` has at least one value (the tracking gate)."""
    return panel.groupBy("snapshot_date").agg(F.count(metric).alias("_n")).filter("_n > 0").select("snapshot_date")


def account_values(panel: DataFrame, metric: str, part: Sequence[str] = ("snapshot_date", "org_type")) -> DataFrame:
    """Per-account sums of one metric (NULL = 0) inside ``part``; a NULL
    author forms its own group, as a null-keeping group-by does (used by the
    distribution views at account grain)."""
    return panel.groupBy(*part, "author").agg(_zsum(metric).alias("v"))


def topn_accounts(panel: DataFrame, n: int = 10, metric: str | None = "downloads", by: str = "org_type",
                  types: Sequence[str] = ORG_TYPES) -> DataFrame:
    """F2 (+C7): per (snapshot, type): total, top-N-account sum (metric summed
    per author first; row count when ``metric`` is None) and the top-3 accounts
    with a non-zero value, as ``author=value`` joined in rank order."""
    val = F.count(F.lit(1)) if metric is None else _zsum(metric)
    acc = panel.groupBy("snapshot_date", by, "author").agg(val.cast("long").alias("val"))
    w = Window.partitionBy("snapshot_date", by).orderBy(F.col("val").desc(), F.col("author").asc_nulls_last())
    ranked = acc.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= max(n, 3))
    tot = acc.groupBy("snapshot_date", by).agg(_zsum("val").alias("total"))
    top = ranked.groupBy("snapshot_date", by).agg(
        _zsum(F.when(F.col("rk") <= n, F.col("val"))).alias("topn"),
        F.array_sort(F.collect_list(F.when((F.col("rk") <= 3) & (F.col("val") != 0),
                                           F.struct("rk", F.concat_ws("=", F.coalesce("author", F.lit("")),
                                                                      F.col("val").cast("string")).alias("s"))))
                     ).alias("_top3"))
    v = tot.join(top, ["snapshot_date", by], "left").withColumn(
        "top3", F.array_join(F.transform("_top3", lambda x: x["s"]), ",")).drop("_top3")
    grid = type_grid(panel.select("snapshot_date").distinct(), types, by)
    return densify(v, grid, ["snapshot_date", by], {"total": 0, "topn": 0, "top3": ""})


def group_share(df: DataFrame, by: Sequence[str], value: str, alias: str = "share", bounded: bool = False) -> DataFrame:
    """value / Σ value within ``by`` (NULL when the group total is 0).

    The group totals are aggregated first (partial sums, one small shuffle)
    and joined back, instead of a window that would put a whole hot group
    into one task.  ``bounded`` states that the groups are few whatever the
    rows (snapshots x types); their totals are then broadcast."""
    by = list(by)
    tot = df.groupBy(*by).agg(F.sum(value).alias("_gt"))
    return (df.join(F.broadcast(tot) if bounded else tot, by).withColumn(alias, F.try_divide(F.col(value).cast("double"), F.col("_gt")))
            .drop("_gt"))


def account_ranks(acc: DataFrame, metrics: Sequence[str] = ("dl", "lk", "dlat"), top: int = 2000,
                  part: Sequence[str] = ("snapshot_date",), tracked: DataFrame | None = None) -> DataFrame:
    """ordinal ranks per snapshot and metric (NULL metric = 0), over all
    accounts (variant ``a``) and over non-individual accounts (``o``).  The
    metrics are stacked into rows first, so there is one window per variant,
    partitioned by (snapshot, metric); only ranks <= top are kept, which lets
    the window prune before the shuffle.  ``tracked`` (snapshots with
    all-time data) restricts the ``dlat`` ranks to tracked snapshots."""
    part = list(part)
    st = acc.select(*part, "author", "org_type", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("long").alias("v")) for m in metrics
    ])).alias("s")).select(*part, "author", "org_type", "s.*")
    if tracked is not None:
        tr = tracked.select("snapshot_date").withColumn("_tr", F.lit(True))  # one row per snapshot
        st = (st.join(tr, "snapshot_date", "left")
              .filter((F.col("metric") != "dlat") | F.col("_tr").isNotNull()).drop("_tr"))
    out = None
    for variant, d in (("a", st), ("o", st.filter(F.col("org_type") != "individual"))):
        r = top_rows(d, [*part, "metric"], "v", "author", top).select(
            *part, "author", "metric", F.lit(variant).alias("variant"), F.col("rk").cast("int").alias("rk"))
        out = r if out is None else out.unionByName(r)
    return out


def ever_in_pool(df: DataFrame, key: str, metrics: Sequence[str], n: int) -> DataFrame:
    """G1 + H1: keys ever in the weekly top-n of any metric (union of pools)."""
    pools = [top_rows(df, ["snapshot_date"], m, key, n).select(key) for m in metrics]
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out.distinct()


def org_pool(panel: DataFrame, n: int = 2000, names: int = 3) -> DataFrame:
    """G1 of the organisation trends: accounts ever in a weekly top ``n`` by
    downloads, likes, repositories or (tracked snapshots) all-time downloads,
    or among the ``names`` largest non-zero accounts of their type by any of
    these; with how often each rule took them.  Untracked snapshots have no
    all-time ranks; the NULL-author group can hold a rank but is no account."""
    aggs = [_zsum("downloads").alias("dl"), _zsum("likes").alias("lk"), F.count(F.lit(1)).alias("n"),
            F.sum("downloadsAllTime").alias("dlat")]
    typed = panel.groupBy("snapshot_date", "org_type", "author").agg(*aggs)
    acc = typed.groupBy("snapshot_date", "author").agg(*[F.sum(c).alias(c) for c in ("dl", "lk", "n", "dlat")])
    tracked = F.broadcast(tracked_snapshots(panel).withColumn("_t", F.lit(True)))  # one row per snapshot

    def stack(d, *keys):
        s = d.select("snapshot_date", "author", *keys, F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("long").alias("v"))
            for m in ("dl", "lk", "n", "dlat")])).alias("s")).select("snapshot_date", "author", *keys, "s.*")
        return s.join(tracked, "snapshot_date", "left").filter((F.col("metric") != "dlat") | F.col("_t"))

    top = top_rows(stack(acc), ["snapshot_date", "metric"], "v", "author", n)
    top3 = top_rows(stack(typed, "org_type").filter(F.col("v") != 0), ["snapshot_date", "org_type", "metric"],
                    "v", "author", names)
    return (top.select("author", F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(top3.select("author", F.lit(0).alias("a"), F.lit(1).alias("b")))
            .filter(F.col("author").isNotNull())
            .groupBy("author").agg(F.sum("a").cast("long").alias("top_n"), F.sum("b").cast("long").alias("type_top")))


def name_order(names: DataFrame, name: str) -> DataFrame:
    """Case-insensitive name order of a bounded list of labels (equal
    folded names in plain order); NULL names are left out."""
    w = Window.orderBy(F.lower(name), F.col(name))  # labels of one display
    return names.filter(F.col(name).isNotNull()).select(name, F.row_number().over(w).alias("position"))


def pool_rows(df: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the pool (semi join; AQE broadcasts a
    small pool at runtime, sort-merge beyond the threshold)."""
    return df.join(pool.select(key), key, "left_semi")


def top_latest(panel: DataFrame, n: int, metric: str, key: str = "_id") -> DataFrame:
    """The N largest rows of the latest snapshot (TakeOrderedAndProject)."""
    return latest(panel).filter(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), F.col(key).asc()).limit(n)


def membership(panel: DataFrame, n: int = 10, metric: str = "downloads") -> DataFrame:
    """Per (_id, type): snapshots in the weekly within-type top-N, mean
    within-type share during those snapshots, latest id."""
    tot = panel.groupBy("snapshot_date", "org_type").agg(F.sum(metric).alias("_tot"))
    top = top_rows(panel, ["snapshot_date", "org_type"], metric, "_id", n)
    j = top.join(tot, ["snapshot_date", "org_type"])
    share = F.try_divide(F.col(metric).cast("double"), F.col("_tot"))
    return (j.withColumn("_share", share)
            .groupBy("_id", "org_type")
            .agg(F.max_by("id", "t").alias("id"), F.count(F.lit(1)).alias("snapshots_in_topN"),
                 F.avg("_share").cast("decimal(20,6)").alias("avg_share_in_org")))


def top_k_panel(acc_latest: DataFrame, k: int = 7, metric: str = "dl", by: str = "org_type") -> DataFrame:
    """Per type its top-k accounts, the group total over those members,
    and the group order by that total (largest first)."""
    top = top_rows(acc_latest, [by], metric, "author", k)
    gt = F.sum(metric).over(Window.partitionBy(by))
    out = top.withColumn("group_total", gt.cast("long"))
    gr = out.select(by, "group_total").distinct().withColumn(
        "group_rank", F.row_number().over(Window.orderBy(F.col("group_total").desc(), F.col(by).asc())))
    return out.join(gr, [by, "group_total"]).select(by, "author", F.col(metric).alias("value"),
                                                   F.col("rk").cast("int").alias("rk"), "group_total",
                                                   F.col("group_rank").cast("int").alias("group_rank"))
