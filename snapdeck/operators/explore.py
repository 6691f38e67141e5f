"""User-facing queries (J1-J5, J7, J8, J10) and the filter helpers (C1-C8,
B18) they are built from.  Each is a top-N or a regrouping of an operator
result; every top-N is a per-snapshot ``row_number`` (pruned before the
shuffle) rather than a global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import has_paper, topics
from .ranking import top_rows


# --- filters (C1-C8, B18) -------------------------------------------------------

def filter_types(df: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] | None = None,
                 by: str = "org_type") -> DataFrame:
    """Drop or keep organisation types (before any share)."""
    if include is not None:
        df = df.filter(F.col(by).isin(*include))
    return df.filter(~F.col(by).isin(*exclude)) if exclude else df


def min_value(df: DataFrame, metric: str, v) -> DataFrame:
    """Value >= v."""
    return df.filter(F.col(metric) >= F.lit(v))


def tracked_only(df: DataFrame, metric: str) -> DataFrame:
    """Rows where the metric is tracked (non-NULL)."""
    return df.filter(F.col(metric).isNotNull())


def topic_filter(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """C4: rows with any of the wanted topics."""
    arr = F.array(*[F.lit(t) for t in wanted])
    return df.filter(F.arrays_overlap(topics("tags"), arr))


def thin_flag(n: Column | str, k: int = 10) -> Column:
    """Thin-sample flag."""
    c = F.col(n) if isinstance(n, str) else n
    return c < F.lit(k)


# --- queries ------------------------------------------------------------------------

def explore(panel: DataFrame, metric: str, top: int, wanted_topics: Sequence[str] | None = None,
            paper: bool | None = None, minimum=None, key: str = "_id") -> DataFrame:
    """Per snapshot the top ``top`` datasets by ``metric`` after topic /
    paper / minimum-value filters (every week at once)."""
    d = panel
    if wanted_topics:
        d = topic_filter(d, wanted_topics)
    if paper is not None:
        d = d.filter(has_paper("tags") == F.lit(paper))
    if minimum is not None:
        d = min_value(d, metric, minimum)
    return top_rows(d, ["snapshot_date"], metric, key, top)


def rank_accounts(acc: DataFrame, metric: str, n: int) -> DataFrame:
    """Per snapshot the top-n accounts by a metric (dl, dlat, lkd)."""
    return top_rows(acc, ["snapshot_date"], metric, "author", n)


def top_share(acc: DataFrame, metric: str, n: int) -> DataFrame:
    """Share of the hub total carried by the top-n accounts per snapshot."""
    tot = acc.groupBy("snapshot_date").agg(F.sum(metric).alias("total"))
    top = rank_accounts(acc, metric, n).groupBy("snapshot_date").agg(F.sum(metric).alias("top"))
    return (tot.join(top, "snapshot_date")
            .select("snapshot_date", F.col("top").cast("long").alias("top"), F.col("total").cast("long").alias("total"),
                    F.try_divide(F.col("top").cast("double"), F.col("total")).cast("decimal(20,6)").alias("share")))


def by_group(cohort: DataFrame, group: str, metric: str) -> DataFrame:
    """The ranked cohort regrouped (country, org type): accounts,
    repos, metric and the shares of repos and metric."""
    g = cohort.groupBy("snapshot_date", group).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("n").cast("long").alias("repos"),
        F.sum(metric).cast("long").alias("value"))
    w = Window.partitionBy("snapshot_date")
    return g.select("*",
                    F.try_divide(F.col("repos").cast("double"), F.sum("repos").over(w)).cast("decimal(20,6)").alias("repo_share"),
                    F.try_divide(F.col("value").cast("double"), F.sum("value").over(w)).cast("decimal(20,6)").alias("value_share"))


def donut(type_shares: DataFrame, top3: DataFrame) -> DataFrame:
    """Type share per snapshot with each type's top-3 accounts."""
    return type_shares.join(top3.select("snapshot_date", "org_type", "top3"), ["snapshot_date", "org_type"], "left")


def drill_down(acc: DataFrame, hists: DataFrame, keys: Sequence[str], author: str) -> DataFrame:
    """One organisation's weekly series with its histograms per week, one
    column per key of ``hists`` (``bin:count`` pairs in bin order; NULL for
    weeks without a value)."""
    def text(k):
        cells = F.array_sort(F.collect_list(F.when(F.col("key") == k, F.struct("bin", "c"))))  # one entry per bin
        pairs = F.transform(cells, lambda x: F.concat_ws(":", x["bin"].cast("string"), x["c"].cast("string")))
        return F.when(F.size(pairs) > 0, F.array_join(pairs, "|")).alias(k)
    h = hists.filter(F.col("author") == author).groupBy("snapshot_date").agg(*[text(k) for k in keys])
    return acc.filter(F.col("author") == author).join(h, "snapshot_date", "left")


def volume_share(panel: DataFrame, n: int) -> DataFrame:
    """J3 size-weighted: share of the hub's volume (downloads x mainSize over
    rows with author and both values) that the top ``n`` accounts by downloads
    carry per snapshot; only positive account volumes count."""
    cov = F.col("author").isNotNull() & F.col("downloads").isNotNull() & F.col("mainSize").isNotNull()
    vol = F.when(cov, F.col("downloads").cast("decimal(20,0)") * F.col("mainSize").cast("decimal(20,2)"))
    acc = panel.groupBy("snapshot_date", "author").agg(F.sum("downloads").alias("dl"),
                                                       F.sum(vol).cast("decimal(38,2)").alias("bytes"))
    hub = acc.groupBy("snapshot_date").agg(F.sum("bytes").cast("decimal(38,2)").alias("hub_bytes"))
    top = (rank_accounts(acc.filter(F.col("author").isNotNull()), "dl", n).filter(F.col("bytes") > 0)
           .groupBy("snapshot_date").agg(F.sum("bytes").cast("decimal(38,2)").alias("top_bytes")))
    share = F.try_divide(F.col("top_bytes").cast("double"), F.col("hub_bytes").cast("double"))
    return hub.join(top, "snapshot_date", "left").select(
        "snapshot_date", "hub_bytes", "top_bytes", share.cast("decimal(20,6)").alias("share"))
