"""Multi-hub account views (D3, D9, E8, E23, G1 dashboard pool, I2).

Account aggregates (``ranking.by_account``) are small relative to the panel
(one row per account and snapshot) and feed several operators; callers that
reuse them persist once.  Combining hubs is a union + one ``groupBy`` (the
same result as a full outer join with missing = 0, one shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_sig
from .longitudinal import like_gain
from .ranking import top_rows
from .snapshots import align_snapshots, with_ordinal

ACC_COLS = ["snapshot_date", "author", "dl", "lk", "dlat", "n"]


def combine_hubs(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """D3 (+D9): element-wise sum of two hubs' account aggregates on the
    aligned dates (``inner``: dates both hubs have)."""
    dates = with_ordinal(align_snapshots(a, b, how).select("snapshot_date"))  # ordinals from the dates alone
    u = a.select(*ACC_COLS).unionByName(b.select(*ACC_COLS))
    u = u.join(F.broadcast(dates), "snapshot_date")  # bounded by the calendar
    return (u.groupBy("snapshot_date", "t", "author").agg(*[F.sum(c).cast("long").alias(c) for c in ("dl", "lk", "dlat", "n")])
            .select("snapshot_date", "author", "dl", "lk", "dlat", "n", "t"))


def dashboard_pool(acc: DataFrame, n: int, part: Sequence[str] = ()) -> DataFrame:
    """G1 (dashboard): accounts in a weekly top-n by 30-day downloads, by
    all-time downloads (weeks where the hub tracks it) or by like gain over
    the previous snapshot.  ``part`` (e.g. ``mode``) computes several pools in
    one plan."""
    part = list(part)
    tracked = acc.groupBy(*part, "snapshot_date").agg(F.sum("dlat").alias("_hd")).filter(F.col("_hd") != 0)
    a = top_rows(acc, [*part, "snapshot_date"], "dl", "author", n).select(*part, "author")
    b = top_rows(acc.join(tracked.select(*part, "snapshot_date"), [*part, "snapshot_date"], "left_semi"),
                 [*part, "snapshot_date"], "dlat", "author", n).select(*part, "author")
    c = top_rows(like_gain(acc, part), [*part, "snapshot_date"], "lkd", "author", n).select(*part, "author")
    return a.unionByName(b).unionByName(c).distinct()


def account_series(acc: DataFrame, pool: DataFrame, part: Sequence[str] = ("mode",)) -> DataFrame:
    """Weekly series of the pooled accounts per mode (ds / md / cb): dl
    and dlat at 3 significant figures, likes and repo counts exact; dlat is
    NULL in weeks where the hub does not track it."""
    part = list(part)
    hub = acc.groupBy(*part, "snapshot_date").agg(F.sum("dlat").alias("_hd"))
    p = acc.join(pool.select(*part, "author"), [*part, "author"], "left_semi").join(hub, [*part, "snapshot_date"])
    return p.select(*part, "snapshot_date", "author", round_sig("dl").alias("dl"), F.col("lk"), F.col("n"),
                    F.when(F.col("_hd") != 0, round_sig("dlat")).alias("dlat"))


def modes(ds_acc: DataFrame, md_acc: DataFrame) -> DataFrame:
    """Account aggregates of the three dashboard modes in one frame: each hub
    alone (``ds``, ``md``) and both combined on their common dates (``cb``)."""
    cols = [*ACC_COLS, "t"]
    cb = combine_hubs(ds_acc, md_acc, "inner").select(*cols)
    return (ds_acc.select(F.lit("ds").alias("mode"), *cols)
            .unionByName(md_acc.select(F.lit("md").alias("mode"), *cols))
            .unionByName(cb.select(F.lit("cb").alias("mode"), *cols)))


def volume_proxy(panel: DataFrame, pool: DataFrame) -> DataFrame:
    """Size-weighted volume Σ downloads x mainSize per pooled account
    (bytes > 0) with the hub-wide volume and the download coverage (rows with
    any NULL among author / downloads / mainSize are not covered).  Products
    are summed as DECIMAL, so the result is exact and cannot overflow."""
    cov = F.col("author").isNotNull() & F.col("downloads").isNotNull() & F.col("mainSize").isNotNull()
    prod = F.col("downloads").cast("decimal(20,0)") * F.col("mainSize").cast("decimal(20,2)")
    p = panel.withColumn("_cov", cov).withColumn("_b", F.when(cov, prod))
    hub = p.groupBy("snapshot_date").agg(
        F.coalesce(F.sum("_b"), F.lit(0)).cast("decimal(38,2)").alias("hub_bytes"),
        (F.coalesce(F.sum(F.when(F.col("_cov"), F.col("downloads"))), F.lit(0)).cast("double")
         / F.greatest(F.lit(1), F.coalesce(F.sum("downloads"), F.lit(0)))).cast("decimal(20,6)").alias("dl_cov"))
    per = (p.filter("_cov").join(pool.select("author"), "author", "left_semi")
           .groupBy("snapshot_date", "author").agg(F.sum("_b").cast("decimal(38,2)").alias("bytes"))
           .filter(F.col("bytes") > 0))
    return per.join(F.broadcast(hub), "snapshot_date")  # one row per snapshot
