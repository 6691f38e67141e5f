"""Topic vocabulary, per-topic series and licence breakdowns (E5, E6, E9,
E10, H4).

Tag bags are reduced per row *before* any explode (``topics`` maps and
filters the bag and drops duplicates), so the exploded stream carries only
the (entity, topic) pairs that matter and needs no dedup shuffle: one row
per (_id, snapshot) already makes (_id, topic) unique within a snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LICENSE_GROUPS, ORG_GROUPS, TASK_PREFIX, TOP_FREEFORM
from ..functions.tags import license_from_tags, license_group, topics
from .ranking import latest
from .snapshots import densify, snapshot_dim


def topic_counts(panel: DataFrame) -> DataFrame:
    """(topic, n distinct _id, is_task) over the given rows.  ``is_task`` is
    true when any row carries ``task_categories:<topic>`` (also when the same
    row carries the bare tag)."""
    arr = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    e = panel.select("_id", arr.alias("tags"), F.explode(topics("tags")).alias("topic"))
    e = e.withColumn("is_task", F.array_contains("tags", F.concat(F.lit(TASK_PREFIX), F.col("topic"))))
    return e.groupBy("topic").agg(F.count_distinct("_id").alias("n"), F.max("is_task").alias("is_task"))


def topic_vocab(panel: DataFrame, top: int = TOP_FREEFORM, latest_only: bool = True) -> DataFrame:
    """E5: vocabulary of the latest snapshot (or of all rows when
    ``latest_only`` is false): every task, then the ``top``
    most frequent free-form topics that are not task names (H4).  ``idx`` is
    the vocabulary position: tasks by n desc, then free-form by n desc, ties
    by name."""
    c = topic_counts(latest(panel) if latest_only else panel)
    tasks = c.filter("is_task").select("topic", "n", F.lit("task").alias("kind"))
    free = (c.filter(~F.col("is_task"))  # one row per topic: none of these is a task name
            .orderBy(F.col("n").desc(), F.col("topic").asc()).limit(top)
            .select("topic", "n", F.lit("community").alias("kind")))
    v = tasks.unionByName(free)
    # ordinal over the vocabulary only (tasks + `top` rows)
    w = Window.orderBy(F.when(F.col("kind") == "task", 0).otherwise(1), F.col("n").desc(), F.col("topic"))
    return v.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def freeform_topics(panel: DataFrame) -> DataFrame:
    """H4: free-form topics (never a task) with their counts, over all rows."""
    return topic_counts(panel).filter(~F.col("is_task")).select("topic", "n")


def topic_series(panel: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per (snapshot, vocabulary topic): n, dl, dlat, lk over the distinct
    (_id, topic) rows; a topic absent in a snapshot is (0, 0, NULL, 0), and
    ``dlat`` is NULL in untracked snapshots."""
    e = panel.select("snapshot_date", "downloads", "downloadsAllTime", "likes",
                     F.explode(topics("tags")).alias("topic"))
    e = e.join(vocab.select("topic"), "topic", "left_semi")  # task names come from users: left to the planner
    g = e.groupBy("snapshot_date", "topic").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("downloads"), F.lit(0)).cast("long").alias("dl"),
        F.coalesce(F.sum("downloadsAllTime"), F.lit(0)).cast("long").alias("dlat"),
        F.coalesce(F.sum("likes"), F.lit(0)).cast("long").alias("lk"))
    gate = panel.groupBy("snapshot_date").agg(F.count("downloadsAllTime").alias("_tr"))
    grid = _grid(panel, vocab)
    d = grid.join(g, ["snapshot_date", "topic"], "left").join(F.broadcast(gate), "snapshot_date")  # per snapshot
    return d.select("snapshot_date", "topic", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                    F.coalesce("dl", F.lit(0)).cast("long").alias("dl"),
                    F.when(F.col("_tr") > 0, F.col("dlat")).alias("dlat"),
                    F.coalesce("lk", F.lit(0)).cast("long").alias("lk"))


def _grid(panel: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vocabulary x snapshots, generated from the array of dates (a scalar subquery, one value per snapshot)
    exploded on each topic row: no join, and no vocabulary in one value."""
    dates = snapshot_dim(panel).agg(F.array_sort(F.collect_list("snapshot_date"))).scalar()
    return vocab.select("topic", F.explode(dates).alias("snapshot_date"))


def license_long(panel: DataFrame) -> DataFrame:
    """Individuals dropped; snapshot x org group x licence group -> n,
    downloads (the first ``license:`` tag decides)."""
    p = panel.filter(F.col("org_type") != "individual")
    grp = F.when(F.col("org_type") == "company", F.lit("company")).otherwise(F.lit("public organisations"))
    return (p.select("snapshot_date", grp.alias("org_group"),
                     license_group(license_from_tags("tags")).alias("license_group"), "downloads")
            .groupBy("snapshot_date", "org_group", "license_group")
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("downloads"), F.lit(0)).cast("long").alias("downloads")))


def license_shares(long: DataFrame, dims: DataFrame, groups: Sequence[str] = ORG_GROUPS,
                   lic: Sequence[str] = LICENSE_GROUPS) -> DataFrame:
    """Dense 2 x 6 cells per snapshot, share of n and of downloads within
    the org group (0 where the group is empty), plus the absolute values."""
    grid = dims.select("snapshot_date",
                       F.explode(F.array(*[F.struct(F.lit(g).alias("org_group"), F.lit(l).alias("license_group"))
                                           for g in groups for l in lic])).alias("c")).select("snapshot_date", "c.*")
    d = densify(long, grid, ["snapshot_date", "org_group", "license_group"], {"n": 0, "downloads": 0})
    w = Window.partitionBy("snapshot_date", "org_group")
    def share(c):
        return F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(w)), F.lit(0.0)).cast("decimal(20,6)")
    return d.select("snapshot_date", "org_group", "license_group", F.col("n").cast("long").alias("n"),
                    "downloads", share("n").alias("share_n"), share("downloads").alias("share_dl"))
