"""End-to-end builds: the reference's two-pass payload builds as Spark jobs.

``trend_build`` mirrors the dataset trend build (pass 1: hub totals, topic
vocabulary and per-topic series, weekly top pools incl. growth; pass 2: the
pooled datasets' rounded series and latest metadata).  ``org_build`` mirrors
the organisation-type build (per-type vectors, top-N concentration, account
ranks and pool, size statistics and rank buckets, histograms, frozen weeks
and smoothed stacked series).  Every table is written with ``write_result``
under ``out``; small intermediate tables that later steps reuse (vocabulary,
pools) are written first and read back, which also cuts their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import HIST_COLS, HIST_EDGES, ORG_TREND_POOL, TOP_ACCOUNT_BUCKETS
from ..functions.numeric import log10_pos
from ..functions.tags import has_paper, size_log10_mid, topic_ids
from ..operators import distributions as dist
from ..operators import longitudinal, ranking, topics, trends
from ..sources.ingest import write_result


def _write(df: DataFrame, out: str, name: str) -> str:
    path = f"{out.rstrip('/')}/{name}"
    write_result(df, path, "parquet")
    return path


def trend_build(panel: DataFrame, out: str, pool: int = 1000, top_freeform: int = 60) -> dict[str, str]:
    """Dataset trend tables; returns {table: path}."""
    spark = panel.sparkSession
    paths = {"hub": _write(trends.hub_totals(panel.withColumn("has_paper", has_paper("tags")), "has_paper"),
                           out, "hub")}
    paths["vocab"] = _write(topics.topic_vocab(panel, top_freeform), out, "vocab")
    vocab = spark.read.parquet(paths["vocab"])
    paths["topics"] = _write(topics.topic_series(panel, vocab), out, "topics")
    ids = ranking.ever_in_pool(panel, "_id", ["downloads", "likes", "downloadsAllTime"], pool)
    # stored rows of known size: the planner broadcasts their keys or not by that size
    stored = longitudinal.growth(panel, top=pool, cut=lambda df, name: spark.read.parquet(_write(df, out, name)))
    ids = ids.unionByName(stored.select("_id")).distinct()
    paths["pool"] = _write(ids, out, "pool")
    pooled = spark.read.parquet(paths["pool"])
    paths["series"] = _write(longitudinal.entity_series(panel, pooled), out, "series")
    vmap = vocab.agg(F.map_from_entries(F.collect_list(F.struct("topic", "idx")))).scalar()  # tasks + top
    meta = (longitudinal.latest_attrs(panel.join(pooled, "_id", "left_semi")).withColumn("_vm", vmap)
            .select("_id", "id", "org_type", topic_ids("tags", F.col("_vm")).alias("topic_ids"),
                    F.transform(F.filter(F.coalesce("tags", F.array().cast("array<string>")),
                                         lambda x: x.startswith("arxiv:")),
                                lambda x: F.substring(x, 7, 1 << 30)).alias("arxiv")))
    paths["meta"] = _write(meta, out, "meta")
    paths["bounds"] = _write(longitudinal.series_bounds(panel.join(pooled, "_id", "left_semi"),
                                                        ["downloads", "downloadsAllTime", "likes"]), out, "bounds")
    return paths


def org_build(panel: DataFrame, out: str, top_n: int = 10, top_pool: int = ORG_TREND_POOL) -> dict[str, str]:
    """Organisation-type tables over a panel with resolved types; returns {table: path}."""
    spark = panel.sparkSession
    paths = {"by_type": _write(trends.type_vectors(panel), out, "by_type")}
    conc = None
    for m in ("downloads", "likes", "downloadsAllTime"):
        items = ranking.topn_items(panel, n=top_n, metric=m).withColumn("metric", F.lit(m))
        accts = ranking.topn_accounts(panel, n=top_n, metric=m).select(
            "snapshot_date", "org_type", F.col("topn").alias("topn_accounts"), "top3")
        t = items.join(accts, ["snapshot_date", "org_type"])
        conc = t if conc is None else conc.unionByName(t)
    paths["concentration"] = _write(conc, out, "concentration")
    paths["accounts_n"] = _write(ranking.topn_accounts(panel, n=top_n, metric=None), out, "accounts_n")
    acc = ranking.by_account(panel, keep_null_author=True)
    tracked = ranking.tracked_snapshots(panel)
    paths["ranks"] = _write(ranking.account_ranks(acc, top=top_pool, tracked=tracked), out, "ranks")
    ranks = spark.read.parquet(paths["ranks"])
    paths["pool"] = _write(ranking.org_pool(panel, top_pool).select("author"), out, "pool")
    pool = spark.read.parquet(paths["pool"])
    paths["org_series"] = _write(ranking.pool_rows(acc, pool, "author"), out, "org_series")
    sized = panel.withColumn("x", size_log10_mid("tags")).filter(F.col("x").isNotNull())
    weights = {"dl": "downloads", "lk": "likes", "dlat": "downloadsAllTime"}
    paths["size"] = _write(dist.size_stats(sized, "x", weights, part=["snapshot_date", "org_type"]), out, "size")
    paths["size_f"] = _write(dist.bucket_stats(sized, ranks, "x", weights, TOP_ACCOUNT_BUCKETS,
                                               part=["snapshot_date"]), out, "size_f")
    if "mainSize" in panel.columns:  # absent before the byte-size era
        sized_b = panel.withColumn("x", log10_pos("mainSize")).filter(F.col("x").isNotNull())
        paths["size_b"] = _write(dist.size_stats(sized_b, "x", weights, part=["snapshot_date", "org_type"]), out, "size_b")
        paths["size_fb"] = _write(dist.bucket_stats(sized_b, ranks, "x", weights, TOP_ACCOUNT_BUCKETS,
                                                    part=["snapshot_date"]), out, "size_fb")
    latest = ranking.latest(panel).join(pool, "author", "left_semi")
    paths["hists"] = _write(dist.account_hists(latest, HIST_COLS, HIST_EDGES), out, "hists")
    paths["frozen"] = _write(longitudinal.frozen(panel), out, "frozen")
    paths["drivers"] = _write(longitudinal.drivers(panel), out, "drivers")
    return paths
