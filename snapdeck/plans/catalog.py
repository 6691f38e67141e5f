"""The query catalogue: every operator applied to the driver-table panel.

Each entry is ``(spark, sf_dir) -> DataFrame`` and has a same-named SQL
statement in :mod:`snapdeck.plans.oracle` unless noted there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adoption as adopt
from ..operators import distributions as dist
from ..functions import tags as tagfn
from ..functions.numeric import log10_pos, round_sig_float
from ..operators import enrich, hubs, longitudinal, profile, ranking, topics, trends
from ..operators import explore as explorer
from ..operators.snapshots import first_tracked as tracked_from
from ..operators.snapshots import snapshot_dim
from ..sources import driver
from ..sources.readers import known_countries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def baked(spark, sf):
    return enrich.resolve_org_type(driver.panel(spark, sf), regime="baked")


def by_id(spark, sf):
    """The baked panel laid out by ``_id``: what groups or windows by ``_id`` needs no exchange."""
    return enrich.resolve_org_type(driver.panel_by_id(spark, sf), regime="baked")


def rejoined(spark, sf):
    """The panel under regime b (scrape type first), stored once per application."""
    return driver.materialize(spark, ("rejoined", sf), lambda: enrich.resolve_org_type(
        driver.panel(spark, sf), driver.orgs_dim(spark, sf), regime="rejoined"))


@query
def metric_by_type(spark, sf):
    return trends.metric_by_type(baked(spark, sf))


# --- core trends -----------------------------------------------------------

@query
def org_type_resolved(spark, sf):
    """B8 regime b (scrape type first, non-canonical -> individual), per type."""
    return rejoined(spark, sf).groupBy("snapshot_date", "org_type").agg(F.count(F.lit(1)).alias("n"))


@query
def count_by_type(spark, sf):
    return trends.count_by_type(baked(spark, sf))


@query
def type_vectors(spark, sf):
    return trends.type_vectors(rejoined(spark, sf))


@query
def hub_totals(spark, sf):
    p = driver.panel(spark, sf)
    return trends.hub_totals(p.withColumn("has_paper", tagfn.has_paper("tags")), flag="has_paper")


@query
def type_shares(spark, sf):
    """Share of all-time downloads per type, individuals excluded."""
    return trends.type_shares(trends.metric_by_type(baked(spark, sf)), "downloadsAllTime", exclude=("individual",))


@query
def company_share(spark, sf):
    """Company share of non-individual likes per snapshot."""
    s = trends.type_shares(trends.metric_by_type(baked(spark, sf)), "likes", exclude=("individual",))
    return s.filter(F.col("org_type") == "company").select("snapshot_date", "value", "total", "share")


@query
def presence_outcome(spark, sf):
    return trends.presence_outcome(rejoined(spark, sf))


# --- ranking -----------------------------------------------------------------

@query
def topn_items(spark, sf):
    return ranking.topn_items(baked(spark, sf), n=10)


@query
def topn_accounts(spark, sf):
    return ranking.topn_accounts(rejoined(spark, sf), n=2)


@query
def topn_accounts_count(spark, sf):
    """F2 by number of repositories."""
    return ranking.topn_accounts(rejoined(spark, sf), n=2, metric=None)


@query
def org_pool(spark, sf):
    """G1 of the organisation trends, with how often each rule took an account."""
    return ranking.org_pool(rejoined(spark, sf), n=2)


@query
def by_account(spark, sf):
    return ranking.by_account(driver.panel(spark, sf)).drop("t")


@query
def account_ranks(spark, sf):
    """F6 as in the org-type trends: null authors form a group; all-time
    ranks only where all-time downloads are tracked."""
    p = rejoined(spark, sf)
    acc = ranking.by_account(p, keep_null_author=True)
    return ranking.account_ranks(acc, top=2000, tracked=ranking.tracked_snapshots(p))


@query
def ever_in_pool(spark, sf):
    """G1: datasets ever in a weekly top-100 by 30-day, likes, all-time or growth."""
    from ..operators import longitudinal
    p = driver.panel(spark, sf)
    pool = ranking.ever_in_pool(p, "_id", ["downloads", "likes", "downloadsAllTime"], 100)
    g = longitudinal.growth(p, top=100).select("_id")
    return pool.unionByName(g).distinct()


@query
def pool_series(spark, sf):
    """G2 + D7: the full rows of the accounts ever in a weekly top-5 pool."""
    acc = _acc_ds(spark, sf)
    pool = ranking.ever_in_pool(acc, "author", ["dl", "lk"], 5)
    return ranking.pool_rows(acc, pool, "author").drop("t")


@query
def top_latest(spark, sf):
    """The 100 largest datasets of the last complete snapshot by all-time downloads."""
    return ranking.top_latest(ranking.complete(driver.panel(spark, sf)), 100, "downloadsAllTime").select(
        "_id", "id", "downloadsAllTime")


@query
def topn_membership(spark, sf):
    return ranking.membership(baked(spark, sf), n=10)


@query
def top7_per_type(spark, sf):
    acc = ranking.by_account(rejoined(spark, sf))
    return ranking.top_k_panel(ranking.latest(ranking.complete(acc)), k=2, metric="dl")


@query
def group_share(spark, sf):
    """each dataset's share of its type's 30-day downloads, per snapshot."""
    d = ranking.group_share(baked(spark, sf), ["snapshot_date", "org_type"], "downloads", bounded=True)
    return d.select("snapshot_date", "_id", "org_type", F.col("share").cast("decimal(20,8)").alias("share"))


# --- longitudinal ------------------------------------------------------------

@query
def weekly_spikes(spark, sf):
    return longitudinal.spikes(by_id(spark, sf), top=5).drop("t")


@query
def spike_summary(spark, sf):
    return longitudinal.spike_summary(longitudinal.spikes(by_id(spark, sf), top=5), top=25)


@query
def account_gain(spark, sf):
    return longitudinal.like_gain(_acc_ds(spark, sf)).drop("t")


@query
def newly_added(spark, sf):
    return longitudinal.newly_added(by_id(spark, sf))


@query
def newly_added_cumulative(spark, sf):
    return longitudinal.newly_added_cumulative(driver.panel_by_id(spark, sf))


@query
def growth_since_baseline(spark, sf):
    return longitudinal.growth(driver.panel_by_id(spark, sf), top=100)


@query
def latest_attrs(spark, sf):
    a = longitudinal.latest_attrs(driver.panel_by_id(spark, sf))
    return a.withColumn("tags", F.array_join(F.array_sort("tags"), "|"))


@query
def series_bounds(spark, sf):
    return longitudinal.series_bounds(driver.panel_by_id(spark, sf), ["downloads", "downloadsAllTime"])


@query
def trimmed_series(spark, sf):
    """F9 over all datasets: series from first to last value, gaps as NULL."""
    return longitudinal.trimmed_series(driver.panel_by_id(spark, sf), ["downloads", "downloadsAllTime"])


@query
def first_tracked(spark, sf):
    """the hub's first snapshot with a value, per metric."""
    p = driver.panel(spark, sf)
    d = p.agg(*[tracked_from(p, m).alias(m) for m in ("downloads", "likes", "downloadsAllTime")])
    return d.select(F.explode(F.create_map(*[x for m in d.columns for x in (F.lit(m), F.col(m))])).alias("metric", "t"))


@query
def entity_history(spark, sf):
    """The full history of one dataset looked up by its current name."""
    h = longitudinal.entity_history(driver.panel_by_id(spark, sf), "Customer#000000007")
    return h.withColumn("tags", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|"))


@query
def frozen_snapshots(spark, sf):
    return longitudinal.frozen(driver.panel(spark, sf))


@query
def smoothed_series(spark, sf):
    return longitudinal.drivers(rejoined(spark, sf))


@query
def entity_series(spark, sf):
    """Rounded series of the datasets ever in a weekly top-20."""
    p = driver.panel(spark, sf)
    pool = ranking.ever_in_pool(p, "_id", ["downloads", "likes", "downloadsAllTime"], 20)
    return longitudinal.entity_series(p, pool).drop("t")


# --- tags, topics, licences ---------------------------------------------------

@query
def tag_topics(spark, sf):
    """B1 over every tag of every row: tag -> topic, with row counts."""
    from ..functions.tags import topic
    e = driver.panel(spark, sf).select(F.explode("tags").alias("tag"))
    return e.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("topic", topic("tag"))


@query
def has_paper(spark, sf):
    """B2 + B3 per row."""
    from ..functions.tags import arxiv_ids, has_paper as hp
    p = driver.panel(spark, sf)
    return p.select("snapshot_date", "_id", hp("tags").alias("has_paper"),
                    F.array_join(arxiv_ids("tags"), "|").alias("arxiv"))


@query
def license_groups(spark, sf):
    """B4 + B5: first licence tag and its group, row counts."""
    from ..functions.tags import license_from_tags, license_group
    p = driver.panel(spark, sf).select(license_from_tags("tags").alias("license"))
    return p.groupBy("license").agg(F.count(F.lit(1)).alias("n")).withColumn("license_group", license_group("license"))


@query
def size_midpoints(spark, sf):
    """Rows per size midpoint (NULL = no or unmapped size tag) and type."""
    from ..functions.tags import size_log10_mid
    p = baked(spark, sf).select("org_type", size_log10_mid("tags").alias("x"))
    return p.groupBy("org_type", "x").agg(F.count(F.lit(1)).alias("n"))


def _vocab(spark, sf):
    return topics.topic_vocab(ranking.complete(driver.panel(spark, sf)), top=60)


@query
def topic_vocab(spark, sf):
    """E5 over the last complete snapshot."""
    return _vocab(spark, sf)


@query
def topic_series(spark, sf):
    p = driver.panel(spark, sf)
    return topics.topic_series(p, _vocab(spark, sf))


@query
def freeform_topics(spark, sf):
    return topics.freeform_topics(driver.panel(spark, sf))


@query
def license_long(spark, sf):
    return topics.license_long(baked(spark, sf))


@query
def license_shares(spark, sf):
    p = baked(spark, sf)
    return topics.license_shares(topics.license_long(p), snapshot_dim(p))


@query
def round_sig(spark, sf):
    """Account series rounded to 3 significant figures."""
    from ..functions.numeric import round_sig as rs
    acc = _acc_ds(spark, sf)
    return acc.select("snapshot_date", "author", "dl", rs("dl").alias("dl_r"), rs("dlat").alias("dlat_r"),
                      rs(F.col("lk") * 997).alias("lk_r"))


@query
def parse_abbrev(spark, sf):
    """B11 over every count-like token of every document text."""
    from ..functions.numeric import parse_abbrev as pa
    d = driver.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([0-9][0-9.,]*[ ]?[kKmM]?)"), 1)).alias("pos", "token"))
    return d.select("doc_id", "pos", "token", pa("token").alias("value"))


# --- adoption ---------------------------------------------------------------------

@query
def adoption(spark, sf):
    return adopt.adoption(driver.model_links(spark, sf))


@query
def adoption_totals(spark, sf):
    return adopt.adoption_totals(driver.model_links(spark, sf))


@query
def adoption_join(spark, sf):
    p = driver.panel(spark, sf).select("snapshot_date", "_id", "id")
    return adopt.adoption_join(p, adopt.adoption(driver.model_links(spark, sf)))


def _impact(spark, sf, top):
    p = enrich.resolve_org_type(driver.panel(spark, sf), regime="org_only")
    j = adopt.adoption_join(p, adopt.adoption(driver.model_links(spark, sf)))
    return adopt.impact_index(j, top=top)


@query
def impact_all(spark, sf):
    return _impact(spark, sf, None)


@query
def impact_top(spark, sf):
    return _impact(spark, sf, 50)


# --- distributions -------------------------------------------------------------

_SD = ["snapshot_date", "org_type"]


_BOX_METRICS = {"dlat": "downloadsAllTime", "lk": "likes"}


def _stacked(p, keep=("snapshot_date", "org_type", "author")):
    """Both metrics as rows (metric, value): one plan keyed by metric instead
    of one plan per metric."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in _BOX_METRICS.items()]
    return p.select(*keep, F.explode(F.array(*pairs)).alias("_m")).select(*keep, "_m.metric", "_m.value")


_SDM = ["snapshot_date", "org_type", "metric"]


@query
def box_stats(spark, sf):
    """E12 for all-time downloads and likes."""
    return dist.box_stats(_stacked(rejoined(spark, sf)), "value", part=_SDM)


@query
def concentration(spark, sf):
    """E13 at dataset grain (NULL = 0, every dataset counts)."""
    return dist.concentration(_stacked(rejoined(spark, sf)), "value", part=_SDM)


@query
def quantile_segments(spark, sf):
    """E13 + E14 at account grain: each author's datasets summed first."""
    acc = ranking.account_values(_stacked(rejoined(spark, sf)), "value", part=_SDM)
    return dist.concentration(acc, "v", part=_SDM)


def _size_rows(spark, sf, measure=None):
    """Rows with a size ``x``: the size tag's midpoint, or log10 of ``measure``."""
    x = tagfn.size_log10_mid("tags") if measure is None else log10_pos(measure)
    return rejoined(spark, sf).withColumn("x", x).filter(F.col("x").isNotNull())


_WEIGHTS = {"dl": "downloads", "lk": "likes", "dlat": "downloadsAllTime"}


@query
def size_stats(spark, sf):
    return dist.size_stats(_size_rows(spark, sf), "x", _WEIGHTS, part=_SD)


@query
def size_stats_bytes(spark, sf):
    """E15 over log10(mainSize)."""
    return dist.size_stats(_size_rows(spark, sf, "mainSize"), "x", _WEIGHTS, part=_SD)


_BUCKETS = [2, 5, 10, 20, 25]


def _buckets(spark, sf, measure=None):
    p = rejoined(spark, sf)
    ranks = ranking.account_ranks(ranking.by_account(p, keep_null_author=True), top=max(_BUCKETS),
                                  tracked=ranking.tracked_snapshots(p))
    return dist.bucket_stats(_size_rows(spark, sf, measure), ranks, "x", _WEIGHTS, _BUCKETS, part=["snapshot_date"])


@query
def bucket_stats(spark, sf):
    b = _buckets(spark, sf)
    return b.select("snapshot_date", "variant", "metric", "bkt", "org_type", "c",
                    *[F.col(c).cast("decimal(24,4)").alias(c) for c in ("sx", "sx2", "sw", "swx", "swx2")])


@query
def bucket_stats_bytes(spark, sf):
    """E16 over log10(mainSize)."""
    b = _buckets(spark, sf, "mainSize")
    return b.select("snapshot_date", "variant", "metric", "bkt", "org_type", "c",
                    *[F.col(c).cast("decimal(24,1)").alias(c) for c in ("sx", "sx2", "sw", "swx", "swx2")])


@query
def prefix_stats(spark, sf):
    return dist.prefix_stats(_buckets(spark, sf), part=["snapshot_date"])


def _hists(spark, sf):
    from ..functions.fixed import HIST_COLS, HIST_EDGES
    return dist.account_hists(driver.panel(spark, sf), HIST_COLS, HIST_EDGES, part=["snapshot_date", "author"])


@query
def account_hist(spark, sf):
    """E17 for sizes, likes and all-time downloads, in one pass."""
    return _hists(spark, sf)


@query
def log_density(spark, sf):
    """E18 for all-time downloads and likes (values >= 1, one grid per snapshot and metric)."""
    return dist.log_density(_stacked(rejoined(spark, sf)), "value", part=["snapshot_date", "metric", "org_type"],
                            pool=["snapshot_date", "metric"])


@query
def size_density(spark, sf):
    return dist.log_density(rejoined(spark, sf), "mainSize", part=_SD, lower="p0.1", strict_positive=True, pool=["snapshot_date"])


@query
def rank_density(spark, sf):
    acc = ranking.account_values(rejoined(spark, sf), "downloadsAllTime")
    a = dist.rank_density(acc, "v", part=_SD, width=1.0)
    b = dist.rank_density(acc, "v", part=_SD, width=0.1)
    return a.unionByName(b)


@query
def weighted_quantiles(spark, sf):
    p = rejoined(spark, sf).filter(F.col("mainSize") > 0)
    u = dist.weighted_quantiles(p, "mainSize", None, part=_SD)
    w = dist.weighted_quantiles(p, "mainSize", "downloadsAllTime", part=_SD).select(
        *_SD, F.col("q1").alias("w_q1"), F.col("med").alias("w_med"), F.col("q3").alias("w_q3"), "sum_w")
    return u.join(w, _SD)


def _with_country(spark, sf):
    """Every row with its owner's country (a miss is ``unknown``)."""
    return enrich.country_join(driver.panel(spark, sf), known_countries(driver.countries_dim(spark, sf)))


@query
def country_stats(spark, sf):
    """E24 per snapshot over all rows."""
    return dist.country_stats(_with_country(spark, sf), part=["snapshot_date", "country"])


@query
def country_top_rest(spark, sf):
    """Top-3 countries per snapshot plus the rolled-up rest."""
    c = dist.country_stats(_with_country(spark, sf), part=["snapshot_date", "country"])
    return dist.top_k_with_rest(c.select("snapshot_date", "country", "dl"), 3, "country", "dl", part=["snapshot_date"])


@query
def region_rollup(spark, sf):
    """The countries rolled up to display regions, per snapshot."""
    c = dist.country_stats(_with_country(spark, sf), part=["snapshot_date", "country"])
    return c.groupBy("snapshot_date", enrich.region_of(F.col("country")).alias("region")).agg(
        F.sum("dl").cast("long").alias("dl"), F.sum("n").cast("long").alias("n"))


# --- hubs and user-facing queries ------------------------------------------------

def _acc_ds(spark, sf):
    """E7 of the dataset hub, stored once per application (it feeds D3, D5,
    E8, E23, F6, G1 and J2-J5)."""
    return driver.materialize(spark, ("acc_ds", sf), lambda: ranking.by_account(driver.panel(spark, sf)),
                              sort=("author",))


def _acc_md(spark, sf):
    return driver.materialize(spark, ("acc_md", sf), lambda: ranking.by_account(driver.models_panel(spark, sf)),
                              sort=("author",))


def _modes(spark, sf):
    return driver.materialize(spark, ("modes", sf), lambda: hubs.modes(_acc_ds(spark, sf), _acc_md(spark, sf)),
                              sort=("mode", "author"))


@query
def combined_hubs(spark, sf):
    return hubs.combine_hubs(_acc_ds(spark, sf), _acc_md(spark, sf), how="inner")


@query
def aligned_dates(spark, sf):
    from ..operators.snapshots import align_snapshots
    a, b = driver.panel(spark, sf), driver.models_panel(spark, sf)
    return (align_snapshots(a, b, "inner").withColumn("how", F.lit("inner"))
            .unionByName(align_snapshots(a, b, "outer").withColumn("how", F.lit("outer"))))


@query
def account_totals(spark, sf):
    return trends.account_totals(_acc_ds(spark, sf))


@query
def volume_proxy(spark, sf):
    p = driver.panel(spark, sf)
    return hubs.volume_proxy(p, hubs.dashboard_pool(ranking.by_account(p), 5))


@query
def volume_rounded(spark, sf):
    """E23 with B10: hub volume at 4 and account volumes at 3 significant figures."""
    return volume_proxy(spark, sf).select(
        "snapshot_date", "author", round_sig_float("hub_bytes").cast("decimal(38,2)").alias("hub_bytes"),
        round_sig_float("bytes", 3).cast("decimal(38,2)").alias("bytes"),
        round_sig_float("dl_cov").cast("decimal(20,6)").alias("dl_cov"))


@query
def volume_share(spark, sf):
    """J3 size-weighted: volume carried by the top-5 accounts by downloads."""
    return explorer.volume_share(driver.panel(spark, sf), 5)


@query
def account_series(spark, sf):
    acc = _modes(spark, sf)
    return hubs.account_series(acc, hubs.dashboard_pool(acc, 5, ["mode"]), ["mode"])


@query
def explore(spark, sf):
    r = explorer.explore(driver.panel(spark, sf), "downloads", 20, wanted_topics=["household", "machinery"],
                         minimum=100000)
    return r.select("snapshot_date", "_id", "id", "downloads", "rk")


@query
def explore_paper(spark, sf):
    """J1 + C4: datasets with a paper, by likes and by all-time downloads."""
    p = driver.panel(spark, sf)
    out = None
    for metric in ("likes", "downloadsAllTime"):
        r = explorer.explore(p, metric, 20, paper=True, minimum=2).select(
            F.lit(metric).alias("metric"), "snapshot_date", "_id", "id", F.col(metric).alias("value"), "rk")
        out = r if out is None else out.unionByName(r)
    return out


@query
def explore_growth(spark, sf):
    """J1 ranked by growth since the first tracked all-time value."""
    p = longitudinal.with_growth(driver.panel_by_id(spark, sf))
    r = explorer.explore(p, "growth", 20, wanted_topics=["household"], minimum=1)
    return r.select("snapshot_date", "_id", "id", "growth", "rk")


@query
def rank_accounts(spark, sf):
    return explorer.rank_accounts(_acc_ds(spark, sf), "dl", 5).drop("t")


@query
def rank_modes(spark, sf):
    """J2 over the whole mode x metric matrix: top-5 accounts per (mode,
    snapshot) by 30-day downloads, all-time downloads and weekly like gain."""
    acc = _modes(spark, sf)
    gain = longitudinal.like_gain(acc, ["mode"]).select("mode", "snapshot_date", "author", F.col("lkd").alias("v"))
    out = None
    for metric, d in (("dl", acc.select("mode", "snapshot_date", "author", F.col("dl").alias("v"))),
                      ("dlat", acc.select("mode", "snapshot_date", "author", F.col("dlat").alias("v"))),
                      ("lkd", gain)):
        r = ranking.top_rows(d, ["mode", "snapshot_date"], "v", "author", 5).withColumn("metric", F.lit(metric))
        out = r if out is None else out.unionByName(r)
    return out.select("mode", "metric", "snapshot_date", "author", "v", F.col("rk").cast("int").alias("rk"))


@query
def top_share(spark, sf):
    return explorer.top_share(_acc_ds(spark, sf), "dl", 5)


@query
def cohort_country(spark, sf):
    cohort = explorer.rank_accounts(_acc_ds(spark, sf), "dl", 10)
    c = enrich.country_join(cohort, known_countries(driver.countries_dim(spark, sf)))
    return explorer.by_group(c, "country", "dl")


@query
def topn_sankey(spark, sf):
    cohort = explorer.rank_accounts(ranking.by_account(rejoined(spark, sf)), "dl", 10)
    return explorer.by_group(cohort, "org_type", "dl")


@query
def donut(spark, sf):
    p = rejoined(spark, sf)
    shares = trends.type_shares(trends.metric_by_type(p), "downloads")
    return explorer.donut(shares, ranking.topn_accounts(p, n=2))


@query
def drill_down(spark, sf):
    h = _hists(spark, sf)
    return explorer.drill_down(ranking.by_account(driver.panel(spark, sf)), h, ("hs", "hl", "hd"), "NATION_1").drop("t")


@query
def tooltip_share(spark, sf):
    """J10 after C6: shares among the types shown (small ones excluded)."""
    return trends.type_shares(trends.metric_by_type(baked(spark, sf)), "downloadsAllTime",
                              exclude=("individual", "classroom", "government"))


@query
def filtered_ranking(spark, sf):
    """C1 + C5 + C3 + B18: organisations only, tracked rows with >= 2 likes,
    per (snapshot, type) with a thin-sample flag."""
    d = explorer.min_value(explorer.tracked_only(explorer.filter_types(baked(spark, sf), exclude=["individual"]),
                                                 "downloadsAllTime"), "likes", 2)
    g = d.groupBy("snapshot_date", "org_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("thin", explorer.thin_flag("n", 10))


@query
def left_enrich(spark, sf):
    """Every row with the scrape's type and followers (NULL = no org page)."""
    p = driver.panel(spark, sf).select("snapshot_date", "_id", "author")
    return enrich.enrich(p, driver.orgs_dim(spark, sf), "author", "left")


@query
def country_join(spark, sf):
    acc = _acc_ds(spark, sf).select("snapshot_date", "author", "dl")
    return enrich.country_join(acc, known_countries(driver.countries_dim(spark, sf)))


@query
def snapshot_every_nth(spark, sf):
    from ..operators.snapshots import select_snapshots, snapshot_dim
    return select_snapshots(snapshot_dim(driver.panel(spark, sf)), since="1996-01-01", every=7)


@query
def slim_enriched(spark, sf):
    """A6 without the write: slim columns + the scrape's type."""
    from ..sources.ingest import enrich_slim
    raw = driver.panel(spark, sf).drop("org_type", "t")
    s = enrich_slim(raw, driver.orgs_dim(spark, sf))
    return s.withColumn("tags", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|"))


@query
def coverage_profile(spark, sf):
    from ..functions.tags import has_paper as hp
    p = driver.panel(spark, sf)
    return profile.coverage(p, {"tags": F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0,
                                "paper": hp("tags"), "dlat": F.col("downloadsAllTime").isNotNull(),
                                "size": F.col("mainSize") > 0}, part=["snapshot_date"])


@query
def page_cards(spark, sf):
    from ..sources.pages import extract_org_cards
    return extract_org_cards(driver.listing_pages(spark, sf))


@query
def size_box(spark, sf):
    """E19 coverage and byte quantiles: share of rows with a positive size,
    nearest-rank quantiles, mean and max of the sized rows."""
    return dist.box_stats(rejoined(spark, sf), "mainSize", part=_SD, positive=True)


@query
def distinct_accounts(spark, sf):
    return dist.distinct_accounts(rejoined(spark, sf), part=_SD)


@query
def type_order(spark, sf):
    """Stacking order of the types by latest all-time downloads."""
    return trends.group_order(trends.metric_by_type(baked(spark, sf)), "downloadsAllTime")


@query
def type_orders(spark, sf):
    """G4 by the sum over all snapshots, and by the median all-time downloads
    and the download-weighted median size of the last complete snapshot."""
    p = rejoined(spark, sf)
    last = ranking.latest(ranking.complete(p))
    med = dist.box_stats(last, "downloadsAllTime", part=["org_type"]).select("org_type", F.col("med").alias("v"))
    wmed = dist.weighted_quantiles(last.filter(F.col("mainSize") > 0), "mainSize", "downloadsAllTime",
                                   part=["org_type"]).select("org_type", F.col("med").alias("v"))
    total = p.groupBy("org_type").agg(F.sum("downloads").alias("v"))
    out = None
    for label, d in (("total", total), ("median", med), ("weighted_median", wmed)):
        o = trends.order_groups(d.withColumn("v", F.col("v").cast("decimal(24,2)")), "v").withColumn("order_by", F.lit(label))
        out = o if out is None else out.unionByName(o)
    return out


@query
def name_order(spark, sf):
    """The labels of one display, pooled accounts and vocabulary topics."""
    pool = ranking.ever_in_pool(_acc_ds(spark, sf), "author", ["dl", "lk"], 5).select(F.col("author").alias("name"))
    return ranking.name_order(pool.unionByName(_vocab(spark, sf).select(F.col("topic").alias("name"))).distinct(), "name")


@query
def frozen_diff(spark, sf):
    """H5: detected frozen snapshots versus the hub's known list."""
    import datetime as _dt
    from ..functions.fixed import KNOWN_FROZEN
    found = longitudinal.frozen(driver.panel(spark, sf)).filter("frozen")
    known = spark.createDataFrame([(_dt.date.fromisoformat(d),) for d in KNOWN_FROZEN], "snapshot_date date")
    return longitudinal.diff_expected(found, known)


@query
def entity_topics(spark, sf):
    """B13 + I1 metadata: each dataset's latest name, type and sorted
    vocabulary indices of its latest tags."""
    from ..functions.tags import topic_ids
    p = driver.panel(spark, sf)
    vocab = _vocab(spark, sf)
    vmap = vocab.agg(F.map_from_entries(F.collect_list(F.struct("topic", "idx")))).scalar()  # tasks + 60 entries
    a = longitudinal.latest_attrs(p).withColumn("_vm", vmap)  # bound once, then used inside the lambda
    return a.select("_id", "id", "org_type",
                    F.array_join(F.transform(topic_ids("tags", F.col("_vm")), lambda x: x.cast("string")), ",")
                    .alias("topic_ids"))
