"""The snapshot panel and its dimensions, derived by Spark from the driver tables.

Mapping (one row per customer and calendar month that has orders):

* ``_id`` = ``o_custkey``; ``id`` = ``c_name``
* ``author`` = the customer's nation name; baked ``org_type`` from the
  nation's region (MIDDLE EAST has no org page, i.e. NULL)
* ``snapshot_date`` = month of ``o_orderdate``; ``t`` = ordinal of the month
  among the months present
* ``downloads`` = sum of whole order prices in the month; ``likes`` = orders
* ``downloadsAllTime`` = running ``downloads`` per ``_id``, NULL before 1996-01
  (the all-time metric is only tracked from that snapshot on)
* frozen months repeat the rows of the month before their run (the month's own
  orders are left out and the all-time count stands still)
* customers whose key is a multiple of 23 have no author (and no org type)
* ``mainSize`` = ``c_acctbal`` (some are <= 0)
* ``tags`` = task / licence / free-form / arxiv / size tags from the columns

The second hub ("models") is the supplier-side panel of ``lineitem``; model ->
dataset links are order lines pointing at ``dataset:<customer name>``.
Every table here grows with the input tables; nothing is collected.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.snapshots import with_ordinal
from ..session import app_id, checkpoint_dir
from .by_id import write_by_id

# FIXED VALUES of the driver-table mapping (not of the analysed hub).
REGION_ORG_TYPE = {"AFRICA": "company", "AMERICA": "university", "ASIA": "non-profit", "EUROPE": "community"}
LICENSE_CYCLE = ["mit", "apache-2.0", "cc-by-nc-4.0", "llama3", "openrail", "custom-terms"]
ORDER_STATUS_WORD = {"F": "finished", "O": "open", "P": "partial"}
# Monthly downloads bucket upper bounds -> size_categories value.
SIZE_BANDS = [(50_000, "n<1K"), (150_000, "1K<n<10K"), (300_000, "10K<n<100K"),
              (600_000, "100K<n<1M"), (1_000_000, "1M<n<10M")]
SIZE_TOP_BAND = "10M<n<100M"
ALLTIME_START = "1996-01-01"
# First month that stays -> the frozen months after it (one before all-time
# tracking, a single, a double and a trailing run).
FROZEN_RUNS = {"1995-05-01": ["1995-06-01"], "1996-08-01": ["1996-09-01"],
               "1998-02-01": ["1998-03-01", "1998-04-01"], "2001-07-01": ["2001-08-01"]}
NO_AUTHOR_KEY_MOD = 23
# Nations without an organisation page: key modulo 12.
NO_ORG_NATION_MOD = 7
# Nation key modulo 5 -> org type written in the organisation scrape.
CSV_TYPE_BY_NATION_MOD = {0: "government", 1: "classroom", 2: "Lab"}
# Nation key modulo 6 -> ISO country code of the account.
COUNTRY_BY_NATION_MOD = {0: "US", 1: "CN", 2: "FR", 3: "unknown", 4: "JP", 5: "GB"}


_WRITTEN: dict[tuple, str] = {}
_FRAMES: dict[tuple, DataFrame] = {}
_LOCK = threading.RLock()  # re-entrant: a build may materialise its inputs first


def materialize(spark: SparkSession, key: tuple, build, sort: tuple = ("_id",)) -> DataFrame:
    """Write a derived panel once per application and read it back.

    Like the weekly slim files of an ingest, the panel is stored as parquet
    partitioned by ``snapshot_date`` and sorted by ``_id`` inside each file
    (partition pruning for snapshot selections, row-group skipping for id
    lookups).  It lives in the shared checkpoint folder named by
    ``spark.checkpoint.dir``, so it survives executor loss and cuts the
    lineage back to the raw tables.  ``rebalance`` lets AQE split a large
    snapshot over several writers and merge small ones.
    """
    app = app_id(spark)
    k = (app, *key)
    with _LOCK:  # one writer per table even when queries are submitted from several threads
        path = _materialize_locked(spark, k, key, build, sort)
        if k not in _FRAMES:  # list the partition folders once, reuse the file index
            _FRAMES[k] = spark.read.parquet(path)
        return _FRAMES[k]


def _materialize_locked(spark: SparkSession, k: tuple, key: tuple, build, sort: tuple) -> str:
    app = k[0]
    if k not in _WRITTEN:
        base = checkpoint_dir(spark).rstrip("/")
        tag = hashlib.sha1(repr(key).encode()).hexdigest()[:16]
        path = f"{base}/snapdeck-tables/{app}/{key[0]}-{tag}"
        df = build()
        (df.hint("rebalance", "snapshot_date").sortWithinPartitions("snapshot_date", *sort)
         .write.mode("overwrite").partitionBy("snapshot_date").parquet(path))
        _WRITTEN[k] = path
    return _WRITTEN[k]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables (footer read and file listing once per application)."""
    k = (app_id(spark), "table", sf_dir, name)
    with _LOCK:
        if k not in _FRAMES:
            _FRAMES[k] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return _FRAMES[k]


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, author, org_type) — 25 rows, fixed by the TPC-H layout."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select("n_nationkey", F.col("n_name").alias("author"),
                    _case(F.col("r_name"), REGION_ORG_TYPE).alias("org_type")))


def _license_slug(prio: Column, key: Column) -> Column:
    idx = (F.substring(prio, 1, 1).cast("int") + key) % len(LICENSE_CYCLE)
    return F.element_at(F.array(*[F.lit(s) for s in LICENSE_CYCLE]), (idx + 1).cast("int"))


def _size_band(dl: Column) -> Column:
    expr = None
    for ub, name in SIZE_BANDS:
        expr = F.when(dl < ub, F.lit(name)) if expr is None else expr.when(dl < ub, F.lit(name))
    return expr.otherwise(F.lit(SIZE_TOP_BAND))


def _tags(key: Column, seg: Column, pmin: Column, pmax: Column, status: Column, dl: Column) -> Column:
    parts = [
        F.concat(F.lit("task_categories:"), F.lower(seg)),
        F.when(key % 11 != 0, F.concat(F.lit("license:"), _license_slug(pmin, key))),
        F.when(pmin != pmax, F.concat(F.lit("license:"), _license_slug(pmax, key))),
        F.when(key % 7 == 0, F.lower(seg)),
        F.concat(F.lit("status-"), _case(status, ORDER_STATUS_WORD)),
        F.concat(F.lit("k"), (key % 97).cast("string")),
        F.when(key % 5 == 0, F.concat(F.lit("arxiv:"), (key % 50 + 2300).cast("string"))),
        F.when(key % 17 == 0, F.lit("size_categories:unmapped"))
         .otherwise(F.concat(F.lit("size_categories:"), _size_band(dl))),
    ]
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return (F.when(key % 26 == 0, F.array().cast("array<string>"))
            .when(key % 13 == 0, F.lit(None).cast("array<string>"))
            .otherwise(arr))


def _freeze(monthly: DataFrame) -> DataFrame:
    """Replace every frozen month by copies of the month before its run;
    ``fresh`` is false on the copies."""
    d = F.col("snapshot_date")
    frozen = [m for run in FROZEN_RUNS.values() for m in run]
    dates = F.array(d)
    for base, run in FROZEN_RUNS.items():
        dates = F.when(d == F.lit(base).cast("date"),
                       F.array(*[F.lit(m).cast("date") for m in (base, *run)])).otherwise(dates)
    return (monthly.filter(~d.isin(*[F.lit(m).cast("date") for m in frozen]))
            .withColumn("_own", d).withColumn("snapshot_date", F.explode(dates))
            .withColumn("fresh", F.col("snapshot_date") == F.col("_own")).drop("_own"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset-hub panel: one row per (_id, snapshot), materialised once
    per application as a snapshot-partitioned table (see ``materialize``)."""
    return materialize(spark, ("panel", sf_dir), lambda: panel_plan(spark, sf_dir))


def panel_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset-hub panel laid out by ``_id`` (see ``by_id``), written once per application."""
    k = (app_id(spark), "panel_by_id", sf_dir)
    with _LOCK:
        if k not in _FRAMES:
            tag = hashlib.sha1(repr(k).encode()).hexdigest()[:16]
            path = f"{checkpoint_dir(spark).rstrip('/')}/snapdeck-tables/{k[0]}/panel_by_id-{tag}"
            _FRAMES[k] = write_by_id(panel(spark, sf_dir), path, f"panel_by_id_{tag}")
        return _FRAMES[k]


def panel_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a plan over the driver tables (no materialisation)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate",
                                              "o_orderpriority", "o_orderstatus")
    monthly = (o.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("snapshot_date"))
               .agg(F.sum(F.floor("o_totalprice")).cast("long").alias("downloads"),
                    F.count(F.lit(1)).alias("likes"),
                    F.min("o_orderpriority").alias("pmin"),
                    F.max("o_orderpriority").alias("pmax"),
                    F.max("o_orderstatus").alias("st")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    acc = F.broadcast(accounts(spark, sf_dir))  # 25 rows by construction
    rows = (_freeze(monthly).join(c, F.col("o_custkey") == c.c_custkey)
            .join(acc, F.col("c_nationkey") == acc.n_nationkey))
    rows = with_ordinal(rows, "snapshot_date")
    w = Window.partitionBy("_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.col("o_custkey")
    owned = key % NO_AUTHOR_KEY_MOD != 0
    return (rows.select(
        "snapshot_date", "t", "fresh",
        key.alias("_id"), F.col("c_name").alias("id"), F.when(owned, F.col("author")).alias("author"),
        F.when(owned, F.col("org_type")).alias("org_type"), "likes", "downloads",
        F.col("c_acctbal").alias("mainSize"),
        _tags(key, F.col("c_mktsegment"), F.col("pmin"), F.col("pmax"), F.col("st"), F.col("downloads")).alias("tags"),
    ).withColumn("downloadsAllTime",
                 F.when(F.col("snapshot_date") >= F.lit(ALLTIME_START).cast("date"),
                        F.sum(F.when(F.col("fresh"), F.col("downloads"))).over(w))).drop("fresh"))


PANEL_COLUMNS = ["snapshot_date", "t", "_id", "id", "author", "org_type", "likes", "downloads",
                 "mainSize", "tags", "downloadsAllTime"]


def models_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second hub: one row per (supplier, month of shipment), materialised."""
    return materialize(spark, ("models_panel", sf_dir), lambda: models_panel_plan(spark, sf_dir))


def models_panel_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second hub as a plan over the driver tables."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_shipdate")
    monthly = (li.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("snapshot_date"))
               .agg(F.sum(F.floor("l_extendedprice")).cast("long").alias("downloads"),
                    F.count(F.lit(1)).alias("likes")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    acc = F.broadcast(accounts(spark, sf_dir))
    rows = (monthly.join(s, monthly.l_suppkey == s.s_suppkey)
            .join(acc, F.col("s_nationkey") == acc.n_nationkey))
    rows = with_ordinal(rows, "snapshot_date")
    w = Window.partitionBy("_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.select("snapshot_date", "t", F.col("l_suppkey").alias("_id"), F.col("s_name").alias("id"),
                        "author", "org_type", "likes", "downloads")
            .withColumn("downloadsAllTime",
                        F.when(F.col("snapshot_date") >= F.lit(ALLTIME_START).cast("date"),
                               F.sum("downloads").over(w))))


def model_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with their tag bags: one row per order (= model).

    Each order line contributes ``dataset:Customer#<suppkey, 9 digits>`` and a
    free-form tag; repeats within a model are kept (they count once later).
    The per-model bag is bounded by the lines of one order.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    tag = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("lines-"), F.col("l_linenumber").cast("string"))) \
        .otherwise(F.concat(F.lit("dataset:Customer#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
    return (li.groupBy(F.col("l_orderkey").alias("model_id"))
            .agg(F.sort_array(F.collect_list(tag)).alias("tags")))


def orgs_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation scrape: (author, csv_type, followers) — one row per nation with a page."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").filter(
        F.col("n_nationkey") % 12 != NO_ORG_NATION_MOD)
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("followers"))
    return (n.join(s, n.n_nationkey == s.s_nationkey, "left")
            .select(F.col("n_name").alias("author"),
                    _case(F.col("n_nationkey") % 5, CSV_TYPE_BY_NATION_MOD).alias("csv_type"),
                    F.coalesce(F.col("followers"), F.lit(0)).cast("long").alias("followers")))


def countries_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account -> ISO country (raw, still including ``unknown`` rows)."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select(F.col("n_name").alias("account"),
                    _case(F.col("n_nationkey") % 6, COUNTRY_BY_NATION_MOD).alias("country"),
                    F.when(F.col("n_nationkey") % 3 == 0, F.lit("high")).otherwise(F.lit("low")).alias("confidence"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): the crawled ``pages`` and one listing page per
    supplier, whose first anchor is the card of its nation's organisation (so
    slugs repeat) and whose second links to a repository.  Counts come as
    ``1.09k``, ``4.66M`` or ``1,234``; every fourth card has no followers."""
    k = F.col("s_suppkey")
    dec = F.concat((k * 37 % 900).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    fol = (F.when(k % 4 == 0, F.concat(dec, F.lit("k followers"))).when(k % 4 == 1, F.concat(dec, F.lit("M followers")))
           .when(k % 4 == 2, F.concat((k % 9 + 1).cast("string"), F.lit(","),
                                      F.lpad((k * 7 % 1000).cast("string"), 3, "0"), F.lit(" followers")))
           .otherwise(F.lit("")))
    kind = F.when(k % 3 != 0, F.concat(F.lit('<span class="x capitalize">'),
                                       F.when(k % 3 == 1, F.lit("Company")).otherwise(F.lit("university")), F.lit("</span>")))
    badge = F.when(k % 5 == 0, F.lit('<span class="a -skew-x-12">Team</span>'))
    models = F.when(k % 7 != 0, F.concat((k % 50).cast("string"), F.lit(" models")))
    slug = F.concat(F.lit("org-"), F.col("s_nationkey").cast("string"))
    none = F.lit("")
    html = F.concat(F.lit('<html><body><a class="c" href="/'), slug, F.lit('"><h4>'), F.col("s_name"), F.lit("</h4>"),
                    F.coalesce(kind, none), F.coalesce(badge, none), F.lit(" <b>"), F.coalesce(models, none),
                    F.lit("</b>\n<i>"), fol, F.lit('</i></a><a href="/'), slug,
                    F.lit('/repo">repo 9 followers</a></body></html>'))
    cards = table(spark, sf_dir, "supplier").select(
        (k + 1_000_000_000).cast("long").alias("page_id"),
        F.concat(F.lit("https://hub.example.org/orgs?p="), k.cast("string")).alias("url"), html.alias("html"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html").unionByName(cards)
