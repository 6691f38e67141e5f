"""Enrichment joins: org type resolution (B8), dimension joins
and the country -> region map (B15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import COUNTRY_REGION, ORG_TYPES


def resolve_org_type(panel: DataFrame, orgs: DataFrame | None = None, regime: str = "baked") -> DataFrame:
    """Resolve ``org_type`` under one of three regimes.

    * ``baked``: the stored type, NULL -> ``individual``
    * ``rejoined``: scrape type, else stored type, else ``individual``; then any
      non-canonical name -> ``individual``
    * ``org_only``: rows without a stored type are dropped, never folded
    """
    if regime == "baked":
        return panel.withColumn("org_type", F.coalesce(F.col("org_type"), F.lit("individual")))
    if regime == "org_only":
        return panel.filter(F.col("org_type").isNotNull())
    if regime == "rejoined":
        if orgs is None:
            raise ValueError("regime 'rejoined' needs the orgs dimension")
        o = dedupe_orgs(orgs).select("author", "csv_type")
        r = panel.join(o, "author", "left")
        ty = F.coalesce(F.col("csv_type"), F.col("org_type"), F.lit("individual"))
        return r.withColumn("org_type", F.when(ty.isin(*ORG_TYPES), ty).otherwise(F.lit("individual"))).drop("csv_type")
    raise ValueError(f"unknown regime {regime!r}")


def dedupe_orgs(orgs: DataFrame) -> DataFrame:
    """One row per author.  Loaders keep the first row per slug already
    (``load_orgs``); a derived dim with repeats keeps the least row, so the
    pick does not depend on partitioning."""
    rest = [c for c in orgs.columns if c != "author"]
    return orgs.groupBy("author").agg(F.min(F.struct(*rest)).alias("_f")).select("author", "_f.*") if rest else orgs.distinct()


def enrich(df: DataFrame, dim: DataFrame, on, how: str = "left", fill: dict | None = None) -> DataFrame:
    """Generic left enrichment join with optional fill of missing values.

    No broadcast hint: the planner broadcasts the dim by its size statistics
    and AQE re-plans at runtime from the real size, with a sort-merge join
    beyond the threshold.
    """
    out = df.join(dim, on, how)
    return out.fillna(fill) if fill else out


def country_join(df: DataFrame, countries: DataFrame, author_col: str = "author") -> DataFrame:
    """Account -> country; a miss becomes ``unknown``."""
    c = countries.withColumnRenamed("account", author_col).select(author_col, "country")
    return df.join(c, author_col, "left").withColumn("country", F.coalesce(F.col("country"), F.lit("unknown")))


def region_of(country):
    """ISO country -> display region; unlisted -> Rest of World."""
    m = F.create_map(*[x for k, v in COUNTRY_REGION.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[country], F.lit("Rest of World"))
