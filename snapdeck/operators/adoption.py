"""Model -> dataset adoption (E21), its join onto datasets (D2) and the
impact index (E22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import DATASET_PREFIX
from .ranking import top_rows


def _links(models: DataFrame, prefix: str) -> DataFrame:
    """Distinct (model, dataset) pairs: repeats inside one model count once.
    ``array_distinct`` works inside the row, so no shuffle is needed here."""
    ds = F.array_distinct(F.transform(F.filter(F.coalesce("tags", F.array().cast("array<string>")),
                                               lambda x: x.startswith(prefix)),
                                      lambda x: F.substring(x, len(prefix) + 1, 1 << 30)))
    return models.select("model_id", ds.alias("ds"))


def adoption(models: DataFrame, prefix: str = DATASET_PREFIX) -> DataFrame:
    """Distinct models declaring each dataset.  The aggregation is a
    partial count per map task followed by one shuffle of partial counts, so
    a dataset linked by a third of all models costs no more than any other."""
    e = _links(models, prefix).select(F.explode("ds").alias("dataset_id"))
    return e.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_models"))


def adoption_totals(models: DataFrame, prefix: str = DATASET_PREFIX) -> DataFrame:
    """E21 totals: models seen, models with >= 1 link, linked %, distinct
    datasets and total links, in one aggregation over the exploded links
    (a model without links keeps one row with a NULL position)."""
    e = _links(models, prefix).select(F.posexplode_outer("ds").alias("pos", "d"))
    a = e.agg(F.count_if(F.col("pos").isNull() | (F.col("pos") == 0)).alias("models_seen"),
              F.count_if(F.col("pos") == 0).alias("models_linked"),
              F.count("d").alias("total_links"), F.count_distinct("d").alias("datasets_adopted"))
    return a.select(
        "models_seen", "models_linked",
        F.round(F.try_divide(F.col("models_linked") * 100.0, F.col("models_seen")), 1).cast("decimal(10,1)").alias("linked_pct"),
        "datasets_adopted", "total_links")


def adoption_join(datasets: DataFrame, adopt: DataFrame, on: str = "id") -> DataFrame:
    """Datasets left-joined with adoption on the human id; missing -> 0."""
    a = adopt.withColumnRenamed("dataset_id", on)
    return datasets.join(a, on, "left").withColumn("n_models", F.coalesce("n_models", F.lit(0)).cast("long"))


def impact_index(df: DataFrame, top: int | None = None, by: str = "org_type",
                 part: Sequence[str] = ("snapshot_date",), rank_metric: str = "downloadsAllTime") -> DataFrame:
    """Per type, (outcome share) / (presence share) for all-time
    downloads, likes and adoption, within each ``part`` (one snapshot in the
    published chart; here every snapshot at once).  ``top`` restricts the
    scope to the N rows with the largest ``rank_metric``; ``pop`` is always
    the type's full row count.  Expects org-owned rows (regime c)."""
    part = list(part)
    pop = df.groupBy(*part, by).agg(F.count(F.lit(1)).alias("pop"))
    scope = df if top is None else top_rows(df, part, rank_metric, "_id", top)
    g = scope.groupBy(*part, by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("downloadsAllTime"), F.lit(0)).cast("long").alias("downloads"),
        F.coalesce(F.sum("likes"), F.lit(0)).cast("long").alias("likes"),
        F.coalesce(F.sum("n_models"), F.lit(0)).cast("long").alias("adoption"))
    w = Window.partitionBy(*part)
    share = F.col("n") / F.sum("n").over(w)

    def idx(c):
        return F.try_divide(F.try_divide(F.col(c).cast("double"), F.sum(c).over(w)), share).cast("decimal(20,4)")
    return (g.join(pop, [*part, by])
            .select(*part, by, F.lit("all" if top is None else "top").alias("scope"), "n", "pop",
                    idx("downloads").alias("dl"), idx("likes").alias("lk"), idx("adoption").alias("ad"),
                    "downloads", "likes", "adoption"))
