"""A10: column coverage profile — counts and shares of rows satisfying
per-column predicates (non-null, non-empty, tag-prefixed), one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, exprs: dict[str, Column], part: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, e in exprs.items():
        aggs += [F.count_if(e).alias(f"n_{name}"), F.avg(F.coalesce(e, F.lit(False)).cast("double")).cast("decimal(20,6)").alias(f"share_{name}")]
    return df.groupBy(*part).agg(*aggs)
