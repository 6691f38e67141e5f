"""The panel laid out by ``_id``: the second copy of a weekly panel, for everything that follows an item through time.

The date-partitioned panel serves snapshot selections. What groups, windows or joins by ``_id`` (D4, D6, F4, F5,
F7-F9, growth, one item's history) would shuffle all of it by ``_id`` in every query. This copy
is bucketed by ``_id`` and sorted by (``_id``, ``t``), so Spark plans those operators without an
exchange. Lookup columns get Parquet Bloom filters: an equality on ``id`` skips the row groups without it, though
ids are not in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

ROWS_PER_BUCKET = 4_000_000


def write_by_id(panel: DataFrame, path: str, table: str, key: str = "_id", lookup: Sequence[str] = ("id",), rows_per_bucket: int = ROWS_PER_BUCKET,
                options: dict[str, str] | None = None) -> DataFrame:
    """Write the bucketed copy to ``path``, name it ``table`` in the session's catalog and return it.

    Buckets follow the rows, and are no fewer than the session's shuffle partitions. Rows are dealt by the
    bucket's own hash, so a bucket is one file."""
    spark = panel.sparkSession
    rows = panel.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_bucket))
    w = panel.repartition(buckets, key).sortWithinPartitions(key, "t").write.mode("overwrite").option("path", path)
    for c in lookup:
        # values repeat from week to week, so the rows of a bucket bound its distinct values
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(max(1, min(rows // buckets, rows_per_bucket))))
    for k, v in (options or {}).items():
        w = w.option(k, v)
    w.bucketBy(buckets, key).sortBy(key, "t").saveAsTable(table)
    return spark.table(table)
