"""Keyed outputs of update-mode streams: one folder per epoch, compacted into a base.

A micro-batch writes the keys whose row changed under ``epoch=<n>`` (overwritten on replay), so the current table is the
newest row of every key. ``compact`` folds what is there into ``<out>_base/epoch=<last>``; readers start from the newest
complete base and read only the epochs after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs under ``path`` whose write is complete, ascending (a folder listing)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def write_epoch(df: DataFrame, out: str, epoch: int) -> None:
    """The changed rows of a micro-batch."""
    df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={epoch}")


def current(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key: the newest base and the epochs after it."""
    out = out.rstrip("/")
    base = _epochs(spark, f"{out}_base")[-1:]
    parts = [(e, f"{out}/epoch={e}") for e in _epochs(spark, out) if not base or e > base[0]]
    parts += [(e, f"{out}_base/epoch={e}") for e in base]
    if not parts:
        raise FileNotFoundError(f"no complete epoch in {out}")
    frames = [spark.read.parquet(path).withColumn("_epoch", F.lit(e).cast("long")) for e, path in parts]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rest = [c for c in rows.columns if c not in keys and c != "_epoch"]
    newest = F.max_by(F.struct(*rest), "_epoch").alias("_row")  # reduced map-side
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def compact(spark: SparkSession, out: str, keys: Sequence[str]) -> int | None:
    """Write a base of everything up to the last complete epoch, drop what it replaces; returns that epoch."""
    out = out.rstrip("/")
    epochs = _epochs(spark, out)
    if not epochs:
        return None
    old = _epochs(spark, f"{out}_base")
    if old and epochs[-1] <= old[-1]:
        return old[-1]
    last = epochs[-1]
    current(spark, out, keys).write.mode("overwrite").parquet(f"{out}_base/epoch={last}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in [f"{out}_base/epoch={e}" for e in old] + [f"{out}/epoch={e}" for e in epochs if e < last]:
        p = hadoop.Path(path)  # the last epoch stays: its commit may still be replayed
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return last
