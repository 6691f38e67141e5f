"""Slim ingest and sinks.

``ingest`` projects raw snapshot rows to the slim columns, attaches the
scrape's org type (left join on author = slug, all rows kept) and writes a
``snapshot_date``-partitioned table with dynamic partition overwrite, so a
re-run replaces exactly the partitions it writes and the commit protocol
makes each write atomic.  Snapshots already present are skipped unless
``force``.  All missing snapshots are one write job. A file that cannot be read fails the job before anything is
published; it is named in the report and the job runs again without it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.enrich import dedupe_orgs
from .readers import SNAPSHOT_FILE_RE, weekly_files

SLIM_COLS = ["_id", "id", "author", "tags", "likes", "downloads", "downloadsAllTime", "trendingScore", "mainSize"]


def enrich_slim(raw: DataFrame, orgs: DataFrame, cols: Sequence[str] = SLIM_COLS) -> DataFrame:
    """Project + left join of the scrape's type: ``org_type`` is the scrape
    value (NULL when the author has no org page)."""
    keep = [c for c in cols if c in raw.columns]
    o = dedupe_orgs(orgs).select("author", F.col("csv_type").alias("org_type"))
    return raw.select("snapshot_date", *keep).join(o, "author", "left")


def table_or_none(spark, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet.  Any other
    failure (permission, corruption) is raised, not taken for an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def existing_dates(spark, out: str) -> set:
    """Partition values already written (file listing only)."""
    df = table_or_none(spark, out)
    return set() if df is None else {r[0] for r in df.select("snapshot_date").distinct().collect()}


def _blamed(reason: str, dates: Sequence) -> list:
    """The dates that an error message names (the path of the file that could not be read)."""
    return [d for d in dates if str(d) in reason]


def ingest(raw: DataFrame | Callable[[Sequence], DataFrame], orgs: DataFrame, out: str, dates: Sequence | None = None, force: bool = False) -> dict:
    """Write the slim panel; returns {"written": [...], "skipped": [...], "failed": [...],
    "reasons": {date: message}}.

    ``raw`` is the raw rows, or a function that gives those of a list of dates (``raw_files`` reads only their files).
    ``dates`` is the (small) list of snapshot dates to process; its default is every date of ``raw``.
    The missing dates are written by one job. When it fails, the dates that the error names are left out; an error that
    names none is narrowed down by halves.
    """
    given = raw if callable(raw) else lambda _: raw
    spark = orgs.sparkSession
    if dates is None:
        if callable(raw):
            raise ValueError("a function of dates needs the dates")
        dates = [r[0] for r in raw.select("snapshot_date").distinct().collect()]
    dates = sorted(dates)
    have = set() if force else existing_dates(spark, out)
    report = {"written": [], "skipped": [d for d in dates if d in have], "failed": [], "reasons": {}}
    todo = [[d for d in dates if d not in have]]
    while todo:
        batch = todo.pop()
        if not batch:
            continue
        try:
            (enrich_slim(given(batch), orgs).filter(F.col("snapshot_date").isin(batch))
             .hint("rebalance", "snapshot_date").sortWithinPartitions("snapshot_date", "_id")  # a week is written by as many tasks as its size asks for
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(out))
            report["written"] += batch
        except Exception as e:  # noqa: BLE001 - reported with its reason, the other dates go on
            bad = _blamed(str(e), batch) or (batch if len(batch) == 1 else [])
            report["failed"] += bad
            report["reasons"] |= dict.fromkeys(bad, str(e))
            if bad:
                todo.append([d for d in batch if d not in bad])
            else:
                todo += [batch[len(batch) // 2:], batch[:len(batch) // 2]]
    for k in ("written", "failed"):
        report[k].sort()
    return report


def raw_files(spark, path: str, schema: T.StructType) -> tuple[Callable[[Sequence], DataFrame], list]:
    """(rows of a list of dates, all dates) of a folder of weekly files: only the files of those dates are opened."""
    files = weekly_files(spark, path)

    def rows(dates: Sequence) -> DataFrame:
        return (spark.read.schema(schema).parquet(*[files[d] for d in dates])
                .withColumn("snapshot_date", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), SNAPSHOT_FILE_RE, 1))))
    return rows, sorted(files)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", sort: Sequence[str] | None = None) -> None:
    """Result sink (parquet / csv / json), optionally globally sorted."""
    if sort:
        df = df.orderBy(*sort)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
