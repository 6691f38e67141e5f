"""Readers for snapshot panels and dimension files.

Schemas are always explicit: an all-null column written by pandas has the
parquet ``null`` type (inferred as INT by Spark), and nanosecond timestamps
are rejected under inference.  Columns missing in older files simply read
as NULL under an explicit schema, which covers the "wanted ∩ available"
rule without per-file footers.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLIM_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("likes", T.LongType()),
    T.StructField("downloads", T.LongType()),
    T.StructField("downloadsAllTime", T.LongType()),
    T.StructField("trendingScore", T.DoubleType()),
    T.StructField("mainSize", T.DoubleType()),
    T.StructField("org_type", T.StringType()),
])

STAMP_RE = r"(\d{4}-\d{2}-\d{2})"
SNAPSHOT_FILE_RE = r"(\d{4}-\d{2}-\d{2})\.parquet$"


def read_panel(spark: SparkSession, path: str, schema: T.StructType = SLIM_SCHEMA,
               since: str | None = None, layout: str = "partitioned") -> DataFrame:
    """A1: the snapshot panel.

    ``partitioned``: a table written with ``partitionBy("snapshot_date")`` —
    a ``since`` filter becomes a partition filter.  ``files``: one file per
    week with the date in the name (``..._<YYYY-MM-DD>.parquet``); the date
    comes from the hidden ``_metadata.file_path`` column.
    """
    if layout == "partitioned":
        s = T.StructType(list(schema.fields) + [T.StructField("snapshot_date", T.DateType())])
        df = spark.read.schema(s).parquet(path)
    else:
        df = (spark.read.schema(schema).parquet(path)
              .withColumn("snapshot_date",
                          F.to_date(F.regexp_extract(F.col("_metadata.file_path"), SNAPSHOT_FILE_RE, 1))))
    if since:
        df = df.filter(F.col("snapshot_date") >= F.lit(since).cast("date"))
    return df


def read_era(spark: SparkSession, paths: dict[str, Sequence[str]], schema: T.StructType = SLIM_SCHEMA,
             created: str = "createdAt") -> DataFrame:
    """A3 + B9: files of different eras read with one explicit schema each and
    unioned by name.  ``paths`` maps the era of ``createdAt`` — ``string``,
    ``micros`` or ``nanos`` — to file lists; every era yields a DATE."""
    parts = []
    for era, files in paths.items():
        if not files:
            continue
        if era == "string":
            ct, conv = T.StringType(), lambda c: F.to_date(F.substring(c, 1, 10))
        elif era == "micros":
            ct, conv = T.TimestampType(), lambda c: F.to_date(c)
        elif era == "nanos":
            ct, conv = T.LongType(), lambda c: F.to_date(F.timestamp_micros(F.floor(c / 1000).cast("long")))
        else:
            raise ValueError(era)
        s = T.StructType(list(schema.fields) + [T.StructField(created, ct)])
        d = (spark.read.option("spark.sql.legacy.parquet.nanosAsLong", "true").schema(s).parquet(*files)
             .withColumn(created, conv(F.col(created)))
             .withColumn("snapshot_date",
                         F.to_date(F.regexp_extract(F.col("_metadata.file_path"), SNAPSHOT_FILE_RE, 1))))
        parts.append(d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def weekly_files(spark: SparkSession, path: str) -> dict[dt.date, str]:
    """The dated Parquet files of a folder (a listing; of two with one date the last name)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = {}
    for s in sorted(p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p), key=lambda s: s.getPath().getName()):
        m = re.search(SNAPSHOT_FILE_RE, s.getPath().getName())
        if m:
            found[dt.date.fromisoformat(m[1])] = s.getPath().toString()
    return found


def discover_eras(spark: SparkSession, path: str, created: str = "createdAt", threads: int = 16) -> tuple[dict[str, list[str]], dict[str, str]]:
    """A3: the files of a folder by the era of their ``created`` column, from their footers, and the unreadable ones with the reason.

    Each footer is read by a Spark task of its own; ``threads`` of these one-task jobs run at a time, and one schema per file
    comes back. Files without the column are of the ``string`` era (it reads as NULL there).
    """
    session = spark.newSession()
    session.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")  # ns timestamps are 64-bit integers in this session
    kinds = {T.LongType(): "nanos", T.TimestampType(): "micros", T.TimestampNTZType(): "micros"}
    files = list(weekly_files(spark, path).values())

    def era(f: str) -> tuple[str, str | None, str | None]:
        try:
            s = session.read.parquet(f).schema
        except Exception as e:  # noqa: BLE001 - reported with its reason
            return f, None, str(e).splitlines()[0]
        return f, kinds.get(s[created].dataType, "string") if created in s.names else "string", None
    out, bad = {"string": [], "micros": [], "nanos": []}, {}
    with ThreadPoolExecutor(threads) as pool:
        for f, kind, reason in pool.map(era, files):
            if kind:
                out[kind].append(f)
            else:
                bad[f] = reason
    return out, bad


def read_folder(spark: SparkSession, path: str, schema: T.StructType = SLIM_SCHEMA, created: str = "createdAt") -> DataFrame:
    """A3: a folder of weekly files of any eras: one scan per era, columns that a file lacks are NULL. Unreadable files are an error."""
    eras, bad = discover_eras(spark, path, created)
    if bad:
        raise ValueError(f"unreadable files: {bad}")
    return read_era(spark, eras, schema, created)


ORGS_SCHEMA = T.StructType([
    T.StructField("slug", T.StringType()), T.StructField("org_type", T.StringType()),
    T.StructField("model_count", T.LongType()), T.StructField("followers", T.LongType()),
    T.StructField("badge", T.StringType()),
])


def load_orgs(spark: SparkSession, path: str) -> DataFrame:
    """A4: org scrape CSV(s) -> (author, csv_type, followers).  The file with the newest date stamp in its name
    wins; within it the first row per slug is kept, in the file's own order: by the start of the split a row
    was read in, then by its number there, however the splits are dealt to tasks."""
    df = (spark.read.schema(ORGS_SCHEMA).option("header", True).csv(path)
          .withColumn("_file", F.struct(F.to_date(F.regexp_extract(F.col("_metadata.file_name"), STAMP_RE, 1)).alias("stamp"), F.col("_metadata.file_path").alias("path")))
          .withColumn("_pos", F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))))
    newest = df.agg(F.max("_file")).scalar()
    df = df.filter(F.col("_file") == newest)
    first = F.min_by(F.struct("org_type", "followers"), "_pos")  # reduced map-side even for a hot slug
    return (df.groupBy("slug").agg(first.alias("f"))
            .select(F.col("slug").alias("author"), F.col("f.org_type").alias("csv_type"), F.col("f.followers")))


COUNTRY_SCHEMA = T.StructType([T.StructField("account", T.StringType()), T.StructField("country", T.StringType()),
                               T.StructField("confidence", T.StringType())])


def load_countries(spark: SparkSession, path: str) -> DataFrame:
    """A5: account -> country CSV, ``unknown`` rows dropped on load."""
    return known_countries(spark.read.schema(COUNTRY_SCHEMA).option("header", True).csv(path))


def known_countries(df: DataFrame) -> DataFrame:
    return df.filter(F.col("country") != "unknown").select("account", "country")


def read_hubs(datasets: DataFrame, models: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Two hubs in one shape with a literal ``hub`` column."""
    a = datasets.withColumn("hub", F.lit("ds"))
    b = models.withColumn("hub", F.lit("md"))
    if cols:
        a, b = a.select("hub", *cols), b.select("hub", *cols)
    return a.unionByName(b, allowMissingColumns=True)
