"""A7 (+D6 incremental): weekly snapshot files arriving in a folder.

A Structured Streaming file source with ``Trigger.AvailableNow`` takes up
only files it has not seen (the checkpoint keeps the file log), so a re-run
processes new weeks only.  Each micro-batch is written with the batch
ingest (dynamic partition overwrite of its snapshot dates), and first
appearances are found with a ``left_anti`` join against a ``seen`` table of
every id so far — the only streaming state, kept as a table in the shared
folder rather than in executor memory.  Both outputs are keyed by the
micro-batch (``epoch=``) and overwritten, so a replay after a crash gives
the same rows once.

Files are taken in arrival (modification-time) order, one week per
micro-batch by default.  Late and re-issued weeks are the subject of ``maintain``.

``first_seen_stream`` keeps first appearances in the state store instead of a table: what a week costs
follows the week, not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ingest import enrich_slim, table_or_none
from ..sources.pages import extract_org_cards
from ..sources.readers import SNAPSHOT_FILE_RE
from .epochs import current, write_epoch


def ingest_stream(spark: SparkSession, src: str, out: str, ckpt: str, orgs: DataFrame, schema: T.StructType,
                  seen: str | None = None, new_out: str | None = None, max_files: int = 1):
    """Run to completion over the files available now; returns the query."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)
              .withColumn("snapshot_date",
                          F.to_date(F.regexp_extract(F.col("_metadata.file_path"), SNAPSHOT_FILE_RE, 1))))

    def batch(df: DataFrame, epoch: int) -> None:
        s = df.sparkSession
        slim = enrich_slim(df, orgs)
        slim.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(out)
        if seen and new_out:
            known = table_or_none(s, seen)
            if known is not None:  # a replayed batch does not see what it wrote before
                known = known.filter(F.col("epoch") < epoch)
            ids = slim.select("snapshot_date", "_id", "org_type")
            # ids of this batch's earliest week inside the batch, then against history
            first = ids.groupBy("_id").agg(F.min("snapshot_date").alias("first_date"))
            fresh = first if known is None else first.join(known.select("_id"), "_id", "left_anti")
            new_rows = ids.join(fresh, (ids._id == fresh._id) & (ids.snapshot_date == fresh.first_date), "left_semi")
            new_rows.groupBy("snapshot_date", "org_type").agg(F.count(F.lit(1)).alias("new")) \
                .write.mode("overwrite").parquet(f"{new_out}/epoch={epoch}")
            fresh.select("_id").write.mode("overwrite").parquet(f"{seen}/epoch={epoch}")

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def adoption_stream(spark: SparkSession, src: str, schema: T.StructType, ckpt: str, out: str,
                    prefix: str = "dataset:", max_files: int = 1):
    """E21 as a streaming aggregation: model rows arriving as files, distinct
    links per model (inside the row), running count of models per dataset.
    The state is one count per dataset.  Every micro-batch writes the counts
    that changed to ``out/epoch=<n>`` (overwritten on replay);
    ``adoption_counts`` reads the current ones."""
    from ..operators.adoption import _links
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)
    counts = (_links(stream, prefix).select(F.explode("ds").alias("dataset_id"))
              .groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_models")))

    def batch(df: DataFrame, epoch: int) -> None:
        write_epoch(df, out, epoch)

    q = (counts.writeStream.outputMode("update").foreachBatch(batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def adoption_counts(spark: SparkSession, out: str) -> DataFrame:
    """The current count per dataset written by ``adoption_stream``; ``epochs.compact(spark, out, ["dataset_id"])`` keeps its input short."""
    return current(spark, out, ["dataset_id"])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen_stream(spark: SparkSession, src: str, ckpt: str, out: str, orgs: DataFrame, schema: T.StructType):
    """D6 / F5 with keyed state: rows newly added per (week, type), weeks arriving in order.

    The state store (RocksDB: on disk beside the executors, its changes in the checkpoint) holds one row per ``_id``: its
    first week and type, and its rows so far. A micro-batch is one week. Update mode emits the ids of that week;
    those whose first week it is are the new ones, with all their rows in it. So a week reads its own file and touches
    its own keys. Counts are written per epoch, so a replay after a crash gives the same ones.
    """
    session = spark.newSession()  # the provider is a setting of this stream's session only
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = (session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
              .withColumn("snapshot_date", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), SNAPSHOT_FILE_RE, 1))))
    first = (enrich_slim(stream, orgs, ["_id", "author"]).groupBy("_id")
             .agg(F.min(F.struct("snapshot_date", "org_type")).alias("first"), F.max("snapshot_date").alias("last"), F.count(F.lit(1)).alias("n")))

    def batch(df: DataFrame, epoch: int) -> None:
        new = df.filter(F.col("first.snapshot_date") == F.col("last")).groupBy(F.col("last").alias("snapshot_date"), F.col("first.org_type").alias("org_type"))
        write_epoch(new.agg(F.sum("n").alias("new")), out, epoch)

    q = (first.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def org_cards_stream(spark: SparkSession, src: str, ckpt: str, out: str, max_files: int = 10):
    """B16 as a resumable crawl: page files (page_id, url, html) arriving in a folder, the first card of every slug.

    The state is one card per slug with the place it was found at; a run takes up where the last one ended, and a page that comes
    late but stands earlier replaces the card. ``current(spark, out, ["slug"])`` reads the cards."""
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    cards = extract_org_cards(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src))

    def batch(df: DataFrame, epoch: int) -> None:
        write_epoch(df, out, epoch)

    q = (cards.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
