"""A7, late and re-issued weeks: dependent tables kept up to date week by week.

A ``WeekStore`` holds the slim panel and the tables that depend on it, each cut into one partition per
snapshot. ``apply`` takes the rows of new, late or re-issued weeks and rewrites only the partitions
that can differ:

* a week's own sums (``cells``, ``accounts``): the week itself
* differences to the previous available week (``spikes``, ``gains``): the week and the one after it
* first appearances (``first_seen``, ``new``) and first tracked values (``baseline``): from the earliest changed week on; what was seen before
  it is read from the stored state, not from the panel
* tables of a few rows per week (``by_type``, ``counts``, ``vectors``, ``hub``, ``cumulative``, ``frozen``, ``drivers``):
  derived anew from ``cells`` and ``new`` (weeks x types rows), and the weeks whose rows differ are written. Smoothing
  reaches back over a frozen run and ordinals shift for every later week; the comparison covers both.

Every call writes under its own ``epoch=<n>`` folder and becomes visible by one manifest (table, week, epoch)
written last. A call that dies leaves the published state as it was, and a replay of its epoch
overwrites what it left. Readers see one epoch's state of all tables. The manifest has one row per table and week.
"""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import ORG_TYPES
from ..operators import longitudinal, ranking
from ..operators.snapshots import densify, snapshot_dim, type_grid
from ..sources.ingest import enrich_slim

DATE = "snapshot_date"
WEEK_FILE_RE = r"(\d{4}-\d{2}-\d{2})[^/]*\.parquet$"
MANIFEST = "tab string, snapshot_date date, epoch long, fields string"


class WeekStore:
    """Panel and dependent tables under ``root`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, root: str, types: Sequence[str] = ORG_TYPES, top: int = 5):
        self.spark, self.root, self.types, self.top = spark, root.rstrip("/"), types, top

    # --- published state -------------------------------------------------------------------

    def _children(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def epochs(self) -> list[int]:
        """Published epochs, ascending: those whose manifest is complete."""
        names = [n for n in self._children(f"{self.root}/manifest") if n.startswith("epoch=")]
        return sorted(int(n[6:]) for n in names if "_SUCCESS" in self._children(f"{self.root}/manifest/{n}"))

    def _load(self, before: int | None = None) -> None:
        self.parts: dict[str, dict[dt.date, int]] = {}
        self.fields: dict[str, T.StructType] = {}
        known = [e for e in self.epochs() if before is None or e < before]
        if known:
            for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/epoch={known[-1]}").collect():
                if r.snapshot_date is None:
                    self.fields[r.tab] = T.StructType.fromJson(json.loads(r.fields))
                else:
                    self.parts.setdefault(r.tab, {})[r.snapshot_date] = r.epoch

    def _rows(self, table: str, dates: Iterable[dt.date] | None = None) -> DataFrame:
        """The partitions of ``dates`` (all without) as one DataFrame with the table's columns."""
        parts, fields = self.parts.get(table, {}), self.fields[table]
        paths = [f"{self.root}/{table}/epoch={e}/{DATE}={d}" for d, e in sorted(parts.items()) if dates is None or d in set(dates)]
        if not paths:
            return self.spark.createDataFrame([], fields)
        df = self.spark.read.schema(T.StructType([*fields.fields, T.StructField("epoch", T.LongType())]))
        return df.option("basePath", f"{self.root}/{table}").parquet(*paths).select(*fields.names)

    def read(self, table: str) -> DataFrame:
        """The published rows of a table."""
        self._load()
        return self._rows(table)

    def partitions(self, table: str) -> dict[dt.date, int]:
        """week -> epoch that wrote it."""
        self._load()
        return dict(self.parts.get(table, {}))

    def _put(self, table: str, df: DataFrame, epoch: int, dates: Iterable[dt.date] | None = None) -> list[dt.date]:
        """Write partitions; ``dates`` are the weeks the rows stand for (those without rows lose their partition)."""
        path = f"{self.root}/{table}/epoch={epoch}"
        df.write.mode("overwrite").partitionBy(DATE).parquet(path)
        written = [dt.date.fromisoformat(n.split("=")[1]) for n in self._children(path) if n.startswith(f"{DATE}=") and n[len(DATE) + 1:][:1].isdigit()]
        old = self.fields.get(table, T.StructType()).fields
        have = {f.name for f in old}  # columns that later weeks bring are NULL in earlier ones
        self.fields[table] = T.StructType([*old, *[T.StructField(f.name, f.dataType) for f in df.schema if f.name not in have]])
        gone = set(written if dates is None else dates)
        kept = {d: e for d, e in self.parts.get(table, {}).items() if d not in gone}
        self.parts[table] = kept | dict.fromkeys(written, epoch)
        return sorted(written)

    def _publish(self, epoch: int) -> None:
        rows = [(t, d, e, None) for t, p in self.parts.items() for d, e in p.items()]
        rows += [(t, None, None, f.json()) for t, f in self.fields.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/epoch={epoch}")

    # --- maintenance ------------------------------------------------------------------------

    def apply(self, rows: DataFrame, epoch: int) -> dict[str, list[dt.date]]:
        """Take up whole weeks (slim rows with ``snapshot_date``); returns the weeks rewritten per table.
        Epochs ascend; one that is already published is left as it is."""
        if epoch in self.epochs():
            return {}
        self._load(before=epoch)
        done = {"slim": self._put("slim", rows.filter(F.col(DATE).isNotNull()).hint("rebalance", DATE).sortWithinPartitions(DATE, "_id"), epoch)}
        changed = done["slim"]
        if not changed:
            self._publish(epoch)
            return done
        weeks = sorted(self.parts["slim"])
        at = {d: i for i, d in enumerate(weeks)}
        ordinal = F.broadcast(self.spark.createDataFrame(list(at.items()), f"{DATE} date, t int"))  # one row per week
        near = sorted({*changed, *(weeks[at[d] + 1] for d in changed if at[d] + 1 < len(weeks))})
        pairs = sorted({*near, *(weeks[at[d] - 1] for d in near if at[d])})
        later = weeks[at[changed[0]]:]

        own = self._rows("slim", changed)
        done["cells"] = self._put("cells", own.groupBy(DATE, "org_type").agg(
            F.count(F.lit(1)).alias("n"), F.sum("downloads").alias("dl"), F.sum("downloadsAllTime").alias("dlat"),
            F.sum("likes").alias("lk"), F.count("downloadsAllTime").alias("tracked")), epoch, changed)
        done["accounts"] = self._put("accounts", ranking.by_account(own.join(ordinal, DATE)).drop("t"), epoch, changed)

        two = self._rows("slim", pairs).join(ordinal, DATE)
        done["spikes"] = self._put("spikes", longitudinal.spikes(two, top=self.top).filter(F.col(DATE).isin(near)).drop("t"), epoch, near)
        acc = self._rows("accounts", pairs).join(ordinal, DATE)
        done["gains"] = self._put("gains", longitudinal.like_gain(acc).filter(F.col(DATE).isin(near)).drop("t"), epoch, near)

        ids = self._rows("slim", later).select(DATE, "_id", "org_type").join(ordinal, DATE)
        if "first_seen" in self.parts:
            before = self._rows("first_seen", [d for d in self.parts["first_seen"] if d < changed[0]])
            ids = ids.join(before.select("_id").distinct(), "_id", "left_anti")
        fresh = longitudinal.first_seen(ids).groupBy(DATE, "_id", "org_type").agg(F.count(F.lit(1)).alias("n"))
        done["first_seen"] = self._put("first_seen", fresh, epoch, later)
        fresh = self._rows("first_seen", later)
        done["new"] = self._put("new", fresh.groupBy(DATE, "org_type").agg(F.sum("n").alias("new")), epoch, later)

        tracked = self._rows("slim", later).filter(F.col("downloadsAllTime").isNotNull()).select(DATE, "_id", F.col("downloadsAllTime").alias("base"))
        if "baseline" in self.parts:
            before = self._rows("baseline", [d for d in self.parts["baseline"] if d < changed[0]])
            tracked = tracked.join(before.select("_id"), "_id", "left_anti")
        first = tracked.groupBy("_id").agg(F.min(F.struct(DATE, "base")).alias("_f")).select(f"_f.{DATE}", "_id", "_f.base")
        done["baseline"] = self._put("baseline", first, epoch, later)

        for name, df in self._small().items():
            done[name] = self._put_differing(name, df, epoch)
        self._publish(epoch)
        return done

    def _small(self) -> dict[str, DataFrame]:
        """The tables of a few rows per week, from ``cells`` and ``new`` alone."""
        cells, new = self._local("cells"), self._local("new")
        dim = snapshot_dim(cells)
        grid = type_grid(dim, self.types)
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        keys = [DATE, "org_type"]
        full = cells.join(new.withColumnRenamed("org_type", "_ot").withColumnRenamed(DATE, "_d"),
                          (F.col(DATE) == F.col("_d")) & F.col("org_type").eqNullSafe(F.col("_ot")), "left").drop("_d", "_ot")
        full = full.select(*keys, *map(zero, ("dl", "dlat", "lk", "n", "new")))
        dense = densify(full, grid, keys, {"dl": 0, "dlat": 0, "lk": 0, "n": 0, "new": 0})
        hub = cells.groupBy(DATE).agg(F.sum("n").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"), F.sum("dlat").alias("dlat"),
                                      F.coalesce(F.sum("lk"), F.lit(0)).alias("lk"), F.sum("tracked").alias("tracked"))
        total = dense.groupBy(DATE).agg(F.sum("n").alias("total"), F.sum("new").alias("newly_added")).join(F.broadcast(dim), DATE)
        frozen = longitudinal.frozen_weeks(hub.join(F.broadcast(dim), DATE).select(DATE, "t", "n", "lk"))
        return {
            "by_type": dense.select(*keys, F.col("dl").alias("downloads"), F.col("lk").alias("likes"), F.col("dlat").alias("downloadsAllTime")),
            "counts": dense.join(longitudinal.running(total), DATE).select(*keys, "n", "total", "delta"),
            "vectors": dense.join(F.broadcast(hub.select(DATE, "tracked")), DATE)
            .select(*keys, "dl", F.when(F.col("tracked") > 0, F.col("dlat")).alias("dlat"), "lk", "n", "new"),
            "hub": hub.select(DATE, "n", "dl", "dlat", "lk"),
            "cumulative": longitudinal.running(total).select(DATE, "newly_added", "cumulative"),
            "frozen": frozen,
            "drivers": longitudinal.smoothed_drivers(full.select(*keys, "dlat", "lk"), hub.select(DATE, "tracked"), dim, frozen, self.types),
        }

    def _local(self, table: str) -> DataFrame:
        """A table of at most weeks x types rows, held by the driver: the small tables are seven short plans over it."""
        return self.spark.createDataFrame(self._rows(table).collect(), self.fields[table])

    def _put_differing(self, table: str, df: DataFrame, epoch: int) -> list[dt.date]:
        """Write the weeks whose rows differ from the published ones (tables of at most weeks x types rows)."""
        def by_week(rows: DataFrame) -> dict[dt.date, Counter]:
            out: dict[dt.date, Counter] = {}
            for r in rows.select(*df.columns).collect():
                out.setdefault(r[DATE], Counter())[tuple(r)] += 1
            return out

        new, old = by_week(df), by_week(self._rows(table)) if table in self.fields else {}
        dates = sorted(d for d in new.keys() | old.keys() if new.get(d) != old.get(d))
        rows = [r for d in dates for r in new.get(d, Counter()).elements()]
        return self._put(table, self.spark.createDataFrame(rows, df.schema).coalesce(1), epoch, dates) if dates else []

    def vacuum(self) -> int:
        """Delete partitions and manifests that the newest manifest does not name; returns how many."""
        self._load()
        last, n = (self.epochs() or [-1])[-1], 0
        conf, path = self.spark._jsc.hadoopConfiguration(), self.spark._jvm.org.apache.hadoop.fs.Path
        stale = [f"manifest/epoch={e}" for e in self.epochs()[:-1]]
        for t, parts in self.parts.items():
            for name in self._children(f"{self.root}/{t}"):
                e = int(name[6:])
                stale += [f"{t}/{name}/{d}" for d in self._children(f"{self.root}/{t}/{name}")
                          if e <= last and d.startswith(f"{DATE}=") and parts.get(dt.date.fromisoformat(d.split("=")[1])) != e]
        for s in stale:
            p = path(f"{self.root}/{s}")
            n += bool(p.getFileSystem(conf).delete(p, True))
        return n


def maintain_stream(spark: SparkSession, src: str, root: str, ckpt: str, orgs: DataFrame, schema: T.StructType,
                    max_files: int = 1, types: Sequence[str] = ORG_TYPES, top: int = 5):
    """Take up the weekly files of a folder that the stream hasn't seen, in order of arrival; returns the query.

    A late week is a file like any other. A re-issued week is a new file with the same date (anything may follow the
    date in its name); of several files of one week in a micro-batch the newest counts. The micro-batch number
    is the store's epoch, so a replay after a crash publishes the same state once.
    """
    file = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)
              .withColumn("_file", file).withColumn(DATE, F.to_date(F.regexp_extract(F.col("_file.path"), WEEK_FILE_RE, 1))))

    def batch(df: DataFrame, epoch: int) -> None:
        newest = df.groupBy(F.col(DATE).alias("_d")).agg(F.max("_file").alias("_newest"))  # one row per week
        rows = df.join(F.broadcast(newest), (F.col(DATE) == F.col("_d")) & (F.col("_file") == F.col("_newest")), "left_semi").drop("_file")
        WeekStore(df.sparkSession, root, types, top).apply(enrich_slim(rows, orgs), epoch)

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
