"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # top-N pools go up to 2000 per snapshot and metric: let Spark prune them
    # map-side (WindowGroupLimit) instead of only up to its default of 1000
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
}


def build_session(master: str | None = None, app: str = "snapdeck", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return the active session or create one with the library defaults.

    On a cluster the launcher sets ``master``; locally pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the setting is absent in local mode (tests) a scratch folder is
    created and registered; on a cluster the setting must name a shared
    folder, and its absence is an error rather than a silent local path.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        # local mode (tests): one process, so a scratch folder is shared by all tasks
        d = tempfile.mkdtemp(prefix="snapdeck-ckpt-", dir=os.environ.get("SNAPDECK_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        pass
    return d


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application."""
    return spark.conf.get("spark.app.id", None) or spark.sparkContext.applicationId
