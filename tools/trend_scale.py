"""Time the trend build on a large panel: the driver panel repeated with shifted ids.

usage: python tools/trend_scale.py [sf_dir] [copies]
Prints one JSON line: panel rows, seconds to write the panel, seconds of the build and of its tables, rows a second.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from snapdeck.plans import builds  # noqa: E402
from snapdeck.session import build_session, checkpoint_dir  # noqa: E402
from snapdeck.sources import driver  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 72
    spark = build_session(app="trend-scale")
    out = f"{checkpoint_dir(spark)}/trend-scale-{spark.sparkContext.applicationId}"
    p = driver.panel(spark, sf)
    t0 = time.time()
    big = (p.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
           .withColumn("_id", F.col("_id").cast("long") + F.col("_k").cast("long") * 100_000_000)
           .withColumn("id", F.concat("id", F.lit("-"), F.col("_k").cast("string")))
           .withColumn("downloads", F.col("downloads") + F.col("_k")).drop("_k"))
    big.hint("rebalance", "snapshot_date").write.partitionBy("snapshot_date").parquet(f"{out}/panel")
    panel = spark.read.parquet(f"{out}/panel")
    rows = panel.count()
    t1 = time.time()
    steps, write = {}, builds._write

    def timed(df, path, name):
        t = time.time()
        done = write(df, path, name)
        steps[name] = round(time.time() - t, 1)
        return done

    builds._write = timed
    builds.trend_build(panel, f"{out}/tables")
    t2 = time.time()
    print(json.dumps({"rows": rows, "write_sec": round(t1 - t0, 1), "build_sec": round(t2 - t1, 1),
                      "rows_per_sec": round(rows / (t2 - t1)),
                      "steps": steps}))


if __name__ == "__main__":
    main()
