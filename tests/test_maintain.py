"""Late and re-issued weeks: every dependent table equals the batch operators over the panel as it then is."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdeck.functions.fixed import ORG_TYPES
from snapdeck.operators import longitudinal, ranking, trends
from snapdeck.operators.snapshots import with_ordinal
from snapdeck.streaming.maintain import WeekStore, maintain_stream

COLS = ["_id", "id", "author", "likes", "downloads", "downloadsAllTime"]
SCHEMA = T.StructType([T.StructField(c, T.StringType() if c in COLS[:3] else T.LongType()) for c in COLS])
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(7 * i) for i in range(6)]
LATE = dt.date(2024, 1, 11)  # between the second and the third week
ORGS = [("o0", "company", 1), ("o1", "university", 2), ("o2", "non-profit", 3), ("o3", "unlisted-type", 4)]


def week(seed, ids, tracked=True):
    r = random.Random(seed)
    rows = [(f"i{i}", f"name{i}", f"o{i % 6}" if i % 7 else None, r.randint(0, 50), r.randint(0, 900), r.randint(900, 9000) if tracked else None) for i in ids]
    return rows + rows[:1]  # a row twice in its week


def weeks():
    w = {d: week(k, range(3 * k, 30 + 4 * k), tracked=k > 0) for k, d in enumerate(DAYS)}
    w[DAYS[3]] = w[DAYS[2]]  # a frozen run of two weeks after the third
    w[DAYS[4]] = w[DAYS[2]]
    return w


def deliver(src, d, rows, tag="", at=0):
    os.makedirs(src, exist_ok=True)
    f = f"{src}/week_{d}{tag}.parquet"
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], pa.string() if i < 3 else pa.int64()) for i, c in enumerate(COLS)}), f)
    os.utime(f, (1_700_000_000 + 3600 * at,) * 2)


def expected(spark, state):
    rows = [(d, *r, {"o0": "company", "o1": "university", "o2": "non-profit", "o3": "unlisted-type"}.get(r[2])) for d, w in state.items() for r in w]
    panel = spark.createDataFrame(rows, T.StructType([T.StructField("snapshot_date", T.DateType()), *SCHEMA.fields, T.StructField("org_type", T.StringType())]))
    panel = with_ordinal(panel).cache()
    first = longitudinal.first_seen(panel)
    return {
        "slim": panel.drop("t"), "by_type": trends.metric_by_type(panel), "counts": trends.count_by_type(panel), "vectors": trends.type_vectors(panel),
        "hub": trends.hub_totals(panel), "accounts": ranking.by_account(panel).drop("t"), "spikes": longitudinal.spikes(panel).drop("t"),
        "gains": longitudinal.like_gain(ranking.by_account(panel)).drop("t"),
        "first_seen": first.groupBy("snapshot_date", "_id", "org_type").agg(F.count(F.lit(1)).alias("n")),
        "baseline": panel.filter("downloadsAllTime IS NOT NULL").groupBy("_id").agg(F.min("t").alias("t")).join(panel, ["_id", "t"])
        .groupBy("snapshot_date", "_id").agg(F.min("downloadsAllTime").alias("base")),
        "cumulative": longitudinal.newly_added_cumulative(panel), "frozen": longitudinal.frozen(panel), "drivers": longitudinal.drivers(panel),
    }


def values(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def check(spark, root, state):
    store = WeekStore(spark, root)
    for name, want in expected(spark, state).items():
        got = store.read(name)
        assert sorted(got.columns) == sorted(want.columns), name
        assert values(got) == values(want), name
    return published(spark, root)


def published(spark, root):
    store = WeekStore(spark, root)
    store.read("slim")
    return {n: dict(p) for n, p in store.parts.items()}


@pytest.fixture(scope="module")
def orgs(spark):
    return spark.createDataFrame(ORGS, "author string, csv_type string, followers bigint")


def test_reissued_and_late_weeks(spark, tmpdir_path, orgs):
    src, root, ckpt = (f"{tmpdir_path}/{x}" for x in ("in", "store", "ckpt"))
    state = weeks()
    for k, (d, rows) in enumerate(state.items()):
        deliver(src, d, rows, at=k)
    maintain_stream(spark, src, root, ckpt, orgs, SCHEMA, max_files=4)
    before = published(spark, root)

    # week 3 again: ids leave it, new ids come in that were first seen later, values change, the run after it thaws at its start
    state[DAYS[2]] = week(77, [*range(9, 20), *range(40, 60)])
    deliver(src, DAYS[2], state[DAYS[2]], tag="_v2", at=10)
    maintain_stream(spark, src, root, ckpt, orgs, SCHEMA)
    after = check(spark, root, state)
    for name, parts in after.items():
        same = {d for d, e in parts.items() if before[name].get(d) == e}
        assert {d for d in parts if d < DAYS[2]} <= same, name
    assert {d for d, e in after["slim"].items() if before["slim"][d] != e} == {DAYS[2]}
    assert {d for d, e in after["spikes"].items() if before["spikes"].get(d) != e} == {DAYS[2], DAYS[3]}
    assert {d for d, e in after["accounts"].items() if before["accounts"][d] != e} == {DAYS[2]}

    # a week that comes late, and in the same micro-batch a newer issue of it
    state[LATE] = week(5, range(2, 70))
    deliver(src, LATE, week(6, range(5)), at=11)
    deliver(src, LATE, state[LATE], tag="-again", at=12)
    maintain_stream(spark, src, root, ckpt, orgs, SCHEMA, max_files=2)
    late = check(spark, root, state)
    for name, parts in late.items():
        assert all(after[name].get(d) == e for d, e in parts.items() if d < LATE), name
    panel = with_ordinal(WeekStore(spark, root).read("slim"))
    stored = longitudinal.growth(panel, top=4, base=WeekStore(spark, root).read("baseline").select("_id", "base"))
    assert values(stored) == values(longitudinal.growth(panel, top=4))
    assert {d for d, e in late["gains"].items() if after["gains"].get(d) != e} == {LATE, DAYS[2]}

    # a run without new files changes nothing; old partitions and manifests can be dropped
    maintain_stream(spark, src, root, ckpt, orgs, SCHEMA)
    store = WeekStore(spark, root)
    assert published(spark, root) == late
    rows = store.read("drivers").collect()
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert published(spark, root) == late and store.read("drivers").collect() == rows and store.read("slim").count() == sum(map(len, state.values()))


def test_week_before_all_others(spark, tmpdir_path, orgs):
    from snapdeck.sources.ingest import enrich_slim
    state = {d: w for d, w in weeks().items() if d in DAYS[1:4]}

    def rows(days):
        flat = [(d, *r) for d in days for r in state[d]]
        return enrich_slim(spark.createDataFrame(flat, T.StructType([T.StructField("snapshot_date", T.DateType()), *SCHEMA.fields])), orgs, COLS)
    store = WeekStore(spark, tmpdir_path)
    store.apply(rows(state), 0)
    state[DAYS[0]] = weeks()[DAYS[0]]
    store.apply(rows([DAYS[0]]), 1)
    want = check(spark, tmpdir_path, state)
    # an epoch without rows publishes the same state
    store.apply(rows([DAYS[0]]).filter("false"), 2)
    assert published(spark, tmpdir_path) == want and store.epochs() == [0, 1, 2]


def test_replay_and_crash(spark, tmpdir_path, orgs, monkeypatch):
    src, root, ckpt = (f"{tmpdir_path}/{x}" for x in ("in", "store", "ckpt"))
    state = {d: w for d, w in weeks().items() if d in DAYS[:3]}
    for k, (d, rows) in enumerate(state.items()):
        deliver(src, d, rows, at=k)
    maintain_stream(spark, src, root, ckpt, orgs, SCHEMA, max_files=3)
    before = published(spark, root)
    os.remove(f"{ckpt}/commits/0")  # the last micro-batch was published, its commit lost: the replay changes nothing
    os.remove(f"{ckpt}/commits/.0.crc")
    maintain_stream(spark, src, root, ckpt, orgs, SCHEMA)
    assert published(spark, root) == before

    state[DAYS[1]] = week(50, range(10, 50))
    deliver(src, DAYS[1], state[DAYS[1]], tag="_v2", at=10)
    with monkeypatch.context() as m:  # everything is written, the manifest is not
        m.setattr(WeekStore, "_publish", lambda self, epoch: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            maintain_stream(spark, src, root, ckpt, orgs, SCHEMA)
    assert published(spark, root) == before
    maintain_stream(spark, src, root, ckpt, orgs, SCHEMA)
    check(spark, root, state)


def test_later_weeks_may_bring_columns(spark, tmpdir_path):
    a = spark.createDataFrame([(DAYS[0], "i1", "n", "a", 1, 2, None, None)], "snapshot_date date, _id string, id string, author string, likes long, downloads long, downloadsAllTime long, org_type string")
    b = a.withColumn("snapshot_date", F.lit(DAYS[1])).withColumn("mainSize", F.lit(5.0)).withColumn("org_type", F.lit(ORG_TYPES[0]))
    store = WeekStore(spark, tmpdir_path)
    store.apply(a, 3)
    store.apply(b, 7)
    assert sorted((r.snapshot_date, r.mainSize) for r in store.read("slim").collect()) == [(DAYS[0], None), (DAYS[1], 5.0)]
