"""Readers, ingest, page cards and streaming on hand-made files."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from snapdeck.sources import ingest as ING
from snapdeck.sources import readers as R
from snapdeck.sources.pages import extract_org_cards


def _write(path, table):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(table, path)


def test_read_era_three_created_types(spark, tmpdir_path):
    base = {"_id": ["a"], "id": ["o/a"], "author": ["o"], "likes": [1], "downloads": [2]}
    _write(f"{tmpdir_path}/s/hf_datasets_min_2024-07-24.parquet",
           pa.table({**base, "createdAt": ["2023-01-05T10:00:00.000Z"], "downloadsAllTime": pa.nulls(1)}))
    _write(f"{tmpdir_path}/u/hf_datasets_min_2025-03-05.parquet",
           pa.table({**base, "createdAt": pa.array([dt.datetime(2023, 1, 5, 10)], pa.timestamp("us")),
                     "downloadsAllTime": [5]}))
    _write(f"{tmpdir_path}/n/hf_datasets_min_2026-01-07.parquet",
           pa.table({**base, "createdAt": pa.array([dt.datetime(2023, 1, 5, 10)], pa.timestamp("ns")),
                     "downloadsAllTime": [7], "mainSize": [12.0]}))
    df = R.read_era(spark, {"string": [f"{tmpdir_path}/s"], "micros": [f"{tmpdir_path}/u"],
                            "nanos": [f"{tmpdir_path}/n"]})
    got = sorted((r["snapshot_date"].isoformat(), r["createdAt"].isoformat(), r["downloadsAllTime"], r["mainSize"])
                 for r in df.collect())
    assert got == [("2024-07-24", "2023-01-05", None, None), ("2025-03-05", "2023-01-05", 5, None),
                   ("2026-01-07", "2023-01-05", 7, 12.0)]


def test_load_orgs_newest_file_first_row(spark, tmpdir_path):
    d = f"{tmpdir_path}/orgs"
    os.makedirs(d)
    with open(f"{d}/hf_orgs_scraped_2026-01-01.csv", "w") as fh:
        fh.write("slug,org_type,model_count,followers,badge\nold,company,1,5,\n")
    with open(f"{d}/hf_orgs_scraped_2026-04-30.csv", "w") as fh:
        fh.write("slug,org_type,model_count,followers,badge\nacme,company,3,10,\nacme,university,4,11,\nlab,,0,2,x\n")
    got = sorted(tuple(r) for r in R.load_orgs(spark, d).collect())
    assert got == [("acme", "company", 10), ("lab", None, 2)]


def test_load_countries_drops_unknown(spark, tmpdir_path):
    p = f"{tmpdir_path}/c.csv"
    with open(p, "w") as fh:
        fh.write("account,country,confidence\na,US,high\nb,unknown,low\n")
    assert [tuple(r) for r in R.load_countries(spark, p).collect()] == [("a", "US")]


def test_ingest_writes_skips_and_forces(spark, tmpdir_path):
    raw = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "1", "o/x", "o", 3), (dt.date(2024, 1, 8), "1", "o/x", "o", 4),
         (dt.date(2024, 1, 8), "2", "p/y", "p", 1)],
        "snapshot_date date, _id string, id string, author string, downloads bigint")
    orgs = spark.createDataFrame([("o", "company", 1)], "author string, csv_type string, followers bigint")
    out = f"{tmpdir_path}/slim"
    r1 = ING.ingest(raw, orgs, out)
    assert len(r1["written"]) == 2
    r2 = ING.ingest(raw, orgs, out)
    assert len(r2["skipped"]) == 2 and not r2["written"]
    r3 = ING.ingest(raw, orgs, out, force=True)
    assert len(r3["written"]) == 2
    got = sorted((r["snapshot_date"].isoformat(), r["_id"], r["org_type"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", "1", "company"), ("2024-01-08", "1", "company"), ("2024-01-08", "2", None)]


CARD = ('<a href="/{slug}" class="card"><span class="capitalize">{ty}</span> {name}'
        '<span class="x -skew-x-12 y">{badge}</span> {models} models · {followers} followers</a>')


def test_page_cards(spark):
    html1 = ("<html>" + CARD.format(slug="acme", ty="Company", name="Acme", badge="Team", models="12",
                                     followers="1.09k")
             + CARD.format(slug="two/seg", ty="Company", name="X", badge="", models="1", followers="3")
             + '<a href="/nofollow">No followers here</a>'
             + CARD.format(slug="big", ty="University", name="Big", badge="", models="4.66M", followers="1,234")
             + "</html>")
    html2 = "<html>" + CARD.format(slug="acme", ty="Non-Profit", name="Acme", badge="", models="1", followers="9") + "</html>"
    pages = spark.createDataFrame([(2, "u2", html2), (1, "u1", html1)], "page_id bigint, url string, html string")
    got = {r["slug"]: tuple(r)[1:] for r in extract_org_cards(pages).collect()}
    assert got == {"acme": ("company", 12, 1090, "Team"), "big": ("university", 4660000, 1234, None)}


def test_streaming_ingest_equals_batch(spark, tmpdir_path):
    from pyspark.sql import types as T
    from snapdeck.streaming.ingest_stream import ingest_stream
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("author", T.StringType()),
                           T.StructField("downloads", T.LongType())])
    src = f"{tmpdir_path}/incoming"
    weeks = {"2024-01-01": [("1", "o", 1), ("2", "p", 2)], "2024-01-08": [("1", "o", 3), ("3", "o", 4)],
             "2024-01-15": [("3", "o", 5), ("4", "p", 6), ("2", "p", 1)]}
    for k, (d, rows) in enumerate(weeks.items()):
        f = f"{src}/hf_datasets_min_{d}.parquet"
        _write(f, pa.table({"_id": [r[0] for r in rows], "author": [r[1] for r in rows],
                            "downloads": [r[2] for r in rows]}))
        os.utime(f, (1_700_000_000 + 3600 * k, 1_700_000_000 + 3600 * k))  # weekly files arrive in date order
    orgs = spark.createDataFrame([("o", "company", 1)], "author string, csv_type string, followers bigint")
    out, ck, seen, new = (f"{tmpdir_path}/{x}" for x in ("out", "ckpt", "seen", "new"))
    ingest_stream(spark, src, out, ck, orgs, schema, seen=seen, new_out=new, max_files=1)
    got = sorted((r["snapshot_date"].isoformat(), r["_id"], r["org_type"]) for r in spark.read.parquet(out).collect())
    batch = R.read_panel(spark, src, schema, layout="files")
    exp = sorted((r["snapshot_date"].isoformat(), r["_id"], r["org_type"])
                 for r in ING.enrich_slim(batch, orgs, ["_id", "author", "downloads"]).collect())
    assert got == exp
    newc = {(r["snapshot_date"].isoformat(), r["org_type"]): r["new"]
            for r in spark.read.parquet(new).groupBy("snapshot_date", "org_type").agg(F.sum("new").alias("new")).collect()}
    assert newc == {("2024-01-01", "company"): 1, ("2024-01-01", None): 1, ("2024-01-08", "company"): 1,
                    ("2024-01-15", None): 1}
    # a second run with no new files processes nothing new
    ingest_stream(spark, src, out, ck, orgs, schema, seen=seen, new_out=new, max_files=1)
    assert spark.read.parquet(seen).count() == 4
    # a crash before the last commit replays the batch: same rows, once
    for name in ("2", ".2.crc"):
        os.remove(f"{ck}/commits/{name}")
    ingest_stream(spark, src, out, ck, orgs, schema, seen=seen, new_out=new, max_files=1)
    assert spark.read.parquet(seen).count() == 4 and spark.read.parquet(new).agg(F.sum("new")).first()[0] == 4


def test_only_a_missing_table_counts_as_none(spark, tmpdir_path):
    import pytest
    assert ING.table_or_none(spark, f"{tmpdir_path}/nothing") is None
    os.makedirs(f"{tmpdir_path}/bad")
    with open(f"{tmpdir_path}/bad/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception, match="bad"):
        ING.existing_dates(spark, f"{tmpdir_path}/bad")


def test_read_hubs_and_sinks(spark, tmpdir_path):
    ds = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1)], "snapshot_date date, author string, downloads bigint")
    md = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 5, 2)],
                               "snapshot_date date, author string, downloads bigint, likes bigint")
    h = R.read_hubs(ds, md)
    assert sorted((r["hub"], r["downloads"], r["likes"]) for r in h.collect()) == [("ds", 1, None), ("md", 5, 2)]
    for fmt in ("parquet", "csv", "json"):
        out = f"{tmpdir_path}/res_{fmt}"
        ING.write_result(h, out, fmt=fmt, sort=["hub"])
        back = (spark.read.option("header", True).csv(out) if fmt == "csv" else
                spark.read.json(out) if fmt == "json" else spark.read.parquet(out))
        assert back.count() == 2


def test_adoption_stream_equals_batch(spark, tmpdir_path):
    from snapdeck.operators.adoption import adoption
    from snapdeck.sources import driver
    from snapdeck.streaming.ingest_stream import adoption_counts, adoption_stream
    models = driver.model_links(spark, "/root/testdata/sf0.001")
    src = f"{tmpdir_path}/models"
    for k in range(3):  # three arrivals of model rows
        part = models.filter(F.col("model_id") % 3 == k).toPandas()
        f = f"{src}/models_{k}.parquet"
        _write(f, pa.Table.from_pandas(part, preserve_index=False))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    adoption_stream(spark, src, models.schema, f"{tmpdir_path}/ck", f"{tmpdir_path}/live")
    got = sorted(tuple(r) for r in adoption_counts(spark, f"{tmpdir_path}/live").collect())
    exp = sorted(tuple(r) for r in adoption(models).collect())
    assert got == exp and len(got) > 0
    from snapdeck.streaming.epochs import compact
    assert compact(spark, f"{tmpdir_path}/live", ["dataset_id"]) == 2
    assert sorted(tuple(r) for r in adoption_counts(spark, f"{tmpdir_path}/live").collect()) == exp


def test_trend_and_org_builds_write_consistent_tables(spark, tmpdir_path):
    from snapdeck.plans import catalog as C
    from snapdeck.plans.builds import org_build, trend_build
    from snapdeck.sources import driver
    sf = "/root/testdata/sf0.001"
    p = driver.panel(spark, sf)
    paths = trend_build(p, f"{tmpdir_path}/trends", pool=50)
    series = spark.read.parquet(paths["series"])
    pool = spark.read.parquet(paths["pool"])
    assert series.select("_id").distinct().count() == pool.count() > 0
    hub = {r["snapshot_date"]: r["n"] for r in spark.read.parquet(paths["hub"]).collect()}
    assert sum(hub.values()) == p.count()
    opaths = org_build(C.rejoined(spark, sf), f"{tmpdir_path}/orgs", top_pool=2000)
    by_type = spark.read.parquet(opaths["by_type"])
    assert by_type.groupBy().sum("n").collect()[0][0] == p.count()
    for name in ("concentration", "ranks", "org_series", "size", "size_f", "hists", "frozen", "drivers"):
        assert spark.read.parquet(opaths[name]).count() > 0, name


def _era_folder(d):
    base = {"_id": ["a"], "id": ["o/a"], "author": ["o"], "likes": [1], "downloads": [2]}
    when = dt.datetime(2023, 1, 5, 10)
    _write(f"{d}/hf_datasets_min_2024-07-24.parquet", pa.table({**base, "createdAt": ["2023-01-05T10:00:00.000Z"], "downloadsAllTime": pa.nulls(1)}))
    _write(f"{d}/hf_datasets_min_2024-07-31.parquet", pa.table(base))  # neither date nor all-time column
    _write(f"{d}/hf_datasets_min_2025-03-05.parquet", pa.table({**base, "createdAt": pa.array([when], pa.timestamp("us")), "downloadsAllTime": [5]}))
    _write(f"{d}/hf_datasets_min_2025-03-12.parquet", pa.table({**base, "createdAt": pa.array([when], pa.timestamp("us", "UTC")), "downloadsAllTime": [6]}))
    _write(f"{d}/hf_datasets_min_2026-01-07.parquet", pa.table({**base, "createdAt": pa.array([when], pa.timestamp("ns")), "downloadsAllTime": [7], "mainSize": [12.0]}))
    _write(f"{d}/notes.parquet", pa.table({"other": [1]}))


def test_eras_are_found_in_the_footers(spark, tmpdir_path):
    import pytest
    _era_folder(tmpdir_path)
    eras, bad = R.discover_eras(spark, tmpdir_path)
    assert {k: [f[-18:-8] for f in v] for k, v in eras.items()} == {
        "string": ["2024-07-24", "2024-07-31"], "micros": ["2025-03-05", "2025-03-12"], "nanos": ["2026-01-07"]} and not bad
    got = sorted((str(r["snapshot_date"]), str(r["createdAt"]), r["downloadsAllTime"], r["mainSize"]) for r in R.read_folder(spark, tmpdir_path).collect())
    day = "2023-01-05"
    assert got == [("2024-07-24", day, None, None), ("2024-07-31", "None", None, None), ("2025-03-05", day, 5, None), ("2025-03-12", day, 6, None), ("2026-01-07", day, 7, 12.0)]
    with open(f"{tmpdir_path}/hf_datasets_min_2026-01-14.parquet", "w") as f:
        f.write("no footer")
    _, bad = R.discover_eras(spark, tmpdir_path)
    assert [f[-18:-8] for f in bad] == ["2026-01-14"]
    with pytest.raises(ValueError, match="2026-01-14"):
        R.read_folder(spark, tmpdir_path)


def test_orgs_keep_file_order_over_splits(spark, tmpdir_path):
    """Rows of one CSV read in many splits: the first row of each slug in the file; the date stamp decides, not the path."""
    os.makedirs(f"{tmpdir_path}/a")
    os.makedirs(f"{tmpdir_path}/z")
    with open(f"{tmpdir_path}/z/hf_orgs_scraped_2025-01-01.csv", "w") as f:
        f.write("slug,org_type,model_count,followers,badge\nold,company,1,5,\n")
    first = {}
    with open(f"{tmpdir_path}/a/hf_orgs_scraped_2026-04-30.csv", "w") as f:
        f.write("slug,org_type,model_count,followers,badge\n")
        for i in range(4000):
            slug = f"s{i * 7 % 501}"
            first.setdefault(slug, i)
            f.write(f"{slug},company,1,{i},{'x' * (i * 37 % 90)}\n")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r["author"]: r["followers"] for r in R.load_orgs(spark, f"{tmpdir_path}/*").collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == first


def test_ingest_in_one_job_names_the_bad_file(spark, tmpdir_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("author", T.StringType()), T.StructField("downloads", T.LongType())])
    orgs = spark.createDataFrame([("o", "company", 1)], "author string, csv_type string, followers bigint")
    days = [dt.date(2024, 1, 1) + dt.timedelta(7 * k) for k in range(20)]
    for k, d in enumerate(days):
        _write(f"{tmpdir_path}/in/w_{d}.parquet", pa.table({"_id": [str(i) for i in range(k + 1)], "author": ["o"] * (k + 1), "downloads": list(range(k + 1))}))
    with open(f"{tmpdir_path}/in/w_{days[7]}.parquet", "r+b") as f:
        f.write(b"XXXX")
        f.seek(-4, 2)
        f.write(b"XXXX")
    rows, dates = ING.raw_files(spark, f"{tmpdir_path}/in", schema)
    asked = []

    def counted(batch):
        asked.append(len(batch))
        return rows(batch)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    report = ING.ingest(counted, orgs, f"{tmpdir_path}/out", dates=dates)
    assert report["failed"] == [days[7]] and str(days[7]) in report["reasons"][days[7]] and asked == [20, 19]
    assert report["written"] == [d for d in days if d != days[7]] and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    got = {r["snapshot_date"]: r["count"] for r in spark.read.parquet(f"{tmpdir_path}/out").groupBy("snapshot_date").count().collect()}
    assert got == {d: k + 1 for k, d in enumerate(days) if k != 7}
    # the mended file is the only one taken up by the next run
    _write(f"{tmpdir_path}/in/w_{days[7]}.parquet", pa.table({"_id": ["x"], "author": ["o"], "downloads": [1]}))
    asked.clear()
    report = ING.ingest(counted, orgs, f"{tmpdir_path}/out", dates=dates)
    assert report["written"] == [days[7]] and len(report["skipped"]) == 19 and asked == [1]


def test_ingest_narrows_down_an_unnamed_error(spark, tmpdir_path):
    orgs = spark.createDataFrame([("o", "company", 1)], "author string, csv_type string, followers bigint")
    days = [dt.date(2024, 1, 1) + dt.timedelta(7 * k) for k in range(5)]

    def rows(batch):
        if days[3] in batch:
            raise RuntimeError("somewhere in here")
        return spark.createDataFrame([(d, "1", "o", 1) for d in batch], "snapshot_date date, _id string, author string, downloads long")
    report = ING.ingest(rows, orgs, f"{tmpdir_path}/out", dates=days)
    assert report["failed"] == [days[3]] and report["written"] == [d for d in days if d != days[3]]


def test_first_seen_state_equals_batch(spark, tmpdir_path):
    """Weeks in several runs, a row twice in its week, a replay of the last week."""
    import random
    from pyspark.sql import types as T
    from snapdeck.operators import longitudinal as L
    from snapdeck.operators.snapshots import with_ordinal
    from snapdeck.streaming.ingest_stream import first_seen_stream
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("author", T.StringType())])
    orgs = spark.createDataFrame([("o0", "company", 1), ("o1", "university", 1)], "author string, csv_type string, followers bigint")
    r, src, ck, out, flat = random.Random(3), f"{tmpdir_path}/in", f"{tmpdir_path}/ck", f"{tmpdir_path}/new", []
    for k in range(4):
        d = dt.date(2024, 1, 1) + dt.timedelta(7 * k)
        ids = [f"i{r.randint(0, 40 + 30 * k)}" for _ in range(60)]
        rows = [(i, f"o{int(i[1:]) % 3}") for i in ids + ids[:3]]
        flat += [(d, i, {"o0": "company", "o1": "university"}.get(a)) for i, a in rows]
        _write(f"{src}/w_{d}.parquet", pa.table({"_id": [x[0] for x in rows], "author": [x[1] for x in rows]}))
        os.utime(f"{src}/w_{d}.parquet", (1_700_000_000 + k,) * 2)
        if k in (1, 3):
            first_seen_stream(spark, src, ck, out, orgs, schema)
    panel = with_ordinal(spark.createDataFrame(flat, "snapshot_date date, _id string, org_type string"))
    want = {(x["snapshot_date"], x["org_type"]): x["count"] for x in L.first_seen(panel).groupBy("snapshot_date", "org_type").count().collect()}

    def got():
        return {(x["snapshot_date"], x["org_type"]): x["new"] for x in spark.read.parquet(out).collect()}
    assert got() == want
    for name in ("3", ".3.crc"):
        os.remove(f"{ck}/commits/{name}")
    first_seen_stream(spark, src, ck, out, orgs, schema)
    assert got() == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").split(".")[-1] != "RocksDBStateStoreProvider"


def test_page_crawl_resumes(spark, tmpdir_path):
    """Two halves of the pages, the earlier ones last, give the cards of all pages at once, before and after a compaction."""
    from snapdeck.sources import driver
    from snapdeck.streaming.epochs import compact, current
    from snapdeck.streaming.ingest_stream import org_cards_stream
    pages = driver.listing_pages(spark, "/root/testdata/sf0.001")
    want = sorted(map(str, extract_org_cards(pages).collect()))
    src, ck, out = (f"{tmpdir_path}/{x}" for x in ("pages", "ck", "cards"))
    for k, half in enumerate(("page_id % 2 = 1 OR page_id > 1000000005", "page_id % 2 = 0 AND page_id <= 1000000005")):
        part = pages.filter(half).toPandas()
        assert len(part)
        _write(f"{src}/p{k}.parquet", pa.Table.from_pandas(part, preserve_index=False))
        org_cards_stream(spark, src, ck, out)
    assert sorted(map(str, current(spark, out, ["slug"]).collect())) == want and len(want) > 3
    assert compact(spark, out, ["slug"]) == 1 and compact(spark, out, ["slug"]) == 1
    assert sorted(map(str, current(spark, out, ["slug"]).collect())) == want
    assert sorted(os.listdir(out)) == ["epoch=1"] and os.listdir(f"{out}_base") == ["epoch=1"]
