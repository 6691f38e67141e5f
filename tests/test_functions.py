"""Column functions on hand-made values."""

from pyspark.sql import functions as F

from snapdeck.functions import numeric, tags


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_round_sig_half_even(spark):
    vals = [1225, 1235, 999500, 0, None, -1235, 7, 12, 123, 1234, 12345678901234]
    got = _one(spark, [(v,) for v in vals], "v bigint", numeric.round_sig("v", 3))
    assert got == [1220, 1240, 1000000, 0, None, -1240, 7, 12, 123, 1230, 12300000000000]


def test_round_sig_matches_python(spark):
    import random
    random.seed(1)
    vals = [random.randint(1, 10 ** random.randint(1, 15)) for _ in range(300)] + [5, 15, 25, 125, 135, 1250, 1350]
    got = _one(spark, [(v,) for v in vals], "v bigint", numeric.round_sig("v", 3))
    # Python's round on ints is exact half-even, the reference rule
    import math
    exp = [int(round(v, 3 - int(math.floor(math.log10(abs(v)))) - 1)) for v in vals]
    assert got == exp


def test_parse_abbrev(spark):
    vals = ["128k", "1.09k", "4.66M", "1,234", "93.9k", "55", "abc", "", " 12 K", "0.0005k"]
    got = _one(spark, [(v,) for v in vals], "v string", numeric.parse_abbrev("v"))
    assert got == [128000, 1090, 4660000, 1234, 93900, 55, 0, 0, 12000, 0]


def test_topic(spark):
    vals = ["task_categories:text-generation", "chemistry", "license:mit", "arxiv:1234", "x"]
    got = _one(spark, [(v,) for v in vals], "v string", tags.topic("v"))
    assert got == ["text-generation", "chemistry", None, None, "x"]


def test_has_paper_and_arxiv(spark):
    rows = [(["arxiv:1", "a", "arxiv:2"],), (None,), ([],), (["b"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = df.select(tags.has_paper("t"), tags.arxiv_ids("t")).collect()
    assert [tuple(r) for r in got] == [(True, ["1", "2"]), (False, []), (False, []), (False, [])]


def test_license_first_tag_and_group(spark):
    rows = [(["license:mit", "license:cc-by-nc-4.0"],), (["license:llama3"],), (["license:weird"],), (["x"],),
            (None,), (["license:openrail"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    lic = tags.license_from_tags("t")
    got = [tuple(r) for r in df.select(lic, tags.license_group(lic)).collect()]
    assert got == [("mit", "Permissive"), ("llama3", "AUP (BigTech)"), ("weird", "Other"), (None, "unspecified"),
                   (None, "unspecified"), ("openrail", "AUP (Community)")]


def test_size_midpoint(spark):
    rows = [(["size_categories:1K<n<10K", "size_categories:n<1K"],), (["size_categories:unmapped"],), (["a"],)]
    got = _one(spark, rows, "t array<string>", tags.size_log10_mid("t"))
    assert got == [3.5, None, None]


def test_license_from_card(spark):
    rows = [('{"license": "mit"}',), ('{"license": ["a", "b"]}',), ('{"license": []}',), ("not json",), ("{}",)]
    got = _one(spark, rows, "c string", tags.license_from_card("c"))
    assert got == ["mit", "a,b", None, None, None]


def test_topic_ids(spark):
    vocab = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(0))
    rows = [(["task_categories:a", "a", "b", "license:x", "zzz"],)]
    got = _one(spark, rows, "t array<string>", tags.topic_ids("t", vocab))
    assert got == [[0, 2]]


def test_log10_pos_and_created_date(spark):
    import datetime as dt
    got = _one(spark, [(100.0,), (0.0,), (-5.0,), (None,)], "v double", numeric.log10_pos("v"))
    assert got == [2.0, None, None, None]
    rows = [("2023-01-05T10:00:00.000Z",), ("2024-12-31",), (None,)]
    got = _one(spark, rows, "c string", numeric.created_date("c"))
    assert got == [dt.date(2023, 1, 5), dt.date(2024, 12, 31), None]


def test_round_sig_float(spark):
    from snapdeck.functions.numeric import round_sig_float
    cases = {123456.0: 123500.0, -0.00123449: -0.001234, 99996.0: 100000.0, 12345.0: 12340.0, 12355.0: 12360.0, 0.0: 0.0}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x double")
    got = {r["x"]: r["y"] for r in df.select("x", round_sig_float("x").alias("y")).collect()}
    assert got.pop(None) is None
    assert all(abs(got[k] - v) <= 1e-12 * max(1.0, abs(v)) for k, v in cases.items()), got
