"""Published results of the analysed hub used as goldens for our formulas.

The published impact-index table lists, per organisation type and scope, the
raw totals behind each index; rebuilding rows with exactly those totals and
running the operator must give the published indices to 4 dp.  In the
published data the top scope is the 1000 datasets with the most all-time
downloads, and its per-type counts add up to exactly 1000.
"""

import datetime as dt

from pyspark.sql import functions as F

from snapdeck.operators.adoption import impact_index
from snapdeck.operators.distributions import top_k_with_rest

# Published golden rows: type, scope, n, pop, dl, lk, ad, downloads, likes, adoption.
IMPACT = [
    ("company", "all", 29198, 29198, 1.7750, 2.2241, 1.7662, 510999328, 109137, 32291),
    ("university", "all", 23071, 23071, 1.1487, 1.1296, 1.0796, 261309912, 43797, 15596),
    ("community", "all", 59347, 59347, 0.8682, 0.7372, 0.8478, 508001732, 73531, 31506),
    ("non-profit", "all", 54542, 54542, 0.7425, 0.6457, 0.7961, 399285826, 59189, 27188),
    ("classroom", "all", 4039, 4039, 0.1157, 0.1734, 0.1321, 4606379, 1177, 334),
    ("government", "all", 693, 693, 0.1073, 0.3125, 0.2074, 733279, 364, 90),
    ("company", "top", 274, 29198, 1.1717, 1.2147, 1.2242, 432485396, 32512, 13194),
    ("university", "top", 186, 23071, 0.8062, 0.7839, 0.7954, 202003875, 14243, 5819),
    ("community", "top", 263, 59347, 1.1436, 1.1281, 0.9699, 405172682, 28984, 10033),
    ("non-profit", "top", 272, 54542, 0.8366, 0.8240, 0.9614, 306543320, 21894, 10286),
    ("classroom", "top", 4, 4039, 0.1324, 0.0077, 0.0064, 713402, 3, 1),
    ("government", "top", 1, 693, 0.1511, 0.5323, 0.0000, 203526, 52, 0),
]


def _spread(total, count, i):
    """Integer share of row i when ``total`` is spread evenly over ``count`` rows."""
    return (F.lit(total // count) + F.when(i < F.lit(total % count), 1).otherwise(0)).cast("long")


def _rows(spark):
    parts = []
    alls = {r[0]: r for r in IMPACT if r[1] == "all"}
    tops = {r[0]: r for r in IMPACT if r[1] == "top"}
    key = 0
    for t, a in alls.items():
        top = tops[t]
        n_top, n_rest = top[2], a[2] - top[2]
        for n, dl, lk, ad in ((n_top, top[7], top[8], top[9]),
                              (n_rest, a[7] - top[7], a[8] - top[8], a[9] - top[9])):
            if n == 0:
                continue
            i = F.col("id")
            parts.append(spark.range(n).select(
                (F.col("id") + key).alias("_id"), F.lit(t).alias("org_type"),
                _spread(dl, n, i).alias("downloadsAllTime"), _spread(lk, n, i).alias("likes"),
                _spread(ad, n, i).alias("n_models")))
            key += n
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.withColumn("snapshot_date", F.lit(dt.date(2026, 7, 22)))


def test_impact_index_reproduces_published_rows(spark):
    df = _rows(spark)
    got = {(r["org_type"], r["scope"]): r for r in
           impact_index(df, top=None).unionByName(impact_index(df, top=1000)).collect()}
    assert len(got) == 12
    for t, scope, n, pop, dl, lk, ad, downloads, likes, adoption in IMPACT:
        r = got[(t, scope)]
        assert (r["n"], r["pop"], r["downloads"], r["likes"], r["adoption"]) == (n, pop, downloads, likes, adoption)
        for name, exp in (("dl", dl), ("lk", lk), ("ad", ad)):
            assert abs(float(r[name]) - exp) < 1.5e-4, (t, scope, name, r[name], exp)


# Published country totals of the top-1000 cohort and the "not shown" remainder.
COUNTRIES = [("United States", 1173708460), ("Unknown", 363667935), ("China", 106265610), ("Spain", 100742133),
             ("France", 47887007), ("Japan", 36433479), ("United Kingdom", 33511566), ("Singapore", 19942397),
             ("Netherlands", 17970422), ("Canada", 16798430), ("Germany", 14188908)]
TOTAL_DL = 2023397657
NOT_SHOWN = 92281310


def test_top_k_with_rest_remainder(spark):
    # 27 smaller countries sharing the remainder evenly (each below the 11th)
    small = [(f"c{i}", NOT_SHOWN // 27 + (1 if i < NOT_SHOWN % 27 else 0)) for i in range(27)]
    df = spark.createDataFrame(COUNTRIES + small, "country string, dl bigint")
    got = {r["country"]: r for r in top_k_with_rest(df, 11, "country", "dl").collect()}
    assert got["others"]["dl"] == NOT_SHOWN and got["others"]["members"] == 27
    assert sum(r["dl"] for r in got.values()) == TOTAL_DL
    assert abs(float(got["United States"]["share"]) - 1173708460 / TOTAL_DL) < 1e-6


def test_frozen_week_smoothing_published_cells(spark):
    """Published company likes around the frozen week 2024-08-07: the frozen
    snapshot repeats the previous week (30134) and is smoothed to 30592,
    halfway to the next fresh value 31050."""
    from snapdeck.operators.longitudinal import smooth_frozen
    raw = spark.createDataFrame([("company", 0, 30134), ("company", 1, 30134), ("company", 2, 31050)],
                                "org_type string, t int, lk bigint")
    fz = spark.createDataFrame([(1,)], "t int")
    got = [r["lk"] for r in smooth_frozen(raw, fz, ["org_type"], "lk").orderBy("t").collect()]
    assert got == [30134, 30592, 31050]
