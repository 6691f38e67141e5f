"""Clustering, importance resampling and source mixing: brute force, edge cases, sampling frequencies."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from snapdeck.llm.centroid_clustering import BOUND, cluster, nearest, with_inertia
from snapdeck.llm.common import Scratch
from snapdeck.llm.importance_resampling import feature_buckets, radix_rank, resample
from snapdeck.llm.source_mixing import mix_sources, source_targets

SCHEMA = "doc_id long, text string, source string, id string, size int, rank int, slice int, cluster int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1, 1) for r in rows], SCHEMA)


# --- clustering --------------------------------------------------------------------------------

def brute_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [max(-BOUND, min(BOUND, math.floor(1024 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    sq = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((sq(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        to = [n for _, n in assign()]
        for n in set(to):
            mine = [v for (_, v), t in zip(kept, to, strict=True) if t == n]
            centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return Counter((i, n, d) for (i, _), (d, n) in zip(kept, assign(), strict=True)), centroids


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int, distance int")


def test_orchard_is_exact():
    rng = np.random.default_rng(1)
    for k in (1, 2, 7, 40):
        x, c = rng.integers(-3, 4, (300, 3)), rng.integers(-3, 4, (k, 3))  # a coarse grid has many ties and equal centroids
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        for start in {0, k - 1}:
            to, dist = nearest(x, c, start)
            assert (dist == d.min(1)).all() and (to == d.argmin(1)).all()


def test_cluster_edges(spark):
    r = random.Random(5)
    point = lambda at: [at + r.gauss(0, 0.2) for _ in range(64)]
    rows = [(i, point(i % 5)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[3][1]), (None, point(1)), (102, [-2.0] * 64), (103, [1e300] * 64), (104, [0.0] * 64)]
    rows += [(200, None), (201, [1.0] * 63), (202, [1.0] * 65), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("inf")] * 64), (206, [])]
    want, centroids = brute_clusters(rows)
    found, got_centroids = cluster(vectors(spark, rows).repartition(3))
    got = with_inertia(found, got_centroids).collect()
    assert got_centroids == centroids and Counter((x.vec_id, x.cluster, x.distance) for x in got) == want
    total = sum(d * n for (_, _, d), n in want.items())
    assert all(x.inertia == total and x.cluster_inertia == sum(d * n for (_, c, d), n in want.items() if c == x.cluster) for x in got)
    assert all(x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest() for x in got)


def test_cluster_few_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [1.5] * 64)]
    found, centroids = cluster(vectors(spark, rows))
    assert len(centroids) == 3 and Counter((x.vec_id, x.cluster, x.distance) for x in found.collect()) == brute_clusters(rows)[0]
    found, centroids = cluster(vectors(spark, [(1, None), (2, [1.0])]))
    assert centroids == [] and with_inertia(found, centroids).count() == 0
    assert with_inertia(*cluster(vectors(spark, []))).count() == 0


# --- importance resampling ---------------------------------------------------------------------

def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def features(t):
    w = words(t)
    return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute_resample(rows, target):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    can = sorted((r for r, (_, x) in zip(out, rows, strict=True) if len(words(x)) >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(can[:25 * len(can) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("target", [["Alpha beta, GAMMA delta\x00alpha beta", None, "", "ünd alpha"], []])
def test_resample(spark, target):
    r = random.Random(2)
    vocabulary = ["alpha", "Beta", "gamma-delta", "ünd", "x1", "É", "中文", "omega"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n.;"), (None, " ".join(["alpha"] * 30)), (-7, "alpha " * 50), (2 ** 62, "beta " * 50), (-2 ** 62, "beta " * 19),
             (503, "one"), (504, "word " * 60_000 + "Tail"), (505, "ab\x00" * 700_000), (20, rows[20][1]), (20, rows[20][1])]
    got = resample(frame(spark, [(i, t, "s") for i, t in rows]).repartition(4), spark.createDataFrame([(x,) for x in target], "text string"))
    assert Counter((x.doc_id, x.n_features, x.weight, x.score, x["rank"]) for x in got.collect()) == brute_resample(rows, target)
    assert resample(frame(spark, []), spark.createDataFrame([], "text string")).count() == 0


def test_pieces_join_up():
    for n in (1, 2, 3, 4):
        text = " ".join(f"w{i % 977}" for i in range(400_000)).encode()
        got = sum((Counter(x.tolist()) for _, x in feature_buckets(text, n, 10 ** 9)), Counter())
        w = text.split()
        assert got == Counter(zlib.crc32(b" ".join(w[i:i + k])) % 10 ** 9 for k in range(1, n + 1) for i in range(len(w) - k + 1))


@pytest.mark.parametrize("block", [7, 4096])
def test_radix_rank(spark, block):
    r = random.Random(block)
    edge = [-2 ** 63, 2 ** 63 - 1, 0, -1, 1, 255, 256, -256]
    for keys in ([(r.choice(edge), r.randint(-500, 500)) for _ in range(300)], [(5, 5)] * 40, [(7, -7)]):
        rows = [(a, b, (i % 3 << 33) + i) for i, (a, b) in enumerate(keys)]
        df = spark.createDataFrame(rows, "a long, b long, _pos long").withColumn("at", radix_pos())
        got = [x.at for x in sorted(radix_rank(df, ["b", "a"], Scratch(spark, "radix-test"), block).collect(), key=lambda x: x["_rank"])]
        assert got == [p for _, _, p in sorted(rows)]
    empty = spark.createDataFrame([], "a long, _pos long")
    assert radix_rank(empty, ["a"], Scratch(spark, "radix-test")).count() == 0


def radix_pos():
    from pyspark.sql import functions as F
    return F.col("_pos").alias("at")


# --- mixing ------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    w = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    budget, target, open_ = percent * sum(sizes.values()) / 100, {}, set(order)
    while open_:
        share = (budget - sum(target.values())) / sum(w[x] for x in open_)
        over = {x for x in open_ if share * w[x] > most * sizes[x]}
        if not over:
            return target | {x: share * w[x] for x in open_}
        target |= {x: float(most * sizes[x]) for x in over}
        open_ -= over
    return target


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def corpus(r):
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "a", "a", "b", "c", "é", None, "\U0001F600", "�"])) for i in range(400)]
    return rows + [(1000, None, "empty"), (1001, "", "empty"), (None, "x y z", "b"), (1002, "w " * 30_000, "c"), (5, rows[5][1], rows[5][2]), (5, "other text", "b")]


def test_mix(spark):
    rows = corpus(random.Random(3))
    docs = frame(spark, rows)
    got = mix_sources(docs.repartition(5)).collect()
    key = lambda x: (x.doc_id, x.source, x.size, x.taken)
    assert Counter((x.doc_id, x.source, x.size) for x in got) == Counter((i, s, size(t)) for i, t, s in rows)
    assert Counter(map(key, got)) == Counter(map(key, mix_sources(docs.coalesce(1)).collect()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = brute_targets(sizes), defaultdict(int)
    assert max(want[x] / sizes[x] for x in sizes if sizes[x]) == 2 and min(want[x] / sizes[x] for x in sizes if sizes[x]) < 2
    for x in got:
        taken[x.source] += x.taken
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and 0 <= x.taken <= 2 * x.size
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s] + 1e-6) for s in sizes}
    # one document of a source at most is taken in part
    part = Counter(x.source for x in got if x.size and x.taken % x.size)
    assert not part or max(part.values()) == 1
    assert mix_sources(frame(spark, [])).count() == 0
    assert [x.taken for x in mix_sources(frame(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


def test_source_targets(spark):
    r = random.Random(4)
    for n in (1, 2, 3, 50):
        sizes = {f"s{i}": r.choice([0, 1, 10, 1000, 10 ** 6]) for i in range(n)}
        for percent, most in ((150, 2), (90, 1), (20, 3)):
            rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), percent=percent, most=most).collect()
            assert {x.source: x.target for x in rows} == pytest.approx(brute_targets(sizes, percent=percent, most=most))


def test_pareto_frequencies(spark):
    """Over many seeds documents are included as often as their odds say, and the size of the sample does not vary."""
    rows = [(i, "w w w", "a") for i in range(200)] + [(1000 + i, "w w w", "b") for i in range(200)]
    docs = frame(spark, rows).selectExpr("*", "if(doc_id % 2 = 0, 4.0D, 1.0D) odds").cache()
    hits, seeds = Counter(), 6
    for seed in range(seeds):
        got = mix_sources(docs, percent=50, most=1, weights=(1,), seed=seed, odds_col="odds").collect()
        assert sum(x.taken for x in got) == 600
        hits.update(x.doc_id for x in got if x.taken == x.size)
    even, odd = (sum(n for i, n in hits.items() if i % 2 == k) / (200 * seeds) for k in (0, 1))
    # p = 2/3 and 1/3 have odds 4 times apart and mean 1/2
    assert abs(even - 2 / 3) < 0.05 and abs(odd - 1 / 3) < 0.05
