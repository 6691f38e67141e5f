"""The whole pipeline against brute force: every stage recomputed by plain loops, whole rows compared."""

import random
import re
import zlib

import numpy as np
import pytest
from test_edges import brute_components, brute_hits, brute_lines
from test_models import naive_best_fit

import corpus_pipeline
from snapdeck.llm.packing import CAPACITY
from snapdeck.llm.quality import SHRINK_POOLED, SHRINK_SPHERE, TEMPERATURE, THRESHOLD, features

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    words = ["the", "river", "Old", "stone", "bridge", "carries", "people", "over", "water", "each", "morning", "while", "market", "sellers", "open", "their", "doors"]
    out = []
    while len(out) < n:
        k = r.randint(6, 12)
        out += [*(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.02 else "") for _ in range(k - 1)), r.choice(words) + r.choice([".", ",", "."])]
    lines = [" ".join(out[i:i + 15]) for i in range(0, n, 15)]
    return "\n".join(lines)


def corpus():
    r = random.Random(12)
    bench = [(i, prose(random.Random(100 + i), 25).replace("\n", " ")) for i in range(4)] + [(9, "Tiny item!"), (10, None), (11, "")]
    rows, labels = [], []
    for i in range(150):
        text = prose(r, 150 if i == 20 else r.randint(20, 120))
        if i < 100 and i % 2:
            text = "HOME | about us\n" + text  # on half of the pages of a large source
        if i % 17 == 3:
            cut = bench[i % 4][1].split()
            text += "\n" + " ".join(cut[5:5 + (12 if i % 2 else 9)])  # 12 words are a hit, 9 are none
        rows.append((i, text, "en", "big" if i < 100 else f"small{i % 5}", len(text)))
        labels.append((i, 1, 0))
    for i in range(6):  # near copies of different sources, and a chain
        words = rows[20][1].split(" ")
        words[3 * i % len(words)] = f"changed{i}"
        rows.append((200 + i, " ".join(words), "en", f"small{i % 5}", None))
    rows += [(210, rows[30][1], "en", None, None), (211, rows[30][1], None, "big", None), (7000, prose(r, 5000), "en", "long", 1)]
    for i in range(60):
        rows.append((300 + i, " ".join(r.choice(["$$$", "WIN!!!", "0x%d" % r.randint(0, 9999), "###", "CLICK", "!!!"]) for _ in range(r.randint(10, 90))), "en", "junk", None))
        labels.append((300 + i, 0, 1))
    rows += [(400, None, None, None, None), (401, "", "en", "big", 0), (402, " \n\t ", "en", "small1", 4), (403, "tiny item", "en", "small2", 9)]
    return rows, labels, bench


def write(spark, path, rows, labels, bench):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def brute_quality(rows, labels):
    text = {r[0]: r[1] for r in rows}
    x = {k: np.array([features(text[i]) for i, q, _ in labels if q == k and zlib.crc32(str(i).encode()) % 4 != 2]) for k in (0, 1)}
    every = np.concatenate((x[0], x[1]))
    mean, scale = every.mean(0), np.sqrt(np.maximum(every.var(0), 1e-6))
    z = {k: (v - mean) / scale for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    pooled = sum(len(z[k]) * cov[k] for k in z) / len(every)
    density = {}
    for k, v in z.items():
        c = (1 - SHRINK_POOLED) * cov[k] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_SPHERE) * c + SHRINK_SPHERE * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        density[k] = (v.mean(0), np.linalg.inv(c), np.linalg.slogdet(c)[1], np.log(len(v) / len(every)))

    def score(t):
        p = (features(t) - mean) / scale
        d = [prior - 0.5 * logdet - 0.5 * (p - mu) @ inv @ (p - mu) for mu, inv, logdet, prior in (density[0], density[1])]
        return 1 / (1 + np.exp(-np.clip((d[1] - d[0]) / TEMPERATURE, -700, 700)))
    return [r for r in rows if score(r[1]) >= THRESHOLD]


def brute_pipeline(rows, labels, bench):
    kept = [brute_quality(rows, labels)]
    texts = {i: t for i, _, _, t in brute_lines([(r[0], r[1], r[3]) for r in kept[-1]])}
    kept.append([(r[0], texts[r[0]], *r[2:]) for r in kept[-1]])
    name = {int(i): c for i, _, c in brute_components([(r[0], r[1], r[3]) for r in kept[-1]])}
    kept.append([r for r in kept[-1] if name[r[0]] == str(r[0])])
    kept.append([r for r in kept[-1] if not brute_hits(r[1], bench)[1]])
    items, empty = [], []
    for r in kept[-1]:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        items += [(r[0], p, p * CAPACITY, min(CAPACITY, n - p * CAPACITY), r[3], r[1] or "") for p in range(-(-n // CAPACITY))]
        empty += [(r[0], 0, 0, 0, None, None)] if not n else []
    items.sort(key=lambda x: (-x[3], x[0], x[1]))
    placed = naive_best_fit([(x[3], x[4], x[5]) for x in items], CAPACITY)
    return kept, [(*x[:4], b, p) for x, (b, p) in zip(items, placed, strict=True)] + empty


def test_whole_run_by_brute_force(spark, tmp_path):
    rows, labels, bench = corpus()
    write(spark, tmp_path, rows, labels, bench)
    kept, packed = brute_pipeline(rows, labels, bench)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(map(str, (tuple(r) for r in docs.collect()))) == sorted(map(str, kept[k])), name
    # each stage has work to do here: junk, a menu, near copies and benchmark passages go, clean documents stay
    sizes = [len(rows), *map(len, kept)]
    assert sizes[1] < sizes[0] - 50 and sizes[2] == sizes[1] and sizes[3] <= sizes[2] - 6 and sizes[4] < sizes[3]
    assert sum(a[1] != b[1] for a, b in zip(kept[0], kept[1], strict=True)) >= 50
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.select("doc_id", "piece", "start", "n_words", "bin_id", "position").collect()))) == sorted(map(str, packed))


@pytest.mark.parametrize("case", ["no documents", "no labels", "only null texts"])
def test_pipeline_edges(spark, tmp_path, case):
    rows, labels, bench = corpus()
    rows = {"no documents": [], "no labels": rows[:5] + rows[-4:], "only null texts": [(i, None, None, None, None) for i in (1, 2, None, None, 2)]}[case]
    write(spark, tmp_path, rows, [] if case == "no labels" else labels, [] if case == "only null texts" else bench)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if case == "no documents":
        assert got == []
    elif case == "only null texts":  # nothing tells the texts of one class from the other's: what stays is empty and takes no bin
        assert all(r.n_words == 0 and r.bin_id is None for r in got) and len(got) in (0, 5)
    else:
        assert {r.doc_id for r in got} >= {r[0] for r in rows if not (r[1] or "").strip()}
