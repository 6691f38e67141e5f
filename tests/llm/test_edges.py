"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from snapdeck.llm.decontaminate import clean_documents, decontaminate
from snapdeck.llm.exact_dedup import exact_dedup
from snapdeck.llm.jaccard_join import jaccard_components, one_of_each
from snapdeck.llm.line_dedup import line_dedup
from snapdeck.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, size int"
WORDS = [f"w{i}" for i in range(400)]
P = " ".join(WORDS[:60])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", 1) for i, t, s in rows], SCHEMA)


ROWS = [
    (1, P, "a"), (2, P, "a"), (3, P + " end", "b"), (4, None, "a"), (5, "", None), (6, "  \n\t ", "a"), (7, "Short TEXT", "b"),
    (8, "short text", "b"), (9, " ".join(WORDS[100:400] * 40), "c"), (10, "x " + P + " y", "c"), (10, "x " + P + " y", "c"), (None, P, None),
    (12, " ".join(["same"] * 50), "a"), (13, "É" + P, "b"), (14, " ".join(WORDS[20:58]) + " tail", "c"),
]


def test_exact_dedup(spark):
    want = defaultdict(list)
    for i, t, _ in ROWS:
        want[t or ""].append(i)
    got = exact_dedup(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        group = next(v for v in want.values() if r.doc_id in v)
        assert r.group_size == len(group) and r.keep_id == max((x for x in group if x is not None), default=None) and r.kept == (r.doc_id == r.keep_id)
    # one bucket for everything: chance collisions cost a hash, not a result
    assert sorted(map(str, exact_dedup(frame(spark, ROWS), bits=6, prefix_chars=1).collect())) == sorted(map(str, got))
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_hot_groups(spark):
    """Groups on both sides of the broadcast bound, one of them without any id."""
    rows = [(i, f"text {i % 7}" if i < 300 else f"own {i}", "s") for i in range(400)]
    rows += [(None, "nameless", "s")] * 50 + [(None, "few", "s")] * 3 + [(500 + i, "pair", "s") for i in range(2)]
    got = exact_dedup(frame(spark, rows)).collect()
    ids, size = defaultdict(list), Counter(t for _, t, _ in rows)
    for i, t, _ in rows:
        ids[t].append(i)
    keep = {t: max((x for x in v if x is not None), default=None) for t, v in ids.items()}
    want = Counter((i, keep[t], size[t], i == keep[t]) for i, t, _ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(str(rows[i][0]), len(sets[i]), str(least)) for i in g]
    return sorted(out)


def test_jaccard_edges_and_near_copies(spark):
    import random
    rnd = random.Random(5)
    rows = list(ROWS)
    base = [f"v{i}" for i in range(120)]
    for k in range(60):  # a family around the threshold, and chains of single edits
        t = list(base)
        for _ in range(rnd.randrange(0, 9)):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(10 ** 6)}"
        rows.append((100 + k, " ".join(t), "f"))
    t = [f"c{i}" for i in range(9)]
    for k in range(30):  # small sets: every size from 1 to 40 words with one edit at the end
        words = [f"s{k}x{i}" for i in range(1 + k)]
        rows += [(300 + 2 * k, " ".join(words), "g"), (301 + 2 * k, " ".join([*words, "more"]), "g")]
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_jaccard_empty_and_one_of_each(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    df = one_of_each(frame(spark, [r for r in ROWS if r[0] not in (10, None)]))
    ids = {r.doc_id for r in df.collect()}
    assert 1 in ids and not ids & {2, 3, 8} and {4, 5, 6, 7, 9, 12} <= ids and df.columns[0] == "doc_id"


def test_jaccard_null_and_reused_ids(spark):
    def text(name, *edits):
        w = [f"{name}{i}" for i in range(60)]
        for e in edits:
            w[e] = f"edit{e}"
        return " ".join(w)
    rows = [
        (1, text("a"), "s"), (None, text("a", 30), "s"), (None, text("a", 30), "s"),  # a copy without id
        (20, text("b"), "s"), (None, text("b", 59), "s"), (None, text("b", 59, 0), "s"), (21, text("b", 59, 0, 30), "s"),  # a chain through it
        (None, text("c"), "s"), (None, text("c", 9), "t"), (None, text("c", 9), "u"),  # no id at all
        (None, text("d"), "s"), (None, text("d"), "s"), (None, None, "s"), (None, None, "s"), (None, " ", "s"),
        (5, text("e"), "s"), (5, text("f"), "s"), (6, text("e", 30), "s"), (7, text("f", 30), "s"), (7, text("g"), "s"),  # reused ids
        (3, text("h"), "s"), (9, text("h", 30), "s"), (9, text("i"), "s"), (10, text("i", 30), "s"), (10, text("i", 30), "s"), (11, text("j"), "s"), (11, text("j", 3), "s"),
    ]
    for k in range(40):  # one id for many pairs
        rows += [(50, text(f"k{k}x"), "s"), (50 + k % 2, text(f"k{k}x", 59), "s")]
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)
    # one (id, text) of each component stays; without an id one row
    kept = Counter((r.doc_id, r.text) for r in one_of_each(frame(spark, rows)).collect())
    names = {"a": 1, "b": 20, "c": None, "d": None, "e": 5, "f": 5, "g": 7, "h": 3, "i": 9, "j": 11} | {f"k{k}x": 50 for k in range(40)}
    family = lambda t: re.match("[a-j]|k[0-9]+x", next(w for w in t.split() if not w.startswith("edit")))[0]
    assert all(kept[i, t] == n for i, t, n in ((None, None, 2), (None, " ", 1)))
    full = {(i, t): n for (i, t), n in kept.items() if (t or "").strip()}
    assert sorted((family(t), i) for i, t in full) == sorted(names.items()) and set(full.values()) == {1}


def brute_cut(rows, window=20):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    seen, out = set(), []
    for k in order:
        gone = set()
        for i in range(len(words[k]) - window + 1):
            key = tuple(words[k][i:i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words[k]) if i not in gone)
        out.append((str(rows[k][0]), len(words[k]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [{}, {"batch_bytes": 300, "group_items": 40}])
def test_substring_dedup(spark, size):
    rows = [r for r in ROWS if r[0] != 10] + [(10, "x " + P + " y", "c")]
    got = substring_dedup(frame(spark, rows), **size).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_cut(rows)
    assert all(sum(x.stop - x.start for x in r.spans) == r.n_removed for r in got)


def test_substring_dedup_empty(spark):
    assert substring_dedup(frame(spark, [])).count() == 0


def brute_lines(rows, ratio=3, prior=100):
    """(id, n_lines, n_dropped, text) per row, pages counted row by row."""
    pages, count = Counter(), Counter()
    trim = lambda x: x.strip(" \t\r")
    for _, t, s in rows:
        pages[s] += 1
        count.update((s, x) for x in set(map(trim, (t or "").split("\n"))) if x)
    out = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if 100 * count[s, trim(x)] <= ratio * (pages[s] + prior)]
        out.append((i, len(lines), len(lines) - len(kept), t if len(kept) == len(lines) else "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  menu \nown too {i}\n\n" + ("rare" if i < 2 else f"z{i}"), "h") for i in range(20)]
    rows += [(50 + i, "menu\nfoot", "small") for i in range(3)] + [(30, None, None), (31, "", "h"), (None, "menu\nno id", "h")]
    rows += [(60, "again\nmenu", "h")] * 4 + [(70 + i, f"nowhere\nline {i}\n\n \t", None) for i in range(9)] + [(80, "foot\r\n\xa0foot\n foot", "feet")] * 5
    rows += [(100 + i, ("tie\n" if i < 6 else "") + ("over\n" if i < 7 else "") + f"t {i}", "even") for i in range(100)]  # 6 of 100 + 100 is just 3 percent
    got = line_dedup(frame(spark, rows), stats=True)
    assert got.columns[:7] == frame(spark, []).columns
    order = lambda x: (str(x[0]), str(x[3]))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=order) == sorted(brute_lines(rows), key=order)
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].text == "own 0\nown too 0\n\nrare" and by[50].text == "menu\nfoot" and by[30].text is None and by[31].text == ""
    assert by[70].text == "line 0\n\n \t" and by[100].text == "tie\nt 0" and by[None].text == "no id" and by[60].text == ""
    assert line_dedup(frame(spark, [])).count() == 0


def test_lines_of_a_large_host(spark, tmp_path):
    import corpus_pipeline
    from snapdeck.llm.queries import QUERIES
    rows = []
    for i in range(1000):  # lines on 15, 8, 5, 4, 3 and 1 percent of the pages of a large host
        text = [f"own {i}"] + [f"  on {p} " for p in (15, 8, 5, 4, 3, 1) if i < 10 * p]
        rows.append((i, "\n".join(text), "large"))
    rows += [(2000 + i, f"own {i}\n" + ("some" if i < 4 else "menu"), "small") for i in range(50)]
    want = {i: t for i, _, _, t in brute_lines(rows)}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, frame(spark, rows), "").collect()} == want
    assert want[0] == "own 0\n  on 3 \n  on 1 " and want[2000] == "own 0\nsome" and want[2049] == "own 49"
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    query = {r.doc_id: (r.n_dropped, r.kept_sha256) for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert query == {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, _, n, t in brute_lines(rows)}


def brute_hits(t, items, n=10):
    norm = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w, hit, who = norm(t), set(), set()
    for item, text in items:
        v = norm(text)
        k = min(len(v), n)
        grams = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i:i + k]) in grams:
                hit.update(range(i, i + k))
                who.add(str(item))
    return len(w), len(hit), sorted(who)


@pytest.mark.parametrize("items", [
    [(1, " ".join(WORDS[5:30])), (2, " ".join(WORDS[10:25]) + " other"), (11, P.upper()), (7, None), (8, "")],
    [(1, " ".join(WORDS[5:30])), (3, "short, TEXT!"), (4, "w7"), (5, " ".join(WORDS[40:46]))],
    [],
])
def test_decontaminate(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*ROWS, (40, "-".join(WORDS[8:20]) + " Ünd w7", "d")]
    for most in (10 ** 6, 0):  # broadcast, and the shuffle beyond its bound
        got = decontaminate(frame(spark, rows), bench, max_broadcast=most).collect()
        assert len(got) == len(rows)
        want = Counter((str(i), *map(str, brute_hits(t, items))) for i, t, _ in rows)
        assert Counter((str(r.doc_id), str(r.n_words), str(r.n_hit), str(r.items)) for r in got) == want
        assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items) for r in got)
    clean = {r.doc_id for r in clean_documents(frame(spark, rows), bench).collect()}
    assert clean == {i for i, t, _ in rows if not brute_hits(t, items)[1]}


def test_signatures_are_sent_in_few_bytes(spark, monkeypatch):
    """A label's sets use the label's buckets only: a set's header is not repeated in the buckets of other labels."""
    from pyspark.sql import functions as F
    from snapdeck.llm import jaccard_join as jj
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(rnd.choice([30, 60, 150, 300]))) for _ in range(300)]
    sizes, write = [], jj.Scratch.write

    def noted(self, df, table, *a):
        out = write(self, df, table, *a)
        if table == "sent":
            sizes.append(out.agg(F.sum(F.length("payload"))).first()[0])
        return out

    monkeypatch.setattr(jj.Scratch, "write", noted)
    monkeypatch.setattr(jj, "BUCKET_ITEMS", 2000)
    got = jj.jaccard_components(spark.createDataFrame([*enumerate(texts), (300, texts[7] + " more")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 7 if i == 300 else i for i in range(301)}
    sent = sum(len(jj.signatures(s, label, 0)) for s in map(jj.shingles, texts) for label, _ in jj.labels_of(len(s)))
    assert sizes[0] < 6 * sent


def test_blocks_are_compared_in_bounded_memory():
    """Two whole blocks of sets whose sizes allow links: the pairs that the sketches leave, without a matrix of all pairs at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from snapdeck.llm import jaccard_join as jj
    rng = np.random.default_rng(2)
    sets = [rng.integers(1, 1 << 60, 150).astype(np.uint64) for _ in range(jj.BLOCK)]
    sets += [np.concatenate((s[:140], rng.integers(1, 1 << 60, 10).astype(np.uint64))) for s in sets]
    many = len(sets)
    label = jj.labels_of(150)[0][0]
    same = lambda v: pa.array([v] * many, pa.int64())
    t = pa.table({"sig": same(1), "node": pa.array(range(many)), "label": pa.array([label] * many, pa.int32()), "comp": pa.array(range(many)), "n": same(150),
                  "block": pa.array([i // jj.BLOCK for i in range(many)]), "bx": same(0), "by": same(1), "sketch": pa.array([jj.sketch(s, label) for s in sets], pa.binary())})
    tracemalloc.start()
    got = jj._cross(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(i, i + jj.BLOCK) for i in range(jj.BLOCK)} <= set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert peak < 12e6


def test_jaccard_links_found_late_join_whole_components(spark, monkeypatch):
    """A link of the second step moves all members of a component, not only the one that it names."""
    from snapdeck.llm import jaccard_join as jj

    def text(*edits):
        return " ".join(f"edit{i}" if i in edits else f"w{i}" for i in range(100))
    rows = [(1, text(20, 60), "s"), (2, text(40, 80), "s"), (3, text(), "s")]  # 3 is linked with 1 and 2, these are not linked
    late, calls, verify = jj.set_id(jj.shingles(rows[0][1])), [], jj._verify

    def first_misses_one(pairs, sets):
        calls.append(1)
        links = verify(pairs, sets)
        return links.filter(f"a != {late} AND b != {late}") if len(calls) == 1 else links

    monkeypatch.setattr(jj, "_verify", first_misses_one)
    got = jj.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1}
    assert len(calls) == 2


def test_texts_are_shipped_only_for_pairs_that_sketches_allow(spark, monkeypatch):
    """Texts that share half of their shingles meet in groups but are not compared; groups with the same members are looked at once."""
    from snapdeck.llm import jaccard_join as jj
    rnd = random.Random(3)
    base = [f"p{i}" for i in range(150)]
    texts = [" ".join(base + [f"o{rnd.randrange(10 ** 9)}" for _ in range(100)]) for _ in range(40)]
    rows, compared, opened, verify, write = list(enumerate(texts)), [], [], jj._verify, jj.Scratch.write
    rows.append((40, texts[7] + " more"))

    def noted(pairs, sets):
        compared.append(pairs.count())
        return verify(pairs, sets)

    def wrote(self, df, table, *a):
        out = write(self, df, table, *a)
        if table == "open":
            opened.extend(map(tuple, out.select("sig", "node", "label").collect()))
        return out

    monkeypatch.setattr(jj, "_verify", noted)
    monkeypatch.setattr(jj.Scratch, "write", wrote)
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 7 if i == 40 else i for i in range(41)}
    assert sum(compared) <= 3
    groups = defaultdict(set)
    for sig, node, label in opened:
        groups[sig, label].add(node)
    assert len({(label, frozenset(v)) for (_, label), v in groups.items()}) == len(groups)
