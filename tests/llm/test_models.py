"""Classifier, url rules, language model, packing and token counts against brute force or held-out rows."""

import itertools
import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest

from snapdeck.llm import jaccard_join as j
from snapdeck.llm.elias_fano import SUCC_BITS, EliasFano, Trie
from snapdeck.llm.lm_scoring import GRID, MU, Requests, _parse, lm_scores
from snapdeck.llm.packing import best_fit, pack
from snapdeck.llm.quality import NAMES, TEMPERATURE, Model, classify, features, fit_moments, keep_good
from snapdeck.llm.queries import QUERIES
from snapdeck.llm.token_counts import Automaton, read_vocabulary, token_counts
from snapdeck.llm.url_filter import url_filter

SF = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# --- quality -------------------------------------------------------------------------------

def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.95


def test_scores_are_gaussian_log_ratios():
    rng = np.random.default_rng(0)
    x = [rng.normal(k, 1 + k, (200, len(NAMES))) for k in (0, 1)]
    m = fit_moments(np.array([200.0, 200.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    t = rng.normal(0.5, 1.5, (20, len(NAMES)))
    z = (t - m.mean) / m.scale
    ratio = 0
    for sign, (mu, chol, _, prior) in zip((-1, 1), m.classes, strict=True):
        c = chol @ chol.T
        d = z - mu
        ratio = ratio + sign * (prior - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(m.score(t), 1 / (1 + np.exp(-ratio / TEMPERATURE)))


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (1, "again " * 5000, 0)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    from pyspark.sql import functions as F
    got = classify(docs, none, F.lit(True)).collect()
    assert len(got) == 4 and {r.score for r in got} == {1.0}
    assert keep_good(docs, none, F.lit(True)).count() == 4
    assert classify(docs.limit(0), none, F.lit(True)).count() == 0
    assert Model(np.zeros(0), np.ones(0), [], 0.0).score(np.zeros((2, 3))).tolist() == [0, 0]
    assert np.isfinite(features(None)).all() and (features(None) == features("")).all()


# --- urls ----------------------------------------------------------------------------------

def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://NET/", "https://a.example.NET/en/1?x#y", "https://example.net/en", "ftp://xnet/", "http://b.org/fr/",
            "http://example.com/de/?q", "http://example.com?/de/", "http://example.com#/de/", "x://y://net/", "http://É.net/a\nb", "http://q.org/de/" * 300]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] * 2, "page_id long, url string, html string, rule string")
    got = url_filter(pages).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path, best = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0] + best[1]) and r.verdict == (best[2] if best else r.verdict)
        assert r.verdict in ("allow", "block")
    assert url_filter(pages.limit(0)).count() == 0


def test_mined_rules_are_the_confident_token_sets(spark):
    rows = [f"http://s{i}.net/spam/{i}" for i in range(40)] + [f"http://s{i}.org/fr/good/{i}" for i in range(40)]
    rows += ["http://a.com/spam/7", "http://a.com/good/7", "http://a.com/else/7"]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), min_support=0.1).collect()}
    assert got[80].verdict == "block" and got[80].confidence == 1.0 and set(got[80].mined_rule.split()) <= {"p:spam", "p:0", "h:a", "h:com"}
    assert got[81].verdict == "allow" and "p:good" in got[81].mined_rule
    # the only token shared with labelled pages is the number, half of which are blocked
    assert got[82].mined_rule is None and got[82].verdict == "allow"


def brute_verdicts(urls, tokens, min_support, min_confidence=0.8):
    """(verdict, confidence, support) of the best rule of each undecided url: all class combinations of the labelled pages, counted directly."""
    labels = [(brute_rule(u)[2], frozenset(t)) for u, t in zip(urls, tokens, strict=True)]
    labelled = [(r[2], t) for r, t in labels if r]
    places = defaultdict(set)
    for _, t in labelled:
        for x in t:
            places[x].add(t)
    support = {x: sum(x in t for _, t in labelled) for x in places}
    cls = {x: min(y for y in places if places[y] == places[x]) for x in places if support[x] >= min_support * len(labelled)}
    rows = [(v, frozenset(cls[x] for x in t if x in cls)) for v, t in labelled]
    combos = {frozenset(c) for _, t in rows for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}
    rules = []
    for c in combos:
        hits = Counter(v for v, t in rows if c <= t)
        for v, n in hits.items():
            if n >= min_support * len(rows) and n / sum(hits.values()) >= min_confidence:
                rules.append((n / sum(hits.values()), n / len(rows), len(c), v, c))
    out = []
    for r, t in labels:
        has = {cls[x] for x in t if x in cls}
        best = max((x[:4] for x in rules if x[4] <= has), default=None)
        out.append(None if r else (best[3], best[0]) if best else ("allow", None))
    return out


@pytest.mark.parametrize("min_support", [0.02, 0.1])
def test_mined_half_by_brute_force(spark, min_support):
    from pyspark.sql import functions as F
    from snapdeck.llm.url_filter import parse_url, url_tokens
    rnd = random.Random(8)
    words = ["shop", "news", "win", "free", "blog", "a1"]
    urls = []
    for i in range(160):
        path = "/".join(rnd.sample(words, rnd.randint(0, 4)))
        host = rnd.choice(["x.net", "y.net", "example.net", "site.org", "a.com", "b.com", "example.com"])
        lead = {"site.org": "/fr/", "example.net": "/en/", "example.com": "/de/"}.get(host, "/") if rnd.random() < 0.7 else "/"
        urls.append(f"http://{host}{lead}{path}" + ("?q=1" if "win" in path and rnd.random() < 0.8 else "") + ("#f" if i % 9 == 0 else ""))
    urls += [None, "", *urls[:20]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = parse_url(F.col("url"))
    tokens = {r.page_id: r.t for r in pages.select("page_id", url_tokens(F.col("url"), host, path).alias("t")).collect()}
    want = brute_verdicts(urls, [tokens[i] for i in range(len(urls))], min_support)
    got = {r.page_id: r for r in url_filter(pages, min_support=min_support).collect()}
    assert sum(w is not None and w[1] is not None for w in want) > 20
    for i, w in enumerate(want):
        if w:
            assert (got[i].verdict, got[i].confidence) == (w[0], w[1] and pytest.approx(w[1]))


def test_no_class_of_a_long_url_is_cut(spark):
    """A page's rarest classes, beyond its ten most frequent ones, make the rule; and any bound of FP-growth gives the same rules."""
    from pyspark.sql import functions as F
    from snapdeck.llm.url_filter import parse_url, url_tokens
    rnd = random.Random(3)
    often = [f"w{c}" for c in "abcdefghijk"]
    urls = []
    for i in range(90):
        words = [w for w in often if rnd.random() < 0.85]
        rare = (["left", "right"], ["left"], ["right"], [])[i % 4]
        # with both rare words a page is always blocked, with one of them or none by chance
        host = "net" if len(rare) == 2 or rnd.random() < 0.3 else "org"
        urls.append(f"http://{host}/{'fr/' if host == 'org' else ''}{'/'.join(words + rare)}")
    urls += ["http://a.com/left/right", "http://a.com/left", "http://a.com/" + "/".join(often[:4]), "http://b.com/fr/left/right/wa", "http://c.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = parse_url(F.col("url"))
    tokens = {r.page_id: r.t for r in pages.select("page_id", url_tokens(F.col("url"), host, path).alias("t")).collect()}
    want = brute_verdicts(urls, [tokens[i] for i in range(len(urls))], 0.05)
    assert want[90] == ("block", 1.0)
    said = []
    for most in (10, 0):
        got = {r.page_id: r for r in url_filter(pages, min_support=0.05, max_items=most).collect()}
        assert [(got[i].verdict, got[i].confidence) for i in range(90, len(urls))] == [(w[0], w[1] and pytest.approx(w[1])) for w in want[90:]]
        said.append([got[i].mined_rule for i in range(len(urls))])
    assert said[0] == said[1] and said[0][90] == "p:left p:right"


def test_long_labelled_urls(spark):
    """A url of 200 tokens of its own, and one whose tokens all occur elsewhere too, among few labelled pages."""
    rows = [f"http://s{i}.net/word{i}" for i in range(30)] + ["http://t.net/" + "/".join(f"long{i}x" for i in range(200)) + "?" + "&".join(f"k{i}y=1" for i in range(200))]
    rows += ["http://u.net/" + "/".join(f"word{i}/s" for i in range(30)), "http://a.com/long7x", "http://b.com/word3", "http://c.de/"]
    got = {r.url: r for r in spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
           .join(url_filter(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")), "page_id").collect()}
    assert got["http://a.com/long7x"].verdict == "block" and got["http://a.com/long7x"].confidence == 1.0
    assert got["http://b.com/word3"].verdict == "block" and got["http://c.de/"].verdict == "allow"


# --- language model ------------------------------------------------------------------------

def test_elias_fano_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((0, 10), (1, 1), (50, 60), (1000, 1 << 20), (3000, 1 << 63)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        e = EliasFano.encode(v, top)
        assert (e.get(np.arange(n)) == v).all()
        ask = np.concatenate((v, rng.integers(0, top, 100, dtype=np.uint64)))
        at = e.find(ask)
        known = np.isin(ask, v)
        assert (known == (at >= 0)).all() and (v[at[known]] == ask[known]).all()


def test_trie_file(tmp_path):
    rng = np.random.default_rng(4)
    ctx = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    pairs = sorted({(int(rng.integers(len(ctx))), int(rng.integers(1 << 40)) >> int(rng.integers(30))) for _ in range(2000)})
    rank, succ = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.uint64)
    codes = rng.integers(1, 256, len(pairs)).astype(np.uint8)
    path = str(tmp_path / "t")
    Trie.build(ctx, rank, succ, codes).write(path)
    t = Trie.open(path)
    assert (t.lookup(ctx[rank], succ) == codes).all()
    have = set(pairs)
    miss = [(r, int(s) ^ 1) for r, s in pairs if (r, int(s) ^ 1) not in have]
    assert not t.lookup(ctx[[r for r, _ in miss]], np.array([s for _, s in miss], np.uint64)).any() and SUCC_BITS == 40


def brute_lm(rows):
    """One entry per row, in order: A-Z lower-cased, words between the six white-space characters, an end token."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c, ctx, big = Counter(), Counter(), Counter()
    for t, out in zip(toks, held, strict=True):
        if not out:
            prev = ["<s>", *t[:-1]]
            c.update(t)
            ctx.update(prev)
            big.update(zip(prev, t, strict=True))
    n, v = sum(c.values()), len(c)
    found = []
    for (i, _), t, out in zip(rows, toks, held, strict=True):
        base = [math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t]
        score = 0
        for prev, w, b in zip(["<s>", *t[:-1]], t, base, strict=True):
            k = ctx[prev] if prev != "<s>" else ctx["<s>"]
            a = big[prev, w] / (k + MU)
            if a:
                a = 10 ** (round(min(max((math.log10(a) + GRID) / GRID, 0), 1) * 254) / 254 * GRID - GRID)
            score += math.log10(a + MU / (k + MU) * 10 ** b)
        found.append((i, out, len(t), sum(c[w] > 0 for w in t), n, sum(base), score))
    return found


def same_scores(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 6), round(r[6], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    want = sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-9)


@pytest.mark.parametrize("size", [{}, {"batch_bytes": 2000}])
def test_lm_scores(spark, size):
    rnd = random.Random(1)
    words = [f"w{int(rnd.expovariate(0.1))}" for _ in range(4000)]
    rows = [(i, " ".join(words[40 * i:40 * i + 40])) for i in range(100)] + [(200, None), (201, ""), (202, "new words only"), (203, "w1 " * 3000)]
    rows += [(204, "W1 w2 W3\x0bw1\x0cEnd \u00c9t\u00c9 \u0130 K"), (205, "w1 end \u00e9t\u00e9 k"), (None, "W1 null id"), (None, "w1 w1"), (206, "Same Row"), (206, "Same Row"), (206, "other text")]
    got = lm_scores(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string"), **size).collect()
    same_scores(got, brute_lm(rows))


def lm_rows():
    rnd = random.Random(2)
    return [(i, " ".join(f"w{int(rnd.expovariate(0.1))}" for _ in range(rnd.randint(0, 80)))) for i in range(120)] + [(200, None), (201, ""), (202, "Lone"), (None, "W1 w2 end")]


def test_lm_scores_over_many_shards(spark, monkeypatch):
    """Shards of which a batch asks words without bigrams: its end token, and a frequent context's other shards."""
    monkeypatch.setattr("snapdeck.llm.lm_scoring.SHARD_ITEMS", 10)
    rows = lm_rows()
    same_scores(lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), batch_bytes=2000).collect(), brute_lm(rows))


def test_lm_payload_without_bigrams():
    q = Requests([1], [b"a b"])
    words, train, n, succ, pair_train = _parse(q.payload(np.array([2]), np.zeros(0, np.int64)))
    assert (words.tolist(), n.tolist(), len(succ), len(pair_train)) == ([int(q.words[2])], [0], 0, 0) and train.tolist() == [q.word_train[2]]


def test_lm_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert any(re.search("[A-Z]", t or "") for _, t in rows)
    same_scores(QUERIES["op6_lm_scoring"](spark, SF).collect(), brute_lm(rows))


def test_lm_base_columns_match_sql(spark):
    """n_tokens, n_known, train_tokens and base_score by DuckDB from the stated definition."""
    import duckdb
    con = duckdb.connect()
    train = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1)
    con.execute("CREATE TABLE train AS SELECT unnest(?::BIGINT[]) AS doc_id", [train])
    want = con.execute(rf"""
        WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x20\x09-\x0D]+') || ['<end of text>']) AS w FROM '{SF}/documents.parquet'),
        c AS (SELECT w, count(*) AS c FROM tok SEMI JOIN train USING (doc_id) GROUP BY w),
        n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, count(*), count(c), any_value(n)::BIGINT, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) FROM tok LEFT JOIN c USING (w), n GROUP BY doc_id""").fetchall()
    got = {r.doc_id: r for r in QUERIES["op6_lm_scoring"](spark, SF).collect()}
    assert len(got) == len(want)
    for i, tokens, known, total, base in want:
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, total) and got[i].base_score == pytest.approx(base, rel=1e-9)


def test_lm_beats_unigrams_on_held_out_rows(spark):
    rows = [r for r in QUERIES["op6_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_empty(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- packing -------------------------------------------------------------------------------

def naive_best_fit(items, capacity):
    bins, out = [], []
    for length, s, c in items:
        ok = [b for b in bins if b["room"] >= length and s not in b["s"] and c not in b["c"]]
        if ok:
            tight = min(b["room"] for b in ok)
            ok = [b for b in ok if b["room"] == tight]
        b = max(ok, key=lambda b: b["turn"]) if ok else {"room": capacity, "s": set(), "c": set(), "id": len(bins), "n": 0}
        if not ok:
            bins.append(b)
        out.append((b["id"], b["n"]))
        b["room"] -= length
        b["n"] += 1
        b["turn"] = len(out)
        b["s"] |= {s} - {None}
        b["c"] |= {c} - {None}
    return out


def test_best_fit_finds_the_tightest_compatible_bin():
    rnd = random.Random(2)
    for _ in range(60):
        items = sorted(((rnd.randint(1, 50), rnd.choice([None, 0, 0, 0, 1, 2, 3]), rnd.choice([None, 1, 2, *range(50)])) for _ in range(rnd.randint(0, 150))), key=lambda x: -x[0])
        assert best_fit(items, 50) == naive_best_fit(items, 50)


def test_pack(spark):
    rows = [(i, "w " * (i * 37 % 300), f"s{i % 3}" if i % 5 else None) for i in range(200)] + [(500, None, "s1"), (501, "x " * 1001, "s0"), (501, "x " * 1001, "s0")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=100, shard_items=64).collect()
    words = Counter()
    for r in got:
        words[r.doc_id] += r.n_words
        assert (r.bin_id is None) == (r.n_words == 0) and r.start == 100 * r.piece
    assert words == Counter({i: len((t or "").split()) * (2 if i == 501 else 1) for i, t, _ in rows})
    bins, source = defaultdict(list), {i: s for i, _, s in rows}
    for r in got:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for b in bins.values():
        named = [source[r.doc_id] for r in b if source[r.doc_id]]
        assert sum(r.n_words for r in b) <= 100 and len(named) == len(set(named)) and sorted(r.position for r in b) == list(range(len(b)))
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_repeated_rows_spread_and_pack_in_bounded_time(spark):
    """Rows without id and with one text: every piece conflicts with every other, so each takes a bin of its own."""
    import time
    t0 = time.perf_counter()
    assert best_fit([(3, 1, 2)] * 100_000, 50) == [(i, 0) for i in range(100_000)]
    assert time.perf_counter() - t0 < 20
    rows = spark.range(4000).selectExpr("cast(null as long) doc_id", "'same words here' text", "'s' source", "'clash' piece", "1 bin_id")
    got = pack(rows, capacity=50, shard_items=100).collect()
    assert len(got) == 4000 and len({r.bin_id for r in got}) == 4000
    per_shard = Counter(r.bin_id >> 32 for r in got)
    assert len(per_shard) == 40 and max(per_shard.values()) < 200


def test_pack_odd_ids_ties_and_extra_columns(spark):
    rows = [("", "a b", "x"), ("z", "a c", "x"), (None, "a d", "y"), (None, None, None), ("", "a b", "x"), ("k", "e f g h i", None), ("l", " ", "x")]
    got = pack(spark.createDataFrame([(*r, 1, "q", 2) for r in rows], "doc_id string, text string, source string, start int, position string, _id int"), capacity=4).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.n_words) for r in got) == Counter(
        [("", 0, 0, 2), ("", 0, 0, 2), ("z", 0, 0, 2), (None, 0, 0, 2), (None, 0, 0, 0), ("k", 0, 0, 4), ("k", 1, 4, 1), ("l", 0, 0, 0)])
    assert all((r.bin_id is None) == (r.n_words == 0) for r in got)


# --- token counts --------------------------------------------------------------------------

def greedy(pieces, longest, data):
    n = at = 0
    while at < len(data):
        at += next(k for k in range(min(longest, len(data) - at), 0, -1) if data[at:at + k] in pieces)
        n += 1
    return n


def test_automaton_counts_greedy_pieces():
    rnd = random.Random(6)
    for _ in range(30):
        pieces = [bytes([i]) for i in range(256)] + [bytes(rnd.choices(b"ab", k=rnd.randint(2, 9))) for _ in range(rnd.randint(0, 25))]
        a = Automaton(pieces)
        for _ in range(40):
            data = bytes(rnd.choices(b"abc", weights=(5, 5, 1), k=rnd.randint(0, 60)))
            assert a.count(data) == greedy(set(pieces), 9, data)
    with pytest.raises(ValueError):
        Automaton([b"a"])


def test_token_counts(spark):
    pieces = set(read_vocabulary(VOCABULARY))
    longest = max(map(len, pieces))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs).collect()}
    for r in docs.collect():
        words = r.text.encode().split()
        assert got[r.doc_id].n_words == len(words) and got[r.doc_id].n_tokens == sum(greedy(pieces, longest, b" " + w) for w in words)
    odd = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, " \n", 5), (4, "ab\x00é 漢字 " * 3, 5)], "doc_id long, text string, n_tokens int")
    assert sorted(r.n_words for r in token_counts(odd).collect()) == [0, 0, 0, 6] and token_counts(odd.limit(0)).count() == 0


def test_token_cache_is_bounded_in_bytes():
    from snapdeck.llm.token_counts import _CACHED_BYTES, _Words
    pieces = [bytes([i]) for i in range(256)] + [b"ab", b" a", b"abab"]
    known = _Words(Automaton(pieces))
    for word in (b"a", b"ab" * 32, b"ab" * 33, b"ab" * 50_000):
        assert known[word] == greedy(set(pieces), 4, b" " + word)
    assert max(map(len, known)) <= _CACHED_BYTES and len(known) == 2


def test_partenum_signatures():
    """Every linked pair of sets shares ``need`` signatures under the label of the larger set, seen from either side; signatures follow the enumeration."""
    rng, tried = np.random.default_rng(5), 0
    for n in [*range(5, 300, 7), 2000]:
        for level in (0, 1, 3):
            pool = rng.integers(0, 2**63, n + n // 4 + 1, dtype=np.uint64)
            a = np.unique(pool[:n])
            b = np.unique(np.concatenate((a[rng.integers(0, n // 10 + 1):], pool[n:n + rng.integers(0, n // 8 + 1)])))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            label = bisect_right(j.EDGES, max(len(a), len(b))) - 1
            partitions = j.partitions_of(label, level)
            sigs = [j.signatures(x, label, level) for x in (a, b)]
            shared = len(np.intersect1d(*sigs))
            for x, s in zip((a, b), sigs, strict=True):
                part = (j._part(x, label, j.SPLIT * partitions)).tolist()
                held = {p: {q for q in part if q // j.SPLIT == p} for p in {q // j.SPLIT for q in part}}
                assert len(s) == len(np.unique(s)) == sum(any(q % j.SPLIT != out for q in parts) for parts in held.values() for out in range(j.SPLIT))
                assert shared >= len(s) - j.lost(dict(j.labels_of(len(x)))[label], partitions) >= 1
            tried += 1
    assert tried > 100
