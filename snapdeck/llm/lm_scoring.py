"""Operator 6, LM scoring: Elias-Fano n-gram trie (bigrams over unigrams).

Training and scoring share one shuffle. Each batch of documents sends, for every
distinct context word, its training count and the words that follow it (with
their training counts) to a shard chosen by the context. A shard sums the
counts, builds its two-level trie from what the training documents hold, writes
it to a file, maps it into memory and answers every batch in the order of its
requests: exact counts of the words and quantised probabilities of the bigrams.
The batch then scores its whole texts:

    p(w | v) = a(v, w) + g(v) * p1(w),  a = c(v, w) / (c(v) + MU),  g = MU / (c(v) + MU)
    p1(w)    = (c(w) + 0.5) / (N + 0.5 * (V + 1))

a is an 8-bit code on a logarithmic grid, c and g are exact. A-Z are lower-cased; a text starts
after a begin mark and finishes with an end token.

Scale: shards follow the input, so what a shard holds stays the same. A context with more
than one shard's share of all tokens (so fewer of them than shards) is split by the following word
over as many shards as it holds shares, and these shards are dealt in turn; the list of such contexts
affects routing only. Each batch sends a bigram once however often it occurs. No vocabulary or
model passes the driver.

Words are known by 64-bit hashes of their bytes, following words within a
context by 40 bits.

Defined cases: null and empty texts hold the end token only; a null id belongs
to the training rows (crc32 of an empty text); without training rows N and V are 0 and
every token has the same base probability 1; repeated rows count each time; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, arrow_rows, mix, split_by, unpack_texts, word_hashes, write_batches
from snapdeck.llm.elias_fano import SUCC_BITS, Trie

BATCH_BYTES = 4 << 20
SHARD_ITEMS = 600_000
MU = 8.0
LOOKUP = 1 << 18  # bigrams looked up at once
GRID = 8.0  # codes 1..255 cover log10 a from -GRID to 0
_U = np.uint64
BEGIN, END = mix(np.array([0xB0, 0xE0], _U))
_SUCC = _U((1 << SUCC_BITS) - 1)


def held_out(doc_id: int | None, n: int = 5, r: int = 1) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n == r


def quantise(a: np.ndarray) -> np.ndarray:
    return (1 + np.rint(np.clip((np.log10(a) + GRID) / GRID, 0, 1) * 254)).astype(np.uint8)


def dequantise(code: np.ndarray) -> np.ndarray:
    """The probability of a code; 0 stands for none."""
    table = np.concatenate(([0.0], 10.0 ** (np.arange(255) / 254 * GRID - GRID)))
    return table[code]


class Hot(NamedTuple):
    """The contexts that are split, by rising hash: the first of each one's shards and how many there are; they lie side by side, past the last one from 0 again."""

    words: np.ndarray
    first: np.ndarray
    fan: np.ndarray


class Requests:
    """What one batch asks: its distinct words and bigrams with their training counts."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        seqs, train = [], []
        for i, t in zip(ids, texts, strict=True):
            h = word_hashes(t)
            seqs.append(np.concatenate(([BEGIN], h, [END])).astype(_U))
            train.append(not held_out(i))
        self.lengths = np.array([len(x) for x in seqs])
        self.words, token = np.unique(np.concatenate(seqs), return_inverse=True)
        del seqs
        learn = np.repeat(np.array(train), self.lengths)
        self.word_train = np.bincount(token[learn], minlength=len(self.words))
        ends = np.cumsum(self.lengths)
        inner = np.ones(len(token), bool)
        inner[ends - 1] = False  # the end token is no context
        first = np.flatnonzero(inner)
        self.pair_doc = np.repeat(np.arange(len(self.lengths)), self.lengths - 1)
        keys, self.pair = np.unique((token[first] << 32) | token[first + 1], return_inverse=True)
        self.context, self.follower = keys >> 32, keys & 0xFFFFFFFF
        self.pair_train = np.bincount(self.pair[learn[first]], minlength=len(keys))

    def deal(self, shards: int, hot: Hot) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, word indexes, bigram indexes): a hot context goes to all its shards, its bigrams by the following word."""
        first, fan = (self.words % _U(shards)).astype(np.int64), np.ones(len(self.words), np.int64)
        at = np.searchsorted(self.words, hot.words)
        here = np.flatnonzero(self.words[np.minimum(at, len(self.words) - 1)] == hot.words)
        at = at[here]
        first[at], fan[at] = hot.first[here], hot.fan[here]
        word = np.concatenate((np.arange(len(self.words)), np.repeat(at, fan[at] - 1)))
        to = np.concatenate((first, *((first[i] + np.arange(1, fan[i])) % shards for i in at)))
        branch = (self.words[self.follower] >> _U(7)) % fan[self.context].astype(_U)
        bigrams = dict(split_by((first[self.context] + branch.astype(np.int64)) % shards, shards))
        for shard, i in split_by(to, shards):
            yield shard, np.sort(word[i]), bigrams.get(shard, np.zeros(0, np.int64))

    def payload(self, words: np.ndarray, pairs: np.ndarray) -> bytes:
        n = np.searchsorted(self.context[pairs], words, side="right") - np.searchsorted(self.context[pairs], words, side="left")
        succ = (self.words[self.follower[pairs]] & _SUCC).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SUCC_BITS // 8]
        return b"".join((np.array([len(words), len(pairs)], "<u4").tobytes(), self.words[words].astype("<u8").tobytes(),
                         self.word_train[words].astype("<u4").tobytes(), n.astype("<u4").tobytes(),
                         np.ascontiguousarray(succ).tobytes(), self.pair_train[pairs].astype("<u4").tobytes()))


def _parse(data: bytes) -> tuple[np.ndarray, ...]:
    w, p = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at = 8
    words = np.frombuffer(data, "<u8", w, at)
    at += 8 * w
    train = np.frombuffer(data, "<u4", w, at)
    at += 4 * w
    n = np.frombuffer(data, "<u4", w, at)
    at += 4 * w
    raw = np.zeros((p, 8), np.uint8)
    raw[:, :SUCC_BITS // 8] = np.frombuffer(data, np.uint8, p * (SUCC_BITS // 8), at).reshape(p, SUCC_BITS // 8)  # p may be 0
    at += p * (SUCC_BITS // 8)
    return words, train, n, raw.view("<u8").ravel(), np.frombuffer(data, "<u4", p, at)


def _ask(shards: int, hot: Hot):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                q = Requests(r["ids"], unpack_texts(r["lengths"], r["texts"]))
                out = [(shard, q.payload(w, p)) for shard, w, p in q.deal(shards, hot)]
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                                                  pa.array([x[1] for x in out], pa.binary())], names=["batch", "shard", "payload"])
    return run


def _answer(hot: Hot, mu: float):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        batches = t.column("batch").to_pylist()
        asked = [_parse(x) for x in t.column("payload").to_pylist()]
        words = np.concatenate([a[0] for a in asked])
        contexts, rank = np.unique(words, return_inverse=True)
        count = np.bincount(rank, np.concatenate([a[1] for a in asked]), len(contexts)).astype(np.int64)
        pair_rank = np.repeat(rank, np.concatenate([a[2] for a in asked]))
        succ = np.concatenate([a[3] for a in asked])
        train = np.concatenate([a[4] for a in asked])
        seen = np.flatnonzero(train)
        keys, which = np.unique((pair_rank[seen].astype(_U) << _U(SUCC_BITS)) | succ[seen], return_inverse=True)
        c = np.bincount(which, train[seen], len(keys))
        node = (keys >> _U(SUCC_BITS)).astype(np.int64)
        trie = Trie.build(contexts, node, keys & _SUCC, quantise(c / (count[node] + mu)) if len(keys) else np.zeros(0, np.uint8))
        fd, path = tempfile.mkstemp(suffix=".trie")
        os.close(fd)
        try:
            trie.write(path)
            trie = Trie.open(path)
            code = np.zeros(len(succ), np.uint8)
            for k in range(0, len(succ), LOOKUP):
                code[k:k + LOOKUP] = trie.lookup(contexts[pair_rank[k:k + LOOKUP]], succ[k:k + LOOKUP])
        finally:
            os.unlink(path)
        # a hot context is in several shards; the first of them counts it
        here = (contexts != BEGIN) & ~np.isin(contexts, hot.words[hot.first != shard])
        total, distinct = int(count[here].sum()), int((count[here] > 0).sum())
        out, w, p = [], 0, 0
        for a in asked:
            out.append(count[rank[w:w + len(a[0])]].astype("<u8").tobytes() + code[p:p + len(a[3])].tobytes())
            w, p = w + len(a[0]), p + len(a[3])
        n = len(out)
        return pa.table({"batch": pa.array(batches, pa.int64()), "shard": pa.array([shard] * n, pa.int64()), "payload": pa.array(out, pa.binary()),
                         "tokens": pa.array([total] + [0] * (n - 1), pa.int64()), "types": pa.array([distinct] + [0] * (n - 1), pa.int64())})
    return run


def _score(shards: int, hot: Hot, mu: float, total: int, distinct: int):
    base = np.log10(total + 0.5 * (distinct + 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                q = Requests(r["ids"], unpack_texts(r["lengths"], r["texts"]))
                given = {x["shard"]: x["payload"] for x in r["answers"]}
                count, code = np.zeros(len(q.words), np.int64), np.zeros(len(q.context), np.uint8)
                for shard, w, p in q.deal(shards, hot):
                    data = given[shard]
                    count[w] = np.frombuffer(data, "<u8", len(w))
                    code[p] = np.frombuffer(data, np.uint8, len(p), 8 * len(w))
                log_p1 = np.log10(count + 0.5) - base
                c = count[q.context]
                p = dequantise(code) + mu / (c + mu) * 10.0 ** log_p1[q.follower]
                score = np.bincount(q.pair_doc, np.log10(p)[q.pair], len(q.ids))
                target = q.follower[q.pair]
                n_known = np.bincount(q.pair_doc, count[target] > 0, len(q.ids)).astype(np.int64)
                plain = np.bincount(q.pair_doc, log_p1[target], len(q.ids))
                yield pa.RecordBatch.from_arrays([
                    pa.array(q.ids, pa.int64()), pa.array([held_out(i) for i in q.ids]), pa.array(q.lengths - 1, pa.int64()), pa.array(n_known),
                    pa.array([total] * len(q.ids), pa.int64()), pa.array(plain), pa.array(score)],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def _frequent(share: float):
    """Per batch its words of at least half that share, and with word null the number of its tokens."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                texts = unpack_texts(r["lengths"], r["texts"])
                h, n = np.unique(np.concatenate([np.full(len(texts), BEGIN), *(word_hashes(t) for t in texts)]), return_counts=True)
                big = np.flatnonzero(n >= share / 2 * n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([None, *h[big].astype(np.int64).tolist()], pa.int64()),
                                                  pa.array([int(n.sum()), *n[big].tolist()], pa.int64())], names=["word", "n"])
    return run


def hot_contexts(batches: DataFrame, shards: int) -> Hot:
    """The contexts found to hold more than 1 / ``shards`` of all tokens and their shards. A batch counts 2 * ``shards`` words at
    most, and what batches leave out of a context is below half such a share."""
    seen = batches.select("lengths", "texts").mapInArrow(_frequent(1 / shards), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = seen.orderBy(F.col("n").desc(), "word").limit(shards + 1).collect()  # that many can hold so much, and the row of all tokens
    everything = max((r.n for r in rows), default=0)
    return deal_shards([(r.word % (1 << 64), -(-r.n * shards // everything)) for r in rows if r.word is not None and r.n * shards > everything], shards)


def deal_shards(fans: list[tuple[int, int]], shards: int) -> Hot:
    """Shards for (context, number of shards), taken in turn so that none gets many more of them than another."""
    words, fan = np.array([h for h, _ in fans], _U), np.minimum(np.array([k for _, k in fans], np.int64), shards)
    order = np.argsort(words)
    return Hot(words[order], ((np.cumsum(fan) - fan) % shards)[order], fan[order])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, mu: float = MU) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    s = Scratch(spark, "lm-scoring")
    batches = write_batches(docs, s, "batches", id_col, text_col, batch_bytes, lower=True)
    shards = max(1, -(-batches.count() * (batch_bytes // 8) // SHARD_ITEMS))
    # the rows of shards are many and small, those of batches some MB and scored one by one
    with arrow_rows(spark, 200, BATCH_BYTES):
        hot = hot_contexts(batches, shards)
        answers = (batches.mapInArrow(_ask(shards, hot), "batch long, shard long, payload binary")
                   .groupBy("shard").applyInArrow(_answer(hot, mu), "batch long, shard long, payload binary, tokens long, types long"))
        answers = s.write(answers, "answers", compression="zstd")
        total, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    with arrow_rows(spark, 1):
        by_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "payload")).alias("answers"))
        out = s.write(batches.join(by_batch, "batch").select("ids", "lengths", "texts", "answers")
                      .mapInArrow(_score(shards, hot, mu, total, distinct),
                                  "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    s.drop("answers")
    s.drop("batches")
    return out.withColumnRenamed("id", id_col)
