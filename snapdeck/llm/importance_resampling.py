"""Operator 12, target-distribution importance resampling.

Features are the runs of 1 to ``max_n`` words of a text, hashed into ``buckets`` buckets. The documents
and the target texts give two bucket histograms; their smoothed log ratio is a bucket's gain, and a
document's weight is the floored mean gain of its features. With Gumbel noise from the id's hash the
highest scores are a sample without replacement from the weights.

The weights come from arrays: a task turns the words of a batch into one array of buckets and looks
the gains up there. The ranks come from a distributed LSD radix sort on the composite key (score descending, id
ascending): for each digit, from the lowest, a stable counting sort counts the digit in blocks of
consecutive positions, global prefix sums over (digit, block) give each block's first destination for the
digit, and a row's new position is that destination plus its place among the equal digits of its block.

Scale: histograms are summed in the task and then by bucket, so at most ``buckets`` rows reach the driver. A sorting pass
shuffles rows of a few numbers once, by (block, digit): such a group has at most BLOCK rows, whatever
digit is frequent. Only digits in which the keys differ are sorted. Texts are read twice and never shuffled.

Defined cases: null text has no words; no features give weight 0; documents with fewer than ``min_words``
words are never drawn; a null id hashes as the empty text and comes last among ties; rows repeated with one id
count each time and tie in any order; with no target text every t is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import string
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, arrow_rows, text_of

BUCKETS = 10_000
MAX_N = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
DIGIT_BITS = 8
BLOCK = 4096
_PIECE = 1 << 20
#: words are digits, letters and bytes from 0x80 on, A-Z lower-cased; every other byte separates
_TABLE = bytes(b if b >= 0x80 or chr(b) in string.ascii_lowercase + string.digits else ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else 0x20
               for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    data = text.translate(_TABLE)
    at = 0
    while at < len(data):
        end = len(data) if at + _PIECE >= len(data) else data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def feature_buckets(text: bytes, max_n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them), piece by piece."""
    before: list[int] = []  # crc32 of the runs of 1, 2, ... words that end at the last word of the piece before
    for words in pieces(text):
        if not words:
            continue
        runs, found = list(map(zlib.crc32, words)), []
        found.append(runs)
        ends = [runs[-1]]
        for n in range(1, max_n):
            # a run of n + 1 words is the run of n words before, a space and the word
            prior = ([before[n - 1]] if len(before) >= n else []) + runs[:-1]
            runs = list(map(zlib.crc32, words[len(words) - len(prior):], map(zlib.crc32, repeat(b" "), prior)))
            if not runs:
                break
            found.append(runs)
            ends.append(runs[-1])
        before = ends
        yield len(words), np.concatenate([np.array(r, np.int64) for r in found]) % buckets


def _histogram(max_n: int, buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in parts:
            for t in b.column(0).to_pylist():
                for _, x in feature_buckets(t.encode(), max_n, buckets):
                    total += np.bincount(x, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts by bucket; one row per bucket comes to the driver."""
    rows = (docs.select(text_of(text_col).alias("_text")).mapInArrow(_histogram(max_n, buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(counts: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of every bucket."""
    b, s, t = len(counts), sum(counts), sum(target)
    return np.array([math.floor(1000 * math.log(float((y + 1) * (s + b)) / float((x + 1) * (t + b)))) for x, y in zip(counts, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, max_n: int, seed: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids = b.column(0).to_pylist()
            out = np.zeros((3, len(ids)), np.int64)
            for i, t in enumerate(b.column(1).to_pylist()):
                words = n = total = 0
                for w, x in feature_buckets(t.encode(), max_n, len(gain)):
                    words, n, total = words + w, n + len(x), total + int(gain[x].sum())
                out[:, i] = words, n, total // n if n else 0
            score = out[2] + np.array([noise(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out[0]), pa.array(out[1]), pa.array(out[2]), pa.array(score)],
                                             names=["id", "n_words", "n_features", "weight", "score"])
    return run


def _digits(df: DataFrame, keys: list[str]) -> list[Column]:
    """The digits in which non-negative-ordered keys differ, the lowest first; keys are listed from the lowest."""
    low = df.agg(*[F.min(k).alias(f"a{i}") for i, k in enumerate(keys)], *[F.max(k).alias(f"b{i}") for i, k in enumerate(keys)]).first()
    out = []
    for i, k in enumerate(keys):
        if low[f"a{i}"] is None:
            continue
        # as unsigned numbers in the same order: the bits above the highest differing one are common to all rows
        a, b = (int(low[f"{x}{i}"]) + (1 << 63) for x in "ab")
        flipped = F.col(k).bitwiseXOR(F.lit(-(1 << 63)))
        out += [F.shiftrightunsigned(flipped, at).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int") for at in range(0, (a ^ b).bit_length(), DIGIT_BITS)]
    return out


def radix_rank(df: DataFrame, keys: list[str], s: Scratch, block: int = BLOCK) -> DataFrame:
    """``df`` with ``_rank`` (1, 2, ...) by long keys, given from the least significant to the most. ``df`` has a column
    ``_pos``: distinct non-negative starting positions, gaps allowed, which break the ties that remain. Tables of
    finished passes are dropped."""
    spark = df.sparkSession
    cols = [c for c in df.columns if c != "_pos"]
    now, last = df, None
    # without differing digits one pass over a constant digit still closes the gaps between the positions
    for i, digit in enumerate(_digits(df, keys) or [F.lit(0)]):
        dealt = now.select("*", F.expr(f"_pos div {block}").alias("_block"), digit.alias("_digit"))
        counts = s.write(dealt.groupBy("_digit", "_block").agg(F.count("*").alias("_n")), f"counts-{i}")
        # one row per digit value: 2**DIGIT_BITS at most
        totals = sorted((r._digit, r.n) for r in counts.groupBy("_digit").agg(F.sum("_n").alias("n")).collect())
        starts = np.cumsum([0] + [n for _, n in totals]).tolist()
        first = spark.createDataFrame([(d, at) for (d, _), at in zip(totals, starts, strict=False)], "_digit int, _first long")
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.withColumn("_before", before).join(F.broadcast(first), "_digit").select("_digit", "_block", (F.col("_first") + F.col("_before")).alias("_at"))
        place = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_pos")) - 1
        moved = dealt.withColumn("_place", place).join(offsets, ["_block", "_digit"]).select(*cols, (F.col("_at") + F.col("_place")).alias("_pos"))
        now = s.write(moved, f"pass-{i}")
        s.drop(f"counts-{i}")
        if last:
            s.drop(last)
        last = f"pass-{i}"
    return now.select(*cols, (F.col("_pos") + 1).alias("_rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", max_n: int = MAX_N,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per document: id, n_words, n_features, weight, score, rank (null where not drawn)."""
    spark = docs.sparkSession
    s = Scratch(spark, "importance-resampling")
    src = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    with arrow_rows(spark, 500):
        gain = gains(bucket_counts(src, "_text", max_n, buckets), bucket_counts(target, target_text_col, max_n, buckets))
        weighed = src.mapInArrow(_weigh(gain, max_n, seed), "id long, n_words long, n_features long, weight long, score long")
        scored = s.write(weighed.withColumn("_pos", F.monotonically_increasing_id()), "scored")
    # descending score: the complement turns the order round without overflow; a null id is the highest digit of the id
    keyed = scored.filter(F.col("n_words") >= min_words).select(F.col("_pos").alias("_row"), F.coalesce("id", F.lit(0)).alias("_low"),
                                                                F.col("id").isNull().cast("long").alias("_null"), F.bitwise_not("score").alias("_high"), "_pos")
    n = keyed.count()
    ranked = radix_rank(keyed, ["_low", "_null", "_high"], s).filter(F.col("_rank") <= percent * n // 100).select("_row", F.col("_rank").alias("rank"))
    out = scored.join(ranked, F.col("_pos") == F.col("_row"), "left")
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
