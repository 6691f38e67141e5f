"""Helpers shared by the corpus operators: scratch tables in the shared folder,
native text normalisation, and numpy word hashing for the Arrow tasks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdeck.session import app_id, checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: white space that separates words: space, tab, LF, VT, FF, CR
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables of one operator call in the shared folder named by ``spark.checkpoint.dir``.

    Writing a table cuts lineage in a way that survives lost executors. A table
    is dropped as soon as nothing reads it any more; what a lazy result still
    reads stays until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/snapdeck-llm/{app_id(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.base}/{table}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int, most_bytes: int | None = None) -> Iterator[None]:
    """Rows per Arrow batch while an eager write runs, so that rows with whole
    texts or packed arrays keep Python's memory bounded; with ``most_bytes`` a batch also ends with the row that reaches them."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    if most_bytes:
        new["spark.sql.execution.arrow.maxBytesPerBatch"] = str(most_bytes)
    old = {key: spark.conf.get(key) for key in new}
    for key, value in new.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def text_of(col: str = "text") -> Column:
    """The text with null counted as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


# --- numpy: exact words and their 64-bit hashes ------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[_SPACE] = 0
_B = 0x9E3779B97F4A7C15 | 5
_PIECE = 1 << 18
_POW = np.ones(0, _U)
_INV = np.ones(0, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 1 << 14)
        one = np.ones(size, _U)
        one[1:] = _U(_B)
        inv = np.ones(size, _U)
        inv[1:] = _U(pow(_B, -1, 1 << 64))
        _POW, _INV = np.multiply.accumulate(one), np.multiply.accumulate(inv)
    return _POW, _INV


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each white-space separated word of UTF-8 bytes, in order.

    A word's hash depends on its bytes only. Long texts are cut at white space
    into pieces, so the tables of powers stay small.
    """
    if len(data) > 2 * _PIECE:
        parts, at = [], 0
        while at < len(data):
            end = min(at + _PIECE, len(data))
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            parts.append(_hash_piece(data[at:end]))
            at = end
        return np.concatenate(parts)
    return _hash_piece(data)


def _hash_piece(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    word = ~_SPACE[a]
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1]))) if len(a) else np.zeros(0, int)
    if not len(starts):
        return np.zeros(0, _U)
    p, inv = _powers(len(a))
    return mix(np.add.reduceat(_BYTE[a] * p[:len(a)], starts) * inv[starts])


def ngram_hashes(h: np.ndarray, k: int, short: bool = False) -> np.ndarray:
    """Hash of each run of k words; with ``short``, fewer words make one run."""
    n = len(h)
    if n < k:
        if not short or not n:
            return np.zeros(0, _U)
        k = n
    acc = np.full(n - k + 1, k, _U)
    for j in range(k):
        acc = mix(acc * _U(0xD6E8FEB86659FD93) + h[j:n - k + 1 + j])
    return acc


def partition_id() -> int:
    from pyspark import TaskContext
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def blocks(items: Iterable, weight, most: int) -> Iterator[list]:
    """Consecutive items in lists of about ``most`` weight; one item may exceed it."""
    out, total = [], 0
    for x in items:
        w = weight(x)
        if out and total + w > most:
            yield out
            out, total = [], 0
        out.append(x)
        total += w
    if out:
        yield out


_P = 0xA0761D6478BD642F | 5


def _window_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.full(max(n, 1), _U(_P))
    inv = np.full(max(n, 1), _U(pow(_P, -1, 1 << 64)))
    one[0] = inv[0] = 1
    return np.multiply.accumulate(one), np.multiply.accumulate(inv)


def rolling_hashes(h: np.ndarray, *ks: int) -> list[np.ndarray]:
    """For each k the hash of every run of k words, by one running sum for all of them."""
    n = len(h)
    p, inv = _window_powers(n)
    run = np.concatenate((np.zeros(1, _U), np.cumsum(h * p[:n], dtype=_U)))
    return [mix((run[k:] - run[:n - k + 1]) * inv[:n - k + 1] + _U(k)) if n >= k else np.zeros(0, _U) for k in ks]


def pack_texts(texts: list[bytes]) -> tuple[list[int], bytes]:
    """Lengths and one compressed block, so that stored and shuffled texts stay small."""
    import pyarrow as pa
    return [len(t) for t in texts], pa.Codec("zstd").compress(b"".join(texts), asbytes=True)


def unpack_texts(lengths: list[int], block: bytes) -> list[bytes]:
    import pyarrow as pa
    data = pa.Codec("zstd").decompress(block, sum(lengths), asbytes=True)
    ends = np.cumsum([0, *lengths]).tolist()
    return [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]


def write_batches(docs: DataFrame, s: Scratch, table: str, id_col: str, text_col: str, most_bytes: int = 1 << 22, lower: bool = False) -> DataFrame:
    """(batch, ids, lengths, texts): the documents in rows of about ``most_bytes`` of text, written
    once so that later steps can address them by batch and place; ``unpack_texts`` gives the UTF-8 texts. Null texts
    are empty; with ``lower`` A-Z are lower-cased."""
    import pyarrow as pa
    src = docs.select(F.col(id_col).cast("long").alias("_id"), (ascii_lower(text_of(text_col)) if lower else text_of(text_col)).alias("_text"))

    def run(parts):
        part, k = partition_id(), 0
        rows = ((i, t.encode()) for b in parts for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for block in blocks(rows, lambda r: len(r[1]) + 32, most_bytes):
            lengths, data = pack_texts([t for _, t in block])
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([[i for i, _ in block]], pa.list_(pa.int64())),
                                              pa.array([lengths], pa.list_(pa.int32())), pa.array([data], pa.binary())], names=["batch", "ids", "lengths", "texts"])
            k += 1

    with arrow_rows(docs.sparkSession, 500):
        return s.write(src.mapInArrow(run, "batch long, ids array<long>, lengths array<int>, texts binary"), table)


def split_by(target: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(value, indexes holding it) for values 0..n-1 that occur, each in order."""
    order = np.argsort(target, kind="stable")
    ends = np.cumsum(np.bincount(target, minlength=n))
    start = 0
    for value in np.flatnonzero(np.diff(np.concatenate(([0], ends)))):
        yield int(value), order[start:ends[value]]
        start = ends[value]


def maybe_among(df: DataFrame, col: str, keys: DataFrame, key: str, flag: str, n_keys: int) -> DataFrame:
    """``df`` with a boolean ``flag``: false where ``col`` is surely none of the ``n_keys`` ``keys``. A hashed bitmap of 32 to 64 bits a
    key, 2**27 bits at most (2**21 rows of 16 bytes broadcast), so few others are flagged by chance up to some ten million keys; an exact step follows."""
    bits = min(27, max(10, (32 * max(n_keys, 1)).bit_length()))
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    bitmap = (keys.select(spread(F.col(key)).alias("_b")).select(F.expr("_b div 64").alias("_word"), F.expr("shiftleft(1L, cast(_b % 64 as int))").alias("_bit"))
              .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return (df.withColumn("_b", spread(F.col(col))).withColumn("_word", F.expr("_b div 64")).join(F.broadcast(bitmap), "_word", "left")
            .withColumn(flag, F.coalesce(F.expr("getbit(_bits, cast(_b % 64 as int)) = 1"), F.lit(False))).drop("_b", "_word", "_bits"))


def components(nodes: DataFrame, edges: DataFrame, s: Scratch, name: str) -> DataFrame:
    """(node, label): the least starting label that reaches each node, from nodes (node, label) and edges (a, b).

    Labels spread along edges and then jump to their label's label, so the rounds
    grow with the logarithm of the longest path. Every round is written to the
    shared folder; only whether something changed comes to the driver.
    """
    both = s.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    # nodes without edges keep their label and take no part in the rounds
    touched = both.select(F.col("a").alias("node")).distinct()
    now = s.write(nodes.join(touched, "node").select("node", "label", F.col("node").alias("root")), f"{name}-0")
    k = 0
    while True:
        pair = F.struct("label", "root")
        near = (both.join(now.select(F.col("node").alias("b"), pair.alias("v")), "b").groupBy("a").agg(F.min("v").alias("v"))
                .withColumnRenamed("a", "node"))
        low = now.join(near, "node").select("node", F.least(pair, "v").alias("v"), F.col("label").alias("old"))
        low = s.write(low, f"{name}-low-{k}")
        jump = low.select(F.col("node").alias("_r"), F.col("v").alias("w"))
        new = (low.join(jump, F.col("v.root") == F.col("_r")).select("node", F.least("v", "w").alias("v"), "old")
               .select("node", F.col("v.label").alias("label"), F.col("v.root").alias("root"), "old"))
        new = s.write(new, f"{name}-{k + 1}")
        s.drop(f"{name}-{k}")
        s.drop(f"{name}-low-{k}")
        moved = new.filter("label < old").limit(1).count()
        now, k = new.drop("old"), k + 1
        if not moved:
            break
    out = nodes.join(now.select("node", F.col("label").alias("_new")), "node", "left")
    out = s.write(out.select("node", F.coalesce("_new", "label").alias("label")), f"{name}-labels")
    s.drop(f"{name}-edges")
    s.drop(f"{name}-{k}")
    return out
