"""Operator 1, exact dedup [native]: progressive refinement.

Candidates are refined by text length, then by the hash of a text prefix; only
rows of surviving groups have their full content hashed. Each step hands the
next one a *bucket bitmap*: groups are hashed into ``2**bits`` buckets and the
buckets holding at least two rows are kept as 64-bit words. ``bits`` follows the number of rows (16 to 32 buckets a row) up to
``MAX_BITS``, so the broadcast has 2**21 rows of 16 bytes at most; beyond some ten million rows chance makes a growing share of
buckets look shared. A bucket shared by chance costs one needless full hash, nothing else: groups
themselves are formed on (length, SHA-256). Texts are never shuffled.

Rows learn their group's survivor by a join. Groups of more than ``n >> HOT_SHIFT`` rows, 2**HOT_SHIFT at most, are broadcast, so
the rows of a hot group stay where they are; the others are joined by a shuffle of ids and digests in which no group is large.

Defined cases: null text counts as empty, and all empty texts are one group;
rows with a null id sort below every id; rows that repeat the surviving id with
the same text all count in ``group_size`` and are all marked kept; an empty
table gives an empty result; other input columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, text_of

PREFIX_CHARS = 64
MAX_BITS = 27
HOT_SHIFT = 17
HOT_LEAST = 32


def _shared_buckets(keys: DataFrame, bits: int) -> DataFrame:
    """(_word, _bits): the buckets of ``_bucket`` with two rows or more, as a bitmap of 2**bits / 64 rows."""
    return (keys.groupBy("_bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
            .select((F.col("_bucket") / 64).cast("long").alias("_word"),
                    F.expr("shiftleft(1L, cast(_bucket % 64 as int))").alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def _bucketed(df: DataFrame, bits: int, *key: str) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(1 << bits)))


def _flagged(df: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Add ``_hit``: whether the row's bucket is set. The bitmap has 2**bits / 64 rows at most."""
    return (df.withColumn("_word", (F.col("_bucket") / 64).cast("long"))
            .join(F.broadcast(bitmap), "_word", "left")
            .withColumn("_hit", F.expr("coalesce(getbit(_bits, cast(_bucket % 64 as int)) = 1, false)"))
            .drop("_word", "_bits"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None,
                prefix_chars: int = PREFIX_CHARS, bits: int | None = None) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, and the ``carry`` columns.

    Of equal texts the row with the largest id stays. ``carry`` names extra
    columns computed while the texts are scanned (a digest, a length).
    """
    spark, carry = docs.sparkSession, carry or {}
    s = Scratch(spark, "exact-dedup")
    src = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *[c.alias(k) for k, c in carry.items()])
    light = src.select(F.length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, prefix_chars)).alias("_prefix"))
    keys = s.write(light, "keys")
    if bits is None:
        bits = min(MAX_BITS, max(10, (16 * keys.count()).bit_length()))
    by_length = _shared_buckets(_bucketed(keys, bits, "_len"), bits)
    left = _flagged(_bucketed(keys, bits, "_len"), by_length).filter("_hit")
    by_prefix = s.write(_shared_buckets(_bucketed(left, bits, "_len", "_prefix"), bits), "prefixes")
    s.drop("keys")

    scan = (src.withColumn("_len", F.length("_text")).withColumn("_prefix", F.xxhash64(F.substring("_text", 1, prefix_chars))))
    hashed = s.write(_flagged(_bucketed(scan, bits, "_len", "_prefix"), by_prefix)
                     .withColumn("_full", F.when(F.col("_hit"), F.sha2("_text", 256)))
                     .select("_id", "_len", "_full", *carry), "hashed")
    s.drop("prefixes")

    out = [F.col("_id").alias(id_col), "keep_id", "group_size", "kept", *carry]
    alone = (hashed.filter("_full is null")
             .select("*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))
    many = hashed.filter("_full is not null")
    groups = s.write(many.groupBy("_len", "_full").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    hot = F.col("group_size") > max(HOT_LEAST, many.count() >> HOT_SHIFT)
    met = many.join(F.broadcast(groups.filter(hot)), ["_len", "_full"], "left")
    rest = met.filter("group_size is null").drop("keep_id", "group_size").join(groups.filter(~hot), ["_len", "_full"])
    cols = ["_id", *carry, "keep_id", "group_size"]
    joined = met.filter("group_size is not null").select(*cols).unionByName(rest.select(*cols)).withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    return alone.select(*out).unionByName(joined.select(*out))
