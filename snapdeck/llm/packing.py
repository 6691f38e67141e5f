"""Operator 2, conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` words and packed into bins of
that capacity, longest first. A bin takes a piece only if it holds no piece of
the same source and none of the same duplicate cluster; both facts are bits
in the bin's two bitmaps. Open bins are ordered by residual room: a bitmap of
occupied residuals gives the successor of the needed length, and the search goes
on from residual to residual until the tightest compatible bin is found; only
when there is none a new bin opens. Pieces that fill a bin alone skip the search.

Scale: pieces are dealt by hash into shards of about ``shard_items`` pieces
(their number follows the data), and each shard is packed on its own in one
Arrow group. Ids and lengths travel, texts do not. The hash spreads a hot source
or cluster evenly; pieces that are the same in id, place and cluster are dealt by their stored position, so repeated
rows of one or no id spread as well. A piece skips the bins that its source and cluster are known to
conflict with. The last, partly filled bins of the shards are the only loss.

Defined cases: null or empty texts take no room, their bin is null; a null
source or cluster conflicts with nothing; ties are packed by id, then piece;
repeated rows are packed each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, text_of, word_count

CAPACITY = 2048
SHARD_ITEMS = 4096


def best_fit(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """(bin, position) of each (length, source, cluster), taken in the given order; lengths are 1..capacity."""
    shared = {s: n for s, n in Counter(x[1] for x in items if x[1] is not None).items() if n > 1}
    copied = {c: n for c, n in Counter(x[2] for x in items if x[2] is not None).items() if n > 1}
    bit_s = {s: 1 << i for i, s in enumerate(shared)}
    bit_c = {c: 1 << i for i, c in enumerate(copied)}
    sources: list[int] = []  # bitmap of each bin's sources
    clusters: list[int] = []  # bitmap of each bin's duplicate clusters
    held: list[int] = []
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    # per residual and conflict: so many of the first bins are known to conflict; bins of a residual don't change until one is taken out
    blocked: list[dict[tuple[int, int], int]] = [{} for _ in range(capacity + 1)]
    occupied = 0  # bit r: some bin has residual r
    out = []
    for length, source, cluster in items:
        s, c = bit_s.get(source, 0), bit_c.get(cluster, 0)
        found, rest = -1, occupied >> length
        r = length
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            level = by_residual[r]
            for k in range(len(level) - 1, blocked[r].get((s, c), 0) - 1, -1):
                if not (sources[level[k]] & s or clusters[level[k]] & c):
                    found = level.pop(k)
                    blocked[r].clear()
                    break
            if found >= 0:
                break
            blocked[r][s, c] = len(level)
            rest >>= step + 1
            r += 1
        if found < 0:
            found, r = len(held), capacity
            sources.append(0)
            clusters.append(0)
            held.append(0)
        elif not by_residual[r]:
            occupied &= ~(1 << r)
        out.append((found, held[found]))
        held[found] += 1
        sources[found] |= s
        clusters[found] |= c
        if left := r - length:
            by_residual[left].append(found)
            occupied |= 1 << left
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None,
         capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Per piece: id, piece, start (word offset), n_words, bin_id, position.

    ``cluster`` names the duplicate cluster; by default equal texts are one.
    """
    s = Scratch(docs.sparkSession, "packing")
    cluster = F.xxhash64(text_of(text_col)) if cluster is None else cluster
    src = docs.select(F.col(id_col).alias("_id"), word_count(text_of(text_col)).alias("_words"),
                      F.when(F.col(source_col).isNotNull(), F.xxhash64(F.col(source_col))).alias("_source"), cluster.cast("long").alias("_cluster"))
    lengths = s.write(src, "lengths")  # the texts are scanned once
    pieces = s.write(lengths.withColumn("_p", F.when(F.col("_words") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("_words") - 1) / capacity)))
                                    .otherwise(F.array(F.lit(0).cast("long"))))
                     .select("_id", "_words", "_source", "_cluster", F.explode("_p").alias("piece"))
                     .withColumn("start", F.col("piece") * capacity)
                     .withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("_words") - F.col("start")))
                     .drop("_words").withColumn("_at", F.monotonically_increasing_id()), "pieces")
    s.drop("lengths")
    empty = pieces.filter("n_words = 0")
    full = pieces.filter("n_words > 0")
    shards = max(1, -(-full.count() // shard_items))
    key = F.xxhash64("_id", "piece", "_cluster")
    again = s.write(full.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key", F.lit(True).alias("_again")), "again")
    dealt = (full.withColumn("_key", key).join(again, "_key", "left")
             .withColumn("_shard", F.pmod(F.when(F.col("_again"), F.xxhash64("_key", "_at")).otherwise(F.col("_key")), F.lit(shards))))

    def run(t: pa.Table) -> pa.Table:
        cols = {n: t.column(n).to_pylist() for n in ("_id", "piece", "n_words", "_source", "_cluster")}
        order = sorted(range(t.num_rows), key=lambda i: (-cols["n_words"][i], cols["_id"][i] is None, 0 if cols["_id"][i] is None else cols["_id"][i], cols["piece"][i]))
        placed = best_fit([(cols["n_words"][i], cols["_source"][i], cols["_cluster"][i]) for i in order], capacity)
        base = t.column("_shard")[0].as_py() << 32
        got = t.select(["_id", "piece", "start", "n_words"]).take(pa.array(order))
        got = got.append_column("bin_id", pa.array([base + b for b, _ in placed], pa.int64()))
        return got.append_column("position", pa.array([p for _, p in placed], pa.int32()))

    kind = docs.schema[id_col].dataType.simpleString()
    packed = (dealt.groupBy("_shard")
              .applyInArrow(run, f"_id {kind}, piece long, start long, n_words long, bin_id long, position int"))
    none = empty.select("_id", "piece", "start", "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("position"))
    return packed.unionByName(none).withColumnRenamed("_id", id_col)
