"""Operator 13, mixing sources to target weights: Pareto order sampling.

The mix has ``percent`` of all words. Sources share it by weight; a source's target stops at ``most``
times its own words, and what is over is shared again by weight among the others until none is above.
A source's target is floor(target / words) whole copies of each of its documents, which are certain, and a
rest. The rest is drawn without replacement by Pareto order sampling: with an inclusion
probability p (the rest's share of the source, so unequal from source to source; ``odds_col`` multiplies a document's
own odds) and a random u from the id's hash, documents are ranked by

    q = (u / (1 - u)) / (odds * p / (1 - p))

and taken from the smallest q on until the rest is full. The size of a sample is fixed in words: the last
document of a source is taken in part, so the words taken are floor(target). Within a source p does not change
the order, so ranks need no knowledge of the targets.

Scale: texts are read once and only (id, source, words, q) go on. Documents are dealt by (source, slice of q), with as
many slices as the rows need, so a source with a third of all rows is split evenly; words are summed by slice with map-side
combine, running sums over slices give each slice its start, and rows are ordered within their slice only. No source
table is broadcast or collected: sources are numbered by a range-partitioned sort, and a round of sharing brings two sums to the driver.

Defined cases: null text has no words; a null source is a source and comes last; documents without words are
taken 0 times, and a source without words has target 0; a null id hashes as the empty text; ties of q go to the smaller id, null
last, then the smaller size; rows repeated with one id are documents of their own; odds that are null count as 1, odds of 0 or less come
last; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, text_of, word_count

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST = 2
SEED = 13
SLICE_ROWS = 2048


def numbered(df: DataFrame, order: list, s: Scratch, name: str) -> DataFrame:
    """``df`` with ``_index`` 0, 1, ... in ``order``: a range-partitioned sort, and offsets of one row per partition."""
    put = s.write(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = sorted((r.p, r.n) for r in put.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return (put.join(F.broadcast(offsets), part == F.col("_p"))
            .withColumn("_index", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_at"))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares of percent of all words, none above most * source_size.
    Every round fixes the sources that are above at their most and shares the remainder anew."""
    s = Scratch(sources.sparkSession, "mixing-targets")
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_index") % len(weights) + 1).cast("int"))
    table = s.write(numbered(sources, order, s, "sorted").select("source", "source_size", weight.cast("long").alias("_w")), "weights")
    s.drop("sorted")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget, share, cap = percent * total / 100, 0.0, most * F.col("source_size")
    while True:
        over = F.col("_w") * F.lit(share) > cap
        fixed, open_ = table.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0))).first()
        after = (budget - fixed) / open_ if open_ else share
        if after <= share:
            break
        share = after
    return table.select("source", "source_size", F.least(F.col("_w") * F.lit(share), cap.cast("double")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS,
                percent: int = PERCENT, most: int = MOST, seed: int = SEED, odds_col: str | None = None) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken (words of it in the mix, repeats counted)."""
    s = Scratch(docs.sparkSession, "source-mixing")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    odds = F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)) if odds_col else F.lit(1.0)
    q = F.when(odds > 0, u / (F.lit(1.0) - u) / odds).otherwise(F.lit(float("inf")))
    rows = s.write(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"), q.alias("q")), "sizes")
    # the smaller u, the smaller q: slices of u / odds keep the order and split every source evenly
    slices = 1 + rows.count() // SLICE_ROWS
    share = F.when(F.col("q") < float("inf"), F.col("q") / (F.lit(1.0) + F.col("q"))).otherwise(F.lit(1.0))
    rows = rows.withColumn("slice", F.floor(share * F.lit(float(slices))).cast("long"))
    by_slice = s.write(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    targets = s.write(source_targets(by_slice.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most), "targets")
    # null sources join too, as a name of their own that no source has
    name = [F.col("source").isNull().cast("int"), F.coalesce("source", F.lit(""))]
    keyed = lambda df: df.withColumn("_null", name[0]).withColumn("_name", name[1]).drop("source")
    up_to = Window.partitionBy("_null", "_name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keyed(by_slice).withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0))).drop("words")
              .join(keyed(targets), ["_null", "_name"]))
    in_slice = Window.partitionBy("_null", "_name", "slice").orderBy("q", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.withColumn("_null", name[0]).withColumn("_name", name[1]).withColumn("prior", F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
    full = F.floor("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0))
    rest = full - copies * F.col("source_size")
    drawn = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before") - F.col("prior")))
    return (ordered.join(starts, ["_null", "_name", "slice"])
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                    (copies * F.col("size") + drawn).cast("long").alias("taken")))
