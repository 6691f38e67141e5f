"""Operator 9, benchmark decontamination [native]: broadcast set of test n-grams.

Words are runs of lower-cased letters and digits (every character from U+0080 on counts
as a letter). Each benchmark item gives its windows of ``n`` consecutive words;
an item of fewer words is one window. The scan looks at aligned blocks of g
words of each document, g = (shortest window + 1) // 2, because every window
contains one whole aligned block. Block hashes probe the broadcast hash set of the
benchmark's g-grams; a block that hits is verified: the windows around it are
compared as text with the benchmark's windows. Only block rows travel
through the broadcast join, a document's text never leaves its row.

Broadcast bound: the benchmark is small and fixed by its owner. Its g-grams are
counted first; above ``max_broadcast`` the same join is left to a shuffle.

Defined cases: null texts have no words; an empty document or benchmark gives
zero hits; a word covered by several windows counts once; items sharing a
window all count; items with a null id are ignored; rows that repeat an id with
the same text get the same figures; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdeck.llm.common import UPPER, Scratch, text_of

N = 10
MAX_BROADCAST = 2_000_000
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAKS = "".join(map(chr, [*range(1, 48), *range(58, 65), *range(91, 97), *range(123, 128), 0]))


def words_of(text: Column) -> Column:
    """Array of normalised words: one character map lower-cases A-Z and turns separators into spaces."""
    flat = F.translate(text, UPPER + _BREAKS, UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(flat, " "), "")


def _grams(words: Column, first: Column | int, last: Column, size: Column | int) -> Column:
    """Texts of the runs of ``size`` words that start at first..last (1-based)."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.concat_ws(" ", F.slice(words, i, size)))
                  ).otherwise(F.array().cast("array<string>"))


def benchmark_windows(bench: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, size, items): distinct windows with the ids of their items, as strings."""
    items = bench.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words_of(text_of(text_col)).alias("words"))
    items = items.withColumn("size", F.least(F.size("words"), F.lit(n))).filter("size > 0")
    w = F.col("words")
    return (items.select("item", "size", F.explode(_grams(w, 1, F.size(w) - F.col("size") + 1, F.col("size"))).alias("window"))
            .groupBy("window", "size").agg(F.collect_set("item").alias("items")))


def hits(docs: DataFrame, bench: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST, scratch: Scratch | None = None) -> DataFrame:
    """(_key, start, size, items): each occurrence of a benchmark window, from rows (_key, _text)."""
    s = scratch or Scratch(docs.sparkSession, "decontaminate")
    windows = s.write(benchmark_windows(bench, n), "windows")
    short = windows.agg(F.min("size"), F.count("*")).first()
    least = min(short[0] or n, n)
    g = (least + 1) // 2
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # n values at most
    ww = words_of(F.col("window"))
    grams = windows.select(F.explode(_grams(ww, 1, F.size(ww) - g + 1, g)).alias("gram")).select(F.xxhash64("gram").alias("_gram")).distinct()
    small = (short[1] * n <= max_broadcast)
    near = F.broadcast if small else (lambda x: x)

    w = F.col("_words")
    last = F.floor((F.size(w) - g) / g).cast("int")
    # for the block at p: its gram, and the words that a window holding it can have, p - (n-g) .. p + n - 1
    at = F.when(F.size(w) >= g, F.transform(F.sequence(F.lit(0), last), lambda b: b * g + 1)).otherwise(F.array().cast("array<int>"))
    lo = lambda p: F.greatest(F.lit(1), p - (n - g))
    block = F.transform(at, lambda p: F.struct(F.xxhash64(F.concat_ws(" ", F.slice(w, p, g))).alias("gram"), lo(p).alias("lo"),
                                               F.concat_ws(" ", F.slice(w, lo(p), p + n - lo(p))).alias("around")))
    found = (docs.select("_key", words_of(F.col("_text")).alias("_words"))
             .select("_key", F.explode(block).alias("_b"))
             .select("_key", F.col("_b.gram").alias("_gram"), F.col("_b.lo").alias("lo"), F.col("_b.around").alias("around"))
             .join(near(grams), "_gram", "left_semi"))
    cut = F.split("around", " ")
    place = lambda x, i: F.struct(x.alias("window"), (F.col("lo") + i).alias("start"))
    tries = F.concat(*[F.transform(_grams(cut, 1, F.size(cut) - (k - 1), k), place) for k in sizes]
                     ) if sizes else F.array().cast("array<struct<window:string,start:int>>")
    return (found.select("_key", F.explode(tries).alias("t")).select("_key", F.col("t.start").alias("start"), F.col("t.window").alias("window"))
            .distinct().join(near(windows), "window").select("_key", "start", "size", "items"))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text",
                  max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted strings), spans (start, end of each hit run's windows)."""
    s = Scratch(docs.sparkSession, "decontaminate")
    # rows are told apart by id and text, so repeated ids with other texts stay apart
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"))
    src = docs.select(key.alias("_key"), text_of(text_col).alias("_text"))
    found = s.write(hits(src, bench, n, max_broadcast, s), "hits")
    words = (found.select("_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
             .distinct().groupBy("_key").agg(F.count("*").alias("n_hit")))
    items = (found.select("_key", F.explode("items").alias("item")).distinct()
             .groupBy("_key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    spans = found.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size") - 1).alias("end")))).alias("spans"))
    dirty = s.write(words.join(items, "_key").join(spans, "_key"), "dirty")
    s.drop("hits")
    counts = docs.select(key.alias("_key"), F.regexp_count(text_of(text_col), F.lit(RAW_WORD)).cast("long").alias("n_words"))
    return (counts.select("*", F.col("_key.id").alias("_i"), F.col("_key.h").alias("_h"))
            .join(dirty.select(F.col("_key.id").alias("_i2"), F.col("_key.h").alias("_h2"), "n_hit", "items", "spans"),
                  F.col("_i").eqNullSafe(F.col("_i2")) & (F.col("_h") == F.col("_h2")), "left")
            .select(F.col("_i").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))


def clean_documents(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text",
                    max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents without any benchmark window; all columns are kept."""
    s = Scratch(docs.sparkSession, "clean")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"))
    found = hits(docs.select(key.alias("_key"), text_of(text_col).alias("_text")), bench, n, max_broadcast, s)
    dirty = s.write(found.select(F.col("_key.id").alias("_dc_id"), F.col("_key.h").alias("_dc_h")).distinct(), "dirty")
    return docs.join(dirty, F.col(id_col).eqNullSafe(F.col("_dc_id")) & (F.xxhash64(text_of(text_col)) == F.col("_dc_h")), "left_anti")
