"""Operator 8, line dedup: site-relative line frequency.

A line is boilerplate of a host when the pages holding it are more than ``ratio_percent`` of the
host's pages, where every host counts ``prior_pages`` pages more than it has:

    100 * pages with the line > ratio_percent * (pages of the host + prior_pages)

The added pages, none of which holds the line, are the usual shrinkage of a ratio of few observations. Without
them a line on one of ten pages would be as suspicious as one on a thousand of ten thousand. The same
formula holds for every host: 6 of 10 pages, 13 of 100 and 6 % of a very large site come to the same. Menus and
footers of a section stand on a few percent of a large site, so the ratio is low.

Lines are compared with surrounding white space trimmed; blank lines are never judged and stay. The count runs on line hashes,
one row per page and distinct line, with map-side partial sums, so a hot host
or line never meets in one task. A host has at most 100 * (lines per page) / ratio_percent
boilerplate lines, and only those are joined back. The kept lines are selected inside each row; texts are never exploded back.

Defined cases: null text counts as empty (one blank line); a null host is a
host of its own; a ratio that is just reached keeps the line; a
line repeated within a page counts once; repeated rows count as pages; an empty
table gives an empty result. Other columns pass through, names starting with
``_ld_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, text_of

RATIO_PERCENT = 3
PRIOR_PAGES = 100


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(" \t\r")))


def boilerplate(docs: DataFrame, text_col: str, host_col: str, ratio_percent: int, prior_pages: int) -> DataFrame:
    """(_ld_host, _ld_drop): per host the hashes of its boilerplate lines."""
    pages = docs.select(F.col(host_col).alias("_ld_host"), text_of(text_col).alias("_ld_text"))
    totals = pages.groupBy("_ld_host").agg(F.count("*").alias("_ld_pages"))
    blank = F.xxhash64(F.lit(""))
    seen = (pages.select("_ld_host", F.explode(F.array_distinct(F.transform(_lines(F.col("_ld_text")), _key))).alias("_ld_key"))
            .filter(F.col("_ld_key") != blank)
            .groupBy("_ld_host", "_ld_key").agg(F.count("*").alias("_ld_n")))
    # a line that can't be boilerplate of any host stops before the join
    least = ratio_percent * (prior_pages + 1) // 100
    bad = 100 * F.col("_ld_n") > ratio_percent * (F.col("_ld_pages") + prior_pages)
    return (seen.filter(F.col("_ld_n") >= least)
            .join(totals.withColumnRenamed("_ld_host", "_ld_h"), F.col("_ld_host").eqNullSafe(F.col("_ld_h")))
            .filter(bad)
            .groupBy("_ld_host").agg(F.collect_set("_ld_key").alias("_ld_drop")))


def line_dedup(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio_percent: int = RATIO_PERCENT,
               prior_pages: int = PRIOR_PAGES, stats: bool = False) -> DataFrame:
    """The documents with boilerplate lines removed from ``text_col``; with
    ``stats`` also n_lines and n_dropped (long)."""
    s = Scratch(docs.sparkSession, "line-dedup")
    drop = s.write(boilerplate(docs, text_col, host_col, ratio_percent, prior_pages), "drop").withColumnRenamed("_ld_host", "_ld_h")
    cols = docs.columns
    # one row per host with boilerplate; a hot host's documents are split by AQE when this is not broadcast
    df = docs.join(drop, F.col(host_col).eqNullSafe(F.col("_ld_h")), "left")
    df = df.withColumn("_ld_all", _lines(text_of(text_col)))
    kept = F.when(F.col("_ld_drop").isNull(), F.col("_ld_all")).otherwise(
        F.filter("_ld_all", lambda x: ~F.array_contains(F.col("_ld_drop"), _key(x))))
    df = df.withColumn("_ld_kept", kept)
    text = F.when(F.size("_ld_kept") == F.size("_ld_all"), F.col(text_col)).otherwise(F.concat_ws("\n", "_ld_kept"))
    extra = [F.size("_ld_all").cast("long").alias("n_lines"),
             (F.size("_ld_all") - F.size("_ld_kept")).cast("long").alias("n_dropped")] if stats else []
    return df.select(*[text.alias(c) if c == text_col else F.col(c) for c in cols], *extra)
