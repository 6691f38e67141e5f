"""Operator 5, URL filters [native]: domain rules plus mined association rules.

Domain rules (host, path prefix, verdict) decide the pages they fit; the
longest fitting rule wins. Their verdicts are also the labels from which Spark's
FP-growth mines URL token combinations: an itemset with a verdict becomes a
rule "tokens -> verdict", pruned by support and confidence. Pages that no
domain rule fits are judged by the mined rules.

Tokens that occur in exactly the same labelled token sets are one class: no combination of them can tell
anything that one of them does not, so FP-growth mines classes. That leaves one item for all the tokens of a long
url that only it has. No page's classes are cut. Pages of at most ``max_items`` classes go to FP-growth whole, so
each adds at most 2**max_items itemsets. A combination frequent in all labelled pages is frequent in these or in the
longer ones; the latter are found level by level as free sets: combinations that every smaller one
of theirs outnumbers. A combination has the same pages as a free set within it, and all combinations with
the same pages lie in the classes these pages share (the closure), so a rule of a free set and its closure
stands for all of them. Free sets of one verdict are not extended: what holds more classes has less support at the same
confidence. Support and confidence are counted on all labelled pages, so ``max_items`` says which way a combination
is found and changes no result.

Matching uses an inverted index: each mined rule is filed under its rarest
class, the distinct class sets are looked up there, and a
posting counts when the set holds all of the rule's classes (of a class any token does). Work is done per
distinct token set (numbers are one token class), so pages sharing a pattern are
judged once. FP-growth and the joins run in the JVM.

Size: FP-growth keeps itemsets of at least ``min_support`` of the short labelled pages, so it gives at most
2**max_items / min_support rules, independent of the number of pages. The free sets of the longer ones are as many as
there are ways to narrow their pages down while both verdicts occur; no bound cuts them.

Defined cases: a null url or one without ``://`` has an empty host and path and
no tokens, so it gets the default verdict; no labelled pages means no mined
rules and the default verdict; of several mined rules the one with the higher
confidence, then support, then more classes, then block before allow wins; repeated pages are
judged alike; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, ascii_lower

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
MAX_ITEMS = 10
DEFAULT = "allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TAG = "verdict="


def parse_url(url: Column) -> tuple[Column, Column]:
    """(host, path): text after the first ``://`` up to / ? # with A-Z lower-cased, then up to ? or #."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, _PARTS, 1)), F.regexp_extract(u, _PARTS, 2)


def domain_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    best = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host labels and their pairs, path words, query keys, fragment.

    Runs of digits are one class, so page numbers do not make every url unique.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    tail = F.substring_index(F.coalesce(url, F.lit("")), "://", -1)
    query = F.regexp_extract(tail, r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tagged = F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
                      F.transform(words, lambda x: F.concat(F.lit("p:"), F.lower(x))),
                      F.transform(keys, lambda x: F.concat(F.lit("q:"), F.regexp_replace(x, r"[0-9]+", "0"))),
                      F.when(tail.contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tagged)))


def token_classes(labelled: DataFrame, min_support: float) -> DataFrame:
    """(token, cls, n): tokens of at least ``min_support`` of the labelled pages (tokens, verdict); tokens in exactly the same token
    sets share the class named by the least of them. A class is as long as one url at most."""
    total = labelled.agg(F.count("*")).scalar()
    at = F.xxhash64("tokens")
    places = (labelled.groupBy("tokens").agg(F.count("*").alias("_n")).select(F.explode("tokens").alias("token"), "_n", at.alias("_at"), F.xxhash64(at).alias("_at2"))
              .groupBy("token").agg(F.sum("_n").alias("n"), F.count("*").alias("_sets"), F.sum(F.col("_at").cast("decimal(38,0)")).alias("_sum"), F.bit_xor("_at2").alias("_xor"))
              .filter(F.col("n") >= F.lit(min_support) * total))
    same = ["n", "_sets", "_sum", "_xor"]
    return (places.groupBy(*same).agg(F.min("token").alias("cls"), F.collect_list("token").alias("_all"))
            .select(F.explode("_all").alias("token"), "cls", "n"))


def class_sets(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``sets`` (tokens, ...), one row per distinct token set, with ``has``: structs (n, cls, token) of its classes and its first token in each, the rarest first."""
    found = (sets.select("tokens", F.explode("tokens").alias("token")).join(classes, "token")
             .groupBy("tokens", "cls", "n").agg(F.min("token").alias("token"))
             .groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("n", "cls", "token"))).alias("has")))
    return sets.join(found, "tokens")


def candidates(baskets: DataFrame, min_support: float) -> DataFrame:
    """(needs): class combinations that FP-growth finds with a verdict in rows (has, verdict), one per page."""
    items = F.concat(F.transform("has", lambda x: x["cls"]), F.array(F.concat(F.lit(_TAG), "verdict")))
    # a little less, as min_support times the rows is rounded up; rules are counted later
    model = FPGrowth(itemsCol="items", minSupport=min_support * (1 - 1e-9), minConfidence=0.0).fit(baskets.select(items.alias("items")))
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(_TAG))
    return rules.select(F.array_sort("antecedent").alias("needs")).distinct()


def free_sets(rows: DataFrame, long: Column, classes: DataFrame, s: Scratch, total: int, min_support: float) -> DataFrame:
    """(needs): the free sets that are frequent with a verdict in rows (has, verdict, pages), in all and in the ``long`` ones, without those
    that hold a free set of one verdict."""
    total_long = rows.filter(long).agg(F.coalesce(F.sum("pages"), F.lit(0))).scalar()
    found, k = [], 1
    names = rows.filter(long).select(F.explode("has.cls").alias("cls")).distinct()
    tried = names.select(F.array("cls").alias("needs"), F.lit(None).cast("long").alias("least"))
    while True:
        tried = s.write(filed(tried, classes), f"tried-{k}")
        hits = postings(rows, tried).groupBy("needs", "least", "verdict").agg(F.sum("pages").alias("hit"), F.sum(F.when(long, F.col("pages")).otherwise(0)).alias("far"))
        often = (F.col("hit") / total >= min_support) & (F.col("far") / total_long >= min_support)
        level = (hits.groupBy("needs", "least").agg(F.sum("hit").alias("n"), F.count("*").alias("verdicts"), F.max(often).alias("often"))
                 .filter(F.col("often") & (F.col("least").isNull() | (F.col("n") < F.col("least")))))
        level = s.write(level.select("needs", "n", "verdicts"), f"free-{k}")
        found.append(level.select("needs"))
        # sets of k + 1 classes whose subsets of k are all free, frequent and of both verdicts
        more = s.write(level.filter("verdicts > 1").select("needs", "n"), f"more-{k}")
        if not more.limit(2).count() > 1:
            break
        half = more.select(F.slice("needs", 1, k - 1).alias("_head"), F.col("needs")[k - 1].alias("_last"))
        other = half.withColumnRenamed("_last", "_next")
        joined = half.join(other, "_head").filter("_last < _next").select(F.concat("_head", F.array("_last", "_next")).alias("needs"))
        part = joined.select(F.col("needs").alias("_whole"), F.explode("needs").alias("_out")).select("_whole", F.array_remove("_whole", F.col("_out")).alias("needs"))
        tried = (part.join(more, "needs").groupBy("_whole").agg(F.count("*").alias("_parts"), F.min("n").alias("least"))
                 .filter(F.col("_parts") == k + 1).select(F.col("_whole").alias("needs"), "least"))
        k += 1
    return reduce(DataFrame.unionByName, found)


def closures(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(needs, whole): the classes that all rows (has, pages) with a rule's classes share."""
    hits = postings(rows, rules.select("needs", "cls").distinct())
    every = hits.groupBy("needs").agg(F.sum("pages").alias("all"))
    each = hits.select("needs", "pages", F.explode("has.cls").alias("with")).groupBy("needs", "with").agg(F.sum("pages").alias("n"))
    return each.join(every, "needs").filter("n = all").groupBy("needs").agg(F.collect_list("with").alias("whole"))


def filed(needs: DataFrame, classes: DataFrame) -> DataFrame:
    """``needs`` (needs, ...) with ``cls``: the rarest class of each, under which the inverted index files it."""
    freq = classes.select("cls", "n").distinct()
    keys = needs.select("needs").distinct().select("needs", F.explode("needs").alias("cls")).join(freq, "cls")
    return needs.join(keys.groupBy("needs").agg(F.min_by("cls", F.struct("n", "cls")).alias("cls")), "needs")


def postings(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``sets`` (has, ...) with the entries of the index whose classes they all have."""
    looked_up = sets.withColumn("_names", F.transform("has", lambda x: x["cls"])).withColumn("cls", F.explode("_names"))
    return looked_up.join(index, "cls").filter(F.size(F.array_except("needs", "_names")) == 0).drop("cls", "_names")


def mine_rules(labelled: DataFrame, classes: DataFrame, s: Scratch, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               max_items: int = MAX_ITEMS) -> DataFrame:
    """(needs, verdict, confidence, support, cls, whole) from rows (tokens, verdict): the rules, filed under their rarest class; ``whole``
    holds the classes that have the same pages when they come with the needed ones."""
    counted = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("pages"))
    known = s.write(class_sets(counted.select("tokens").distinct(), classes), "labelled-sets")
    rows = (counted.join(known, "tokens").select(F.transform("has", lambda x: F.struct(x["n"].alias("n"), x["cls"].alias("cls"))).alias("has"), "verdict", "pages")
            .groupBy("has", "verdict").agg(F.sum("pages").alias("pages")))
    rows = s.write(rows, "baskets")
    total = labelled.agg(F.count("*")).scalar()
    long = F.size("has") > max_items
    # FP-growth counts rows: one per page
    baskets = rows.filter(~long).select("has", "verdict", F.explode(F.sequence(F.lit(1).cast("long"), "pages")))
    needs = candidates(baskets, min_support)
    some_long = rows.filter(long).limit(1).count()
    if some_long:
        needs = needs.union(free_sets(rows, long, classes, s, total, min_support)).distinct()
    index = s.write(filed(needs, classes), "candidates")
    hits = postings(rows, index).groupBy("needs", "verdict").agg(F.sum("pages").alias("hit"))
    every = hits.groupBy("needs").agg(F.sum("hit").alias("all"))
    exact = (hits.join(every, "needs").select("needs", "verdict", (F.col("hit") / F.col("all")).alias("confidence"), (F.col("hit") / total).alias("support"))
             .filter((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)))
    if not some_long:  # FP-growth lists every combination
        return index.join(exact, "needs").withColumn("whole", F.col("needs"))
    rules = s.write(index.join(exact, "needs"), "counted")
    return rules.join(closures(rows, rules), "needs")


def match_rules(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, best): the best mined rule of each distinct token set, by the inverted index. Of a rule's closure, a set takes the classes that it has."""
    own = F.transform(F.filter("has", lambda x: F.array_contains(F.col("whole"), x["cls"])), lambda x: x["token"])
    value = F.struct("confidence", "support", F.size(own).alias("n_classes"), "verdict", F.concat_ws(" ", F.array_sort(own)).alias("needs"))
    return postings(class_sets(sets, classes), rules).groupBy("tokens").agg(F.max(value).alias("best"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT, max_items: int = MAX_ITEMS) -> DataFrame:
    """Per page: id, host, path, rule, verdict, mined_rule, confidence."""
    s = Scratch(pages.sparkSession, "url-filter")
    url = F.col(url_col)
    host, path = parse_url(url)
    base = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), host.alias("host"), path.alias("path"))
    base = base.withColumn("_rule", domain_rule(F.col("host"), F.col("path"), rules))
    judged = s.write(base.select("_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict"),
                                 url_tokens(F.col("_url"), F.col("host"), F.col("path")).alias("tokens")), "judged")
    labelled = judged.filter("rule is not null").select("tokens", "verdict")
    classes = s.write(token_classes(labelled, min_support), "classes")
    mined = s.write(mine_rules(labelled, classes, s, min_support, min_confidence, max_items), "rules")
    open_ = judged.filter("rule is null")
    best = match_rules(open_.select("tokens").distinct(), mined, classes)
    out = [F.col("_id").alias(id_col), "host", "path", "rule", "verdict", "mined_rule", "confidence"]
    ruled = judged.filter("rule is not null").withColumn("mined_rule", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    rest = (open_.join(best, "tokens", "left")
            .withColumn("mined_rule", F.col("best.needs")).withColumn("confidence", F.col("best.confidence"))
            .withColumn("verdict", F.coalesce("best.verdict", F.lit(default))))
    return ruled.select(*out).unionByName(rest.select(*out))
