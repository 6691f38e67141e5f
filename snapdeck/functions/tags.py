"""Column functions over tag bags (B1-B7, B13).  All are built-in
expressions (higher-order array functions, map literals), so they stay
inside whole-stage code generation; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (ARXIV_PREFIX, LICENSE_PREFIX, LICENSE_TAXONOMY, SIZE_LOG10_MID, SIZE_PREFIX,
                    TASK_PREFIX)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic(tag) -> Column:
    """B1: ``task_categories:x`` -> x; a tag without ``:`` -> itself; else NULL."""
    t = _c(tag)
    return (F.when(t.startswith(TASK_PREFIX), F.substring(t, len(TASK_PREFIX) + 1, 1 << 30))
            .when(~t.contains(":"), t))


def topics(tags) -> Column:
    """Distinct topics of one tag bag (NULL bag -> empty), in first-seen order."""
    arr = F.coalesce(_c(tags), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(arr, topic), lambda x: x.isNotNull()))


def has_paper(tags) -> Column:
    """B2: any tag starts with ``arxiv:``; a NULL bag is not a paper."""
    return F.coalesce(F.exists(_c(tags), lambda x: x.startswith(ARXIV_PREFIX)), F.lit(False))


def arxiv_ids(tags) -> Column:
    """Every ``arxiv:`` id, prefix stripped, in tag order (NULL bag -> [])."""
    arr = F.coalesce(_c(tags), F.array().cast("array<string>"))
    return F.transform(F.filter(arr, lambda x: x.startswith(ARXIV_PREFIX)),
                       lambda x: F.substring(x, len(ARXIV_PREFIX) + 1, 1 << 30))


def first_with_prefix(tags, prefix: str) -> Column:
    """First tag with ``prefix``, stripped; NULL when there is none.

    ``get`` returns NULL past the end, where ``[0]`` would raise under ANSI.
    """
    first = F.get(F.filter(_c(tags), lambda x: x.startswith(prefix)), 0)
    return F.substring(first, len(prefix) + 1, 1 << 30)


def license_from_tags(tags) -> Column:
    """The first ``license:`` tag decides."""
    return first_with_prefix(tags, LICENSE_PREFIX)


def _license_group_map() -> Column:
    kv = []
    for slug, (cat, sub) in LICENSE_TAXONOMY.items():
        kv += [F.lit(slug), F.lit(f"AUP ({sub})" if cat == "AUP" else cat)]
    return F.create_map(*kv)


def license_group(lic) -> Column:
    """Licence slug -> group; unknown slug -> Other; NULL -> unspecified."""
    c = _c(lic)
    return F.when(c.isNull(), F.lit("unspecified")).otherwise(F.coalesce(_license_group_map()[c], F.lit("Other")))


def license_from_card(card) -> Column:
    """Licence from card JSON: a string as is; a list comma-joined
    (empty -> NULL); unparsable JSON -> NULL."""
    raw = F.get_json_object(_c(card), "$.license")
    as_list = F.from_json(raw, "array<string>")
    joined = F.when(F.size(as_list) > 0, F.array_join(as_list, ","))
    return F.when(raw.startswith("["), joined).otherwise(raw)


def size_log10_mid(tags) -> Column:
    """First ``size_categories:`` tag -> log10 midpoint; unmapped -> NULL."""
    m = F.create_map(*[x for k, v in SIZE_LOG10_MID.items() for x in (F.lit(k), F.lit(v))])
    return m[first_with_prefix(tags, SIZE_PREFIX)]


def topic_ids(tags, vocab_map: Column) -> Column:
    """Sorted distinct vocabulary indices of a row's topics.

    ``vocab_map`` is a map column topic -> index (e.g. from a broadcast dim
    aggregated with ``map_from_entries``)."""
    idx = F.transform(topics(tags), lambda x: vocab_map[x])
    return F.array_sort(F.array_distinct(F.filter(idx, lambda x: x.isNotNull())))
