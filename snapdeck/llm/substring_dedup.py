"""Operator 7, substring dedup: prefix-partitioned suffix trees.

A suffix is a word position and what follows it. Suffixes are split into groups
by the words they begin with, each group is one subtree of the corpus's
suffix tree that fits in memory, and the tree is needed down to the depth of
``window`` words only: an internal node at that depth is a window that occurs at
several places. Of those places all but the first (smallest id, then
smallest start) are marked, and overlapping marks join into maximal repeats.

1. ``write_batches`` puts the documents in addressable batches of a few MB.
2. Most suffixes share no window with any other. They are left out exactly: of
   the ``gram``-word runs inside a window the one with the least hash is its
   anchor, equal windows have equal anchors, so only windows whose anchor
   occurs twice go on. About two positions in nine are anchors, and only their hashes travel.
3. The remaining suffixes go to groups by the hash of their first ``PREFIX`` words;
   a group beyond ``group_items`` is split by twice as long a prefix, so prefixes have
   variable length. Equal windows of one batch are merged first (only the
   earliest travels, the later ones are marked at once), so a passage shared by a third of all
   rows costs one entry per batch.
4. Each group sorts its suffixes along the path (longer prefix, window) and sends the
   marks back to the batches; only documents with remaining suffixes are read again.

Words are compared by 64-bit hashes of their bytes.

Defined cases: null and empty texts have no words; a document shorter than the
window keeps everything; a null id sorts first; rows that repeat an id are ordered
by batch and place; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdeck.llm.common import Scratch, arrow_rows, pack_texts, rolling_hashes, split_by, unpack_texts, word_hashes, write_batches

WINDOW = 20
GRAM = 13
PREFIX = 5
BATCH_BYTES = 1 << 22
GROUP_ITEMS = 500_000
_ENTRY = np.dtype([("key", "<u8"), ("deep", "<u2"), ("id", "<i8"), ("row", "<u4"), ("start", "<u4")])
_MARK = np.dtype([("row", "<u4"), ("start", "<u4")])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (least or greatest) over every run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def _anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least hash among its runs of ``gram`` words, and the hashes of all places that are some window's least."""
    gram = min(gram, window)
    span = window - gram + 1
    g = rolling_hashes(h, gram)[0]
    if len(g) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = _slide(g, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    return least, g[_slide(np.concatenate((pad, least, pad)), span, np.maximum) == g]


def _binary(arrays: list) -> pa.Array:
    return pa.array(arrays, pa.binary())


def _find_anchors(groups: int, window: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                batch, found = r["batch"], []
                for t in unpack_texts(r["lengths"], r["texts"]):
                    places = _anchors(word_hashes(t), window, gram)[1]
                    if len(places):
                        found.append(places)
                if not found:
                    continue
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                values = np.repeat(values, np.minimum(counts, 2))  # twice: already repeated within the batch
                out = list(split_by((values % np.uint64(groups)).astype(np.int64), groups))
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(out), pa.int64()), pa.array([g for g, _ in out], pa.int64()),
                                                  _binary([values[i].tobytes() for _, i in out])], names=["batch", "group", "payload"])
    return run


def _repeated(t: pa.Table) -> pa.Table:
    """Per batch the anchors of the group that occur at least twice anywhere."""
    data = [np.frombuffer(x, np.uint64) for x in t.column("payload").to_pylist()]
    values = np.concatenate(data)
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = np.concatenate((v[1:] == v[:-1], [False])) | np.concatenate(([False], v[1:] == v[:-1]))
    keep = order[same]
    out = list(split_by(owner[keep], len(data)))
    batches = t.column("batch").to_pylist()
    return pa.table({"batch": pa.array([batches[o] for o, _ in out], pa.int64()),
                     "payload": _binary([np.unique(values[keep[i]]).tobytes() for _, i in out])})


def _suffixes(groups: int, window: int, gram: int):
    """Rows of three kinds: document rows (row, id, n_words, sha), suffix groups (group, payload), marks known at once
    (payload), and the texts of documents that may lose words (texts)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                again = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in r["anchors"] or [])]))
                docs, entries, read = [], [], []
                for row, (i, data) in enumerate(zip(r["ids"], unpack_texts(r["lengths"], r["texts"]), strict=True)):
                    h = word_hashes(data)
                    docs.append((row, i, len(h), hashlib.sha256(b" ".join(data.split())).hexdigest()))
                    a = _anchors(h, window, gram)[0]
                    if not len(a) or not len(again):
                        continue
                    at = np.searchsorted(again, a)
                    at[at == len(again)] = 0
                    start = np.flatnonzero(again[at] == a)
                    if not len(start):
                        continue
                    key, short, long = rolling_hashes(h, window, min(PREFIX, window), min(2 * PREFIX, window))
                    e = np.zeros(len(start), _ENTRY)
                    e["key"], e["start"], e["row"] = key[start], start, row
                    e["deep"] = (long[start] >> np.uint64(48)).astype(np.uint16)
                    e["id"] = np.iinfo(np.int64).min if i is None else i
                    entries.append((e, (short[start] % np.uint64(groups)).astype(np.int64)))
                    read.append((row, data))
                rows = {"kind": [], "batch": [], "group": [], "payload": [], "rows": [], "ids": [], "words": [], "shas": [], "lengths": [], "texts": []}

                def put(kind, group=None, payload=None, rows_=None, ids=None, words=None, shas=None, lengths=None, texts=None, rows=rows, batch=r["batch"]):
                    for k, v in zip(rows, (kind, batch, group, payload, rows_, ids, words, shas, lengths, texts), strict=True):
                        rows[k].append(v)

                put("doc", rows_=[d[0] for d in docs], ids=[d[1] for d in docs], words=[d[2] for d in docs], shas=[d[3] for d in docs])
                if entries:
                    e, g = np.concatenate([x for x, _ in entries]), np.concatenate([x for _, x in entries])
                    order = np.lexsort((e["start"], e["row"], e["id"], e["key"]))
                    e, g = e[order], g[order]
                    first = np.concatenate(([True], e["key"][1:] != e["key"][:-1]))
                    if not first.all():
                        put("mark", payload=_marks(e[~first]))
                    e, g = e[first], g[first]
                    for group, i in split_by(g, groups):
                        put("suffix", group=group, payload=e[i].tobytes())
                    lengths, data = pack_texts([x for _, x in read])
                    put("text", rows_=[x for x, _ in read], lengths=lengths, texts=data)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows["kind"], pa.string()), pa.array(rows["batch"], pa.int64()), pa.array(rows["group"], pa.int64()), _binary(rows["payload"]),
                    pa.array(rows["rows"], pa.list_(pa.int32())), pa.array(rows["ids"], pa.list_(pa.int64())), pa.array(rows["words"], pa.list_(pa.int64())),
                    pa.array(rows["shas"], pa.list_(pa.string())), pa.array(rows["lengths"], pa.list_(pa.int32())), _binary(rows["texts"])], names=list(rows))
    return run


_SUFFIX_SCHEMA = ("kind string, batch long, group long, payload binary, rows array<int>, ids array<long>, words array<long>, "
                  "shas array<string>, lengths array<int>, texts binary")


def _marks(e: np.ndarray) -> bytes:
    m = np.zeros(len(e), _MARK)
    m["row"], m["start"] = e["row"], e["start"]
    return m.tobytes()


def _split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal the suffixes of an oversize group by the longer prefix."""
    for b in parts:
        for r in b.to_pylist():
            e, n = np.frombuffer(r["payload"], _ENTRY), r["pieces"]
            out = [(0, slice(None))] if n == 1 else list(split_by((e["deep"] % n).astype(np.int64), n))
            yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(out), pa.int64()), pa.array([r["group"]] * len(out), pa.int64()),
                                              pa.array([p for p, _ in out], pa.int64()), _binary([e[i].tobytes() for _, i in out])],
                                             names=["batch", "group", "piece", "payload"])


def _subtree(t: pa.Table) -> pa.Table:
    """Per batch the places of one subtree whose window occurs earlier."""
    data = [np.frombuffer(x, _ENTRY) for x in t.column("payload").to_pylist()]
    e = np.concatenate(data)
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    batches = np.array(t.column("batch").to_pylist(), np.int64)
    # along the path: longer prefix, then the node at depth ``window``; within it the first place leads
    order = np.lexsort((e["start"], e["row"], batches[owner], e["id"], e["key"], e["deep"]))
    e, owner = e[order], owner[order]
    later = np.concatenate(([False], (e["key"][1:] == e["key"][:-1]) & (e["deep"][1:] == e["deep"][:-1])))
    e, owner = e[later], owner[later]
    out = list(split_by(owner, len(data)))
    return pa.table({"batch": pa.array([int(batches[o]) for o, _ in out], pa.int64()), "payload": _binary([_marks(e[i]) for _, i in out])})


def _cut(window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                m = np.concatenate([np.frombuffer(x, _MARK) for x in r["marks"]])
                m = m[np.argsort(m["row"], kind="stable")]
                text = dict(zip(r["rows"], unpack_texts(r["lengths"], r["texts"]), strict=True))
                out = []
                at = np.flatnonzero(np.concatenate(([True], m["row"][1:] != m["row"][:-1])))
                for row, starts in zip(m["row"][at].tolist(), np.split(m["start"], at[1:]), strict=True):
                    words = text[row].split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + np.uint32(window), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    out.append((row, int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                                [{"start": int(x), "stop": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)]))
                spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()),
                                                  pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()),
                                                  pa.array([x[3] for x in out], spans)], names=["batch", "row", "n_removed", "sha", "spans"])
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                    batch_bytes: int = BATCH_BYTES, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256, spans (word ranges removed, stop exclusive)."""
    spark = docs.sparkSession
    s = Scratch(spark, "substring-dedup")
    batches = write_batches(docs, s, "batches", id_col, text_col, batch_bytes)
    n = batches.count()
    groups = max(1, -(-n * (batch_bytes // 24) // group_items))  # about one anchor for 24 bytes of text
    with arrow_rows(spark, 1):
        anchors = (batches.select("batch", "lengths", "texts").mapInArrow(_find_anchors(groups, window, gram), "batch long, group long, payload binary")
                   .groupBy("group").applyInArrow(_repeated, "batch long, payload binary")
                   .groupBy("batch").agg(F.collect_list("payload").alias("anchors")))
        anchors = s.write(anchors, "anchors")
        # about a sixth of the words' suffixes remain; groups follow the input
        groups = max(1, -(-n * (batch_bytes // 36) // group_items))
        parts = s.write(batches.join(anchors, "batch", "left").select("batch", "ids", "lengths", "texts", "anchors")
                        .mapInArrow(_suffixes(groups, window, gram), _SUFFIX_SCHEMA), "suffixes", compression="zstd")
    s.drop("batches")
    s.drop("anchors")
    suffix = parts.filter("kind = 'suffix'").select("batch", "group", "payload")
    # the groups to be split are few; written first, their size is known to the planner
    over = s.write(suffix.groupBy("group").agg(F.ceil(F.sum(F.length("payload")) / (_ENTRY.itemsize * group_items)).alias("pieces"))
                   .filter("pieces > 1"), "oversize")
    with arrow_rows(spark, 200):
        found = (suffix.join(over, "group", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
                 .select("batch", "group", "payload", "pieces").mapInArrow(_split, "batch long, group long, piece long, payload binary")
                 .groupBy("group", "piece").applyInArrow(_subtree, "batch long, payload binary"))
        marks = s.write(found.unionByName(parts.filter("kind = 'mark'").select("batch", "payload"))
                        .groupBy("batch").agg(F.collect_list("payload").alias("marks")), "marks")
    with arrow_rows(spark, 1):
        cut = s.write(parts.filter("kind = 'text'").select("batch", "rows", "lengths", "texts").join(marks, "batch")
                      .mapInArrow(_cut(window), "batch long, row int, n_removed long, sha string, spans array<struct<start:int,stop:int>>"), "cut")
    s.drop("marks")
    whole = (parts.filter("kind = 'doc'").select("batch", F.explode(F.arrays_zip("rows", "ids", "words", "shas")).alias("d"))
             .select("batch", F.col("d.rows").alias("row"), F.col("d.ids").alias(id_col), F.col("d.words").alias("n_words"), F.col("d.shas").alias("_sha")))
    return (whole.join(cut, ["batch", "row"], "left")
            .select(id_col, "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "_sha").alias("kept_sha256"),
                    F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans")))
