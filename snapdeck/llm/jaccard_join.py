"""Operator 4, n-gram Jaccard join: PartEnum signatures, and the components they link.

A document's set holds its distinct word shingles; two sets are linked when
100 * |A & B| >= 80 * |A | B|. Equal sets form one class (a node); everything below works
on classes.

Signatures. Sets of sizes a <= b that are linked have b <= 1.25 a and differ in
at most (a + b) / 9 shingles. Size bands grow by 1.25**2, so linked sets lie in the same or in
neighbouring bands and meet under the label of the upper band. PartEnum: a label splits the
feature domain into first-level partitions, each partition into ``SPLIT`` second-level parts, and enumerates in
every partition the subsets of ``SPLIT`` - 1 parts. A signature is (label, partition, subset, content of the
subset); a subset without content gives none. Sets that differ in k shingles agree on a subset of every
partition that holds at most one of these, so there are somewhat more than k / 2 partitions. The first differing shingle
of a partition changes at most ``SPLIT`` - 1 signatures and the second the last one: ``lost`` bounds what k of them change,
and a set with m signatures shares at least ``need`` = m - lost of them with each linked set. The first
pass checks need >= 1 for every set and label; where a set is unlucky, the
label gets more partitions (``LEVELS``), so the guarantee holds for all rows.

Candidates. One shuffle of packed signatures tells which occur in two classes. Every label has buckets of its own, so a set's
signatures lie in few of them and each of its headers serves many.
A class with fewer than ``need`` shared signatures has no partner and leaves, which removes
the texts that only share passages. The rest are compared in two steps:
1. In every signature group each member is compared with one centre (the member whose identity has the
   least hash, so a family keeps meeting the same few centres): a number of pairs linear in the group. Sizes and parity sketches, which
   may not differ more than linked sets can, rule most out; the others are verified. Links give components.
2. Pairs of different components in one group are left; of groups with the same members one is looked at. They are compared in blocks
   of ``BLOCK`` members by their sizes and sketches. The few pairs that remain are verified.
Links inside a component found in step 1 need no further look: components stay exact.

Skew. Copies are one class. A signature that many classes of one task hold is settled there
(all but two of its entries stay out of the shuffle of signatures), so a family of near copies costs each
task a bounded number of entries; its groups are compared in blocks.

Defined cases: null and empty texts have the empty set, linked with nothing; fewer words
than a shingle make one shingle; rows with the same set are linked; rows with a null id take part
like others, but a null id only names a component without any id; an id used for several texts names
the component of each; repeated rows are linked with each other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdeck.llm.common import WORD, Scratch, arrow_rows, components, maybe_among, mix, ngram_hashes, rolling_hashes, split_by, word_hashes

SHINGLE = 5
SPLIT = 3
LEVELS = (1, 2, 8, 4096)
FLUSH = 300_000
LOCAL_HOT = 64
BUCKET_ITEMS = 1_000_000
BLOCK = 1024
TASK_ROWS = 8192
SLICE = 128  # members of a block compared at a time
_U = np.uint64
_SIG = 32  # bits of a signature in the shuffle; the label and the bucket add to them


def _band_edges() -> list[int]:
    edges = [1]
    while edges[-1] < 1 << 50:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 25 // 16)))
    return edges


EDGES = _band_edges()


def labels_of(size: int) -> list[tuple[int, int]]:
    """(label, k): the labels of a set of this size and how many shingles a linked set under it can differ in; none where k is 0."""
    band = bisect_right(EDGES, size) - 1
    out = []
    for label in (band, band + 1):
        if label > band and size * 5 // 4 < EDGES[label]:
            continue
        k = (size + min(EDGES[label + 1] - 1, size * 5 // 4)) // 9
        if k:
            out.append((label, k))
    return out


def partitions_of(label: int, level: int) -> int:
    """First-level partitions. Few shingles leave many of them empty, so small sets have one for each shingle."""
    largest = EDGES[label + 1] - 1
    half = largest // 9  # half of what the largest sets can differ in
    return (largest if largest <= 64 else half + half // 12 + 7) * LEVELS[level]


def lost(k: int, partitions: int) -> int:
    """Signatures that k differing shingles change at most: dealt to as many partitions as there are, ``SPLIT`` - 1 by the first in each."""
    return (SPLIT - 1) * min(k, partitions) + min(max(k - partitions, 0), partitions)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles of the A-Z lower-cased words."""
    h = word_hashes((text or "").encode().lower())
    return np.unique(rolling_hashes(h, k)[0] if len(h) >= k else ngram_hashes(h, k, short=True))


def set_id(s: np.ndarray) -> int:
    """Identity of a set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        x = mix(mix(s + _U(1)).sum(dtype=_U) + _U(len(s)) * _U(0x9E3779B97F4A7C15))
    return int(x.astype(np.int64))


def _part(s: np.ndarray, label: int, parts: int) -> np.ndarray:
    return ((mix(s ^ _U(0x5851F42D4C957F2D + label)) >> _U(32)) * _U(parts)) >> _U(32)


def _cells(s: np.ndarray, label: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The partitions, each shingle's place in (partition, part) of these, and how many shingles each subset of ``SPLIT`` - 1 parts holds,
    a subset being named by the part that it lacks."""
    partitions = partitions_of(label, level)
    cell = _part(s, label, SPLIT * partitions).astype(np.int64)
    if partitions <= 8 * len(s):
        partition = np.arange(partitions)
    else:  # many are empty and left out
        partition, at = np.unique(cell // SPLIT, return_inverse=True)
        cell = at * SPLIT + cell % SPLIT
    held = np.bincount(cell, minlength=len(partition) * SPLIT).reshape(-1, SPLIT)
    return partition, cell, held.sum(axis=1, keepdims=True) - held


def signatures(s: np.ndarray, label: int, level: int) -> np.ndarray:
    """One signature for each non-empty subset of ``SPLIT`` - 1 parts of a partition."""
    partition, cell, held = _cells(s, label, level)
    content = np.zeros(held.size, _U)
    np.add.at(content, cell, mix(s + _U(label)))
    content = content.reshape(-1, SPLIT)
    subset = content.sum(axis=1, keepdims=True, dtype=_U) - content
    name = (partition[:, None] * SPLIT + np.arange(SPLIT)).astype(_U) + (_U(label) << _U(40))
    some = held > 0
    return mix(subset[some] ^ mix(name[some]))


def _nodes(k: int):
    """Per row: id, row hash, set size, set identity, and its labels: the level of partitions that this set needs, and how many signatures it has there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, under = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), k)
                sizes.append(len(s))
                names.append(set_id(s) if len(s) else None)
                own = []
                for label, most in labels_of(len(s)) if len(s) else ():
                    level = 0
                    while (held := np.count_nonzero(_cells(s, label, level)[2])) - lost(most, partitions_of(label, level)) < 1:
                        level += 1
                    own.append({"label": label, "level": level, "held": held, "most": (SPLIT - 1) * len(s)})
                under.append(own)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
                pa.array(under, pa.list_(pa.struct([("label", pa.int32()), ("level", pa.int32()), ("held", pa.int64()), ("most", pa.int64())])))], names=["id", "row", "n", "node", "under"])
    return run


_DIRECT = np.dtype([("sig", "<u8"), ("node", "<i8"), ("label", "<u2"), ("need", "<u4")])


class _Spans:
    """The buckets of each label: ``many`` from ``first`` on."""

    def __init__(self, many: dict[int, int]):
        size = max(many, default=0) + 1
        self.many = np.ones(size, np.int64)
        for label, n in many.items():
            self.many[label] = n
        self.first = np.concatenate(([0], np.cumsum(self.many)))
        self.total = int(self.first[-1])

    def label(self, bucket: int) -> int:
        return int(np.searchsorted(self.first, bucket, "right")) - 1

    def whole(self, cut: np.ndarray, place: np.ndarray | int, label: np.ndarray | int) -> np.ndarray:
        """A signature from its bits in the shuffle, its place among the label's buckets and the label."""
        return (cut.astype(_U) * self.many[label].astype(_U) + np.asarray(place).astype(_U)) | np.asarray(label).astype(_U) << _U(56)


class _Sender:
    """Collects signatures of a task and packs them by bucket."""

    def __init__(self, spans: _Spans):
        self.spans = spans
        self.clear()

    def clear(self) -> None:
        self.seen: set[tuple[int, int]] = set()
        self.members: list[tuple[int, int, int]] = []
        self.sigs: list[np.ndarray] = []
        self.size = 0

    def add(self, node: int, label: int, need: int, sigs: np.ndarray) -> None:
        if (node, label) not in self.seen:
            self.seen.add((node, label))
            self.members.append((node, label, need))
            self.sigs.append(sigs)
            self.size += len(sigs)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, payload); bucket -1 holds entries already known to be shared."""
        if not self.members:
            return
        m = np.array(self.members, dtype=[("node", "<i8"), ("label", "<u2"), ("need", "<u4")])
        sig = np.concatenate(self.sigs)
        who = np.repeat(np.arange(len(m)), [len(x) for x in self.sigs])
        _, at, n = np.unique(sig, return_inverse=True, return_counts=True)
        hot = n[at] >= LOCAL_HOT
        if hot.any():
            i = np.flatnonzero(hot)
            i = i[np.argsort(sig[i], kind="stable")]
            v = sig[i]
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(np.concatenate(([True], v[1:] != v[:-1])), np.arange(len(i)), 0))
            settled = i[rank >= 2]  # the first two tell the others that it is shared
            d = np.zeros(len(settled), _DIRECT)
            d["sig"] = sig[settled]
            for c in ("node", "label", "need"):
                d[c] = m[c][who[settled]]
            yield -1, d.tobytes()
            keep = np.ones(len(sig), bool)
            keep[settled] = False
            sig, who = sig[keep], who[keep]
        many = self.spans.many[m["label"][who]].astype(_U)
        target = (sig % many).astype(np.int64) + self.spans.first[m["label"][who]]
        cut = (sig // many).astype(np.uint32)
        for bucket, i in split_by(target, self.spans.total):
            w, n = np.unique(who[i], return_counts=True)  # i is in order of who
            # columns: needs and counts are small numbers that compress to a byte or two a member
            small = pa.Codec("zstd").compress(b"".join((m["need"][w].astype("<u4").tobytes(), n.astype("<u4").tobytes())), asbytes=True)
            yield bucket, b"".join((np.array([len(w), len(small)], "<u4").tobytes(), small, m["node"][w].astype("<i8").tobytes(), cut[i].astype("<u4").tobytes()))
        self.clear()


def _send(k: int, spans: _Spans, finer: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(spans)

        def flush():
            rows = list(out.flush())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())],
                                                 names=["bucket", "payload"])
        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), k)
                node = None
                for label, most in labels_of(len(s)) if len(s) else ():
                    level = finer.get(label, 0)
                    sig = signatures(s, label, level)
                    node = set_id(s) if node is None else node
                    out.add(node, label, len(sig) - lost(most, partitions_of(label, level)), sig)
                if out.size >= FLUSH:
                    yield from flush()
        yield from flush()
    return run


_SHARED = "sig long, node long, label int, need int"


def _rows(sig, node, label, need) -> pa.Table:
    return pa.table({"sig": pa.array(sig.astype(np.int64)), "node": pa.array(node.astype(np.int64)),
                     "label": pa.array(label.astype(np.int32)), "need": pa.array(need.astype(np.int32))})


def _settle(spans: _Spans):
    """The entries of one bucket whose signature occurs in two classes."""
    def run(t: pa.Table) -> pa.Table:
        sig, who, node, need, members = [], [], [], [], 0
        for x in t.column("payload"):
            x = x.as_buffer()
            n, packed = (int(v) for v in np.frombuffer(x, "<u4", 2))
            small = pa.Codec("zstd").decompress(x.slice(8, packed), 8 * n, asbytes=True)
            need.append(np.frombuffer(small, "<u4", n))
            each = np.frombuffer(small, "<u4", n, 4 * n)
            node.append(np.frombuffer(x, "<i8", n, 8 + packed))
            sig.append(np.frombuffer(x, "<u4", int(each.sum()), 8 + packed + 8 * n))
            who.append(np.repeat(np.arange(members, members + n, dtype=np.uint32), each))
            members += n
        sig, who, node, need = (np.concatenate(x) for x in (sig, who, node, need))
        order = np.argsort(sig, kind="stable")
        v = sig[order]
        pair = np.concatenate((v[1:] == v[:-1], [False]))
        some = order[pair | np.concatenate(([False], pair[:-1]))]
        del order, v, pair
        sig, who = sig[some], who[some]
        order = np.lexsort((node[who], sig))
        sig, who = sig[order], who[order]
        one = node[who]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (one[1:] != one[:-1]))) if len(sig) else np.zeros(0, bool)
        sig, who = sig[new], who[new]
        pair = np.concatenate((sig[1:] == sig[:-1], [False])) if len(sig) else np.zeros(0, bool)
        keep = pair | np.concatenate(([False], pair[:-1])) if len(sig) else pair
        sig, who = sig[keep], who[keep]
        bucket = t.column("bucket")[0].as_py()
        label = spans.label(bucket)
        return _rows(spans.whole(sig, bucket - int(spans.first[label]), label), node[who], np.full(len(who), label), need[who])
    return run


def _direct(spans: _Spans):
    """Rows of the entries settled in their task, with signatures cut like those of the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                d = np.frombuffer(x, _DIRECT)
                many = spans.many[d["label"]].astype(_U)
                cut = (d["sig"] // many) & _U((1 << _SIG) - 1)
                yield from _rows(spans.whole(cut, d["sig"] % many, d["label"]), d["node"], d["label"], d["need"]).to_batches()
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of a task give one set
        for b in batches:
            sets = []
            for t in b.column(0):
                x = shingles(t.as_py(), k)
                if len(x) and (name := set_id(x)) not in seen:
                    seen.add(name)
                    sets.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                                             names=["node", "items"])
    return run


def sketch(s: np.ndarray, label: int) -> bytes:
    """Parity bits: every shingle flips one bit, so two sketches of a label differ in at most as many bits as the sets in shingles."""
    bits = 2 * (EDGES[label + 1] - 1) // 64 * 64 + 64
    flips = np.bincount((mix(s ^ _U(0x94D049BB)) % _U(bits)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(node, label, len(s), sketch(s, label)) for node, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for s in [np.frombuffer(x, _U)] for label, _ in labels_of(len(s))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                                         names=["node", "label", "n", "sketch"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, m, x, n, y) whose sizes m, n and sketches x, y allow a link."""
    for b in batches:
        m, n = (b.column(c).to_numpy() for c in (2, 4))
        differ = np.array([np.bitwise_count(np.frombuffer(x.as_py(), _U) ^ np.frombuffer(y.as_py(), _U)).sum()
                           for x, y in zip(b.column(3), b.column(5), strict=True)], np.int64)
        keep = (5 * np.minimum(m, n) >= 4 * np.maximum(m, n)) & (differ <= (m + n) // 9)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, x, y) of sets that are linked."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            both = int((x[at] == y).sum())
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _asked(sets: DataFrame, pairs: DataFrame, col: str) -> DataFrame:
    """The sets named in a column of the pairs, and a few others by chance: only these are shuffled."""
    keys = pairs.select(col).distinct()
    return maybe_among(sets, "node", keys, col, "_hit", keys.count()).filter("_hit").select(F.col("node").alias(col), "items")


def _allowed(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs that may be linked, from (a, b, label) with a label that both sets have: only their texts are compared."""
    x = bits.select(F.col("node").alias("a"), "label", F.col("n").alias("m"), F.col("sketch").alias("x"))
    y = bits.select(F.col("node").alias("b"), "label", "n", F.col("sketch").alias("y"))
    return pairs.join(x, ["a", "label"]).join(y, ["b", "label"]).select("a", "b", "m", "x", "n", "y").mapInArrow(_near, "a long, b long")


def _one_of_equal(groups: DataFrame) -> DataFrame:
    """(sig, _blocks): of the groups that hold the same members under one label, one. Identities are hashes, so their number and the sums
    of their halves name the members; a member may be in a group twice, which sums, unlike parities, keep apart."""
    return (groups.groupBy(F.shiftrightunsigned("sig", 56), "_lo", "_hi", "_members", "_x", "_y").agg(F.min("sig").alias("sig"))
            .select("sig", F.ceil(F.col("_members") / BLOCK).alias("_blocks")))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = _asked(sets, pairs, "a").withColumnRenamed("items", "x")
    y = _asked(sets, pairs, "b").withColumnRenamed("items", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


def _cross(t: pa.Table) -> pa.Table:
    """Pairs of different components in two blocks of a group whose sizes and sketches allow a link.
    A pair is looked at under one label only, the band of its larger set."""
    t = t.combine_chunks()
    col = lambda c: t.column(c).to_numpy()
    sig, bx, by = col("sig"), col("bx"), col("by")
    order = np.lexsort((by, bx, sig))
    key = np.stack((sig, bx, by))[:, order]
    turn = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    node, comp, n, label, block = (col(c) for c in ("node", "comp", "n", "label", "block"))
    sketches = t.column("sketch").to_pylist()
    found = []
    for u in np.split(order, turn):
        first, right = u[block[u] == bx[u[0]]], u[block[u] == by[u[0]]]
        if not len(first) or not len(right):
            continue
        q = np.frombuffer(b"".join(sketches[k] for k in right), _U).reshape(len(right), -1)
        for at in range(0, len(first), SLICE):
            left = first[at:at + SLICE]
            x, y = n[left][:, None], n[right][None, :]
            ok = ((comp[left][:, None] != comp[right][None, :]) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y))
                  & (np.maximum(x, y) >= EDGES[label[u[0]]]))
            if bx[u[0]] == by[u[0]]:
                ok &= node[left][:, None] < node[right][None, :]
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            p = np.frombuffer(b"".join(sketches[k] for k in left), _U).reshape(len(left), -1)
            most = (n[left[i]] + n[right[j]]) // 9
            for c in range(0, len(i), 8192):  # the sketches bound the difference from below
                d = slice(c, c + 8192)
                near = np.flatnonzero(np.bitwise_count(p[i[d]] ^ q[j[d]]).sum(axis=1) <= most[d]) + c
                if len(near):
                    found.append(np.stack((node[left[i[near]]], node[right[j[near]]])))
    pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


def _row(id_col: str, text_col: str) -> Column:
    """Identity of a row's id and text; rows without id are told apart by their text."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def _members(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per document: id, row, n, name (least id reachable by links) and the row hash of the document that names the component; a null id comes last."""
    spark = docs.sparkSession
    s = Scratch(spark, "jaccard")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _row(id_col, text_col).alias("row"))
    kind = docs.schema[id_col].dataType.simpleString()
    with arrow_rows(spark, 500):
        nodes = s.write(src.mapInArrow(_nodes(k), f"id {kind}, row long, n long, node long, under array<struct<label:int,level:int,held:long,most:long>>"), "nodes")
        bands = nodes.select(F.explode("under").alias("u")).groupBy("u.label").agg(F.max("u.level"), F.sum("u.held"), F.sum("u.most")).collect()  # one row per band at most
        finer = {label: level for label, level, _, _ in bands}
        # more partitions than a set needs give it more signatures, but a shingle is in SPLIT - 1 of them at most
        spans = _Spans({label: -(-min(held * LEVELS[level], most) // BUCKET_ITEMS) for label, level, held, most in bands})
        sent = s.write(src.select("text").mapInArrow(_send(k, spans, finer), "bucket long, payload binary"), "sent", "uncompressed")
    with arrow_rows(spark, 20):
        # a bucket's entries are distinct; what tasks settled themselves may be met in several tasks. An entry in both only
        # raises a member's count or a group's size, which rule nothing out
        settled = sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(_settle(spans), _SHARED)
        direct = sent.filter("bucket < 0").select("payload").mapInArrow(_direct(spans), _SHARED)
        shared = s.write(settled.unionByName(direct.groupBy("sig", "node", "label").agg(F.max("need").alias("need"))), "shared")
    s.drop("sent")
    # members with too few shared signatures leave, but for chance hits of the bitmap, then signatures with one member; a group's
    # size and centre come along
    member = F.xxhash64("node", "label").alias("_member")
    enough = s.write(shared.groupBy(member).agg(F.count("*").alias("_n"), F.max("need").alias("_need")).filter("_n >= _need").select("_member"), "enough")
    left = maybe_among(shared.withColumn("_member", member), "_member", enough, "_member", "_hit", enough.count()).filter("_hit").drop("_member", "_hit")
    first = F.min(F.struct(F.xxhash64("node").alias("_h"), "node"))
    alive = left.groupBy("sig").agg(F.count("*").alias("size"), first.alias("_first")).filter("size > 1")
    members = s.write(left.join(alive, "sig").select("sig", "node", "label", "need", "size", F.col("_first.node").alias("centre")), "members")
    for table in ("shared", "enough"):
        s.drop(table)

    # labels are ordered by the least id, a null one last; row and node tell classes with one id apart
    classes = (nodes.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "row")).alias("_least"), F.first("n").alias("n"))
               .select("node", F.struct("_least.missing", "_least.id", "_least.row", "node").alias("label"), "n"))
    active = s.write(classes.join(members.select("node").distinct(), "node"), "active")
    sizes = active.select("node", "n")
    # the texts of the classes' rows are read again; chance hits of the bitmap are sets that nothing asks for
    rows = active.select(F.col("label.row").alias("row"))
    near = maybe_among(src.select("row", "text"), "row", rows, "row", "_hit", active.count()).filter("_hit")
    with arrow_rows(spark, 500):
        sets = s.write(near.select("text").mapInArrow(_sets(k), "node long, items binary"), "sets-read", "uncompressed")
    # only sets met in several tasks (rows repeated with their id) are shuffled
    twice = s.write(sets.groupBy("node").count().filter("count > 1").select("node"), "sets-twice")
    repeated = sets.join(twice, "node", "left_semi").dropDuplicates(["node"]) if twice.limit(1).count() else None
    if repeated is not None:
        sets = s.write(sets.join(twice, "node", "left_anti").unionByName(repeated), "sets")
        s.drop("sets-read")
    s.drop("sets-twice")

    # step 1: each member with the centre of its group
    with arrow_rows(spark, 500):
        bits = s.write(sets.mapInArrow(_sketches, "node long, label int, n long, sketch binary"), "sketches", "uncompressed")
        met = members.filter("node != centre").groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.min("label").alias("label"))
        stars = s.write(_allowed(met, bits), "stars")
        links = s.write(_verify(stars, sets), "links-1")
    s.drop("stars")
    comps = components(active.select("node", "label"), links, s, "first")
    s.drop("links-1")

    # step 2: what is left between components. A linked pair has ``need`` common signatures from either side, so it
    # meets in one of the first (count - need + 1) of each member's signatures, rarest first
    mine = Window.partitionBy("node", "label")
    known = comps.select("node", F.col("label.node").alias("comp")).join(sizes, "node")
    placed = s.write(members.drop("centre").join(known, "node")  # dealt by node, as the windows need it
                     .withColumn("_rank", F.row_number().over(mine.orderBy("size", "sig"))).withColumn("_count", F.count("*").over(mine)), "placed")
    s.drop("members")
    probes = placed.filter("_rank <= _count - need + 1").select("sig", "node", "label", "comp", "n")
    groups = (probes.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_members"),
                                        F.expr("sum(node & 4294967295L)").alias("_x"), F.expr("sum(shiftrightunsigned(node, 32))").alias("_y")).filter("_lo < _hi"))
    mixed = s.write(_one_of_equal(groups), "mixed")
    # chance hits of the bitmap leave in the join
    probes = maybe_among(probes, "sig", mixed, "sig", "_hit", mixed.count()).filter("_hit")
    open_ = s.write(probes.join(mixed, "sig").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
                    .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
                    .select("sig", "node", "label", "comp", "n", "block", F.least("block", "_other").alias("bx"), F.greatest("block", "_other").alias("by")), "open")
    for table in ("placed", "mixed"):
        s.drop(table)
    many = max(1, -(-open_.count() // TASK_ROWS))
    open_ = open_.join(bits.drop("n"), ["node", "label"]).withColumn("_task", F.pmod(F.xxhash64("sig", "bx", "by"), F.lit(many)))
    with arrow_rows(spark, 500):
        rest = s.write(open_.groupBy("_task").applyInArrow(_cross, "a long, b long").distinct(), "rest")
        more = s.write(_verify(rest, sets), "links-2")
    # a link joins the whole components of its ends, so it runs between the classes that name these
    named = comps.select("node", F.col("label.node").alias("_named"))
    across = (more.join(named.select(F.col("node").alias("a"), F.col("_named").alias("_a")), "a").join(named.select(F.col("node").alias("b"), F.col("_named").alias("_b")), "b")
              .select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    merged = components(comps.filter("node = label.node"), across, s, "second")
    final = named.join(merged.select(F.col("node").alias("_named"), "label"), "_named").select("node", "label")
    for table in ("sets-read", "sets", "sketches", "open", "rest"):
        s.drop(table)
    rows = (nodes.select("id", "row", "n", "node").join(classes.select("node", F.col("label").alias("_least")), "node", "left")
             .join(final.withColumnRenamed("label", "_final"), "node", "left").withColumn("_label", F.coalesce("_final", "_least")))
    return rows.select("id", "row", "n", F.coalesce("_label.id", "id").alias("name"), F.col("_label.row").alias("first"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Per document: id, n_shingles, component_id (least id reachable by links)."""
    return _members(docs, id_col, text_col, k).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """The documents without near copies: of each component the document that names it stays, with all columns.
    Rows are judged by id and text: repeated rows with the same id and text stay together; of equal
    texts without id any one stays. Texts without words all stay."""
    s = Scratch(docs.sparkSession, "one-of-each")
    drop = s.write(_members(docs, id_col, text_col, k).filter("row != first").select(F.col("row").alias("_jc_row")).distinct(), "drop")
    keyed = docs.withColumn("_jc_row", _row(id_col, text_col))
    nameless = F.col(id_col).isNull() & F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False))
    left = keyed.filter(~nameless).unionByName(keyed.filter(nameless).dropDuplicates(["_jc_row"]))
    # rows that no bitmap bit names stay where they are; the exact join sees the others
    left = maybe_among(left, "_jc_row", drop, "_jc_row", "_jc_hit", drop.count())
    gone = left.filter("_jc_hit").join(drop, "_jc_row", "left_anti")
    return left.filter("NOT _jc_hit").select(*docs.columns).unionByName(gone.select(*docs.columns))
