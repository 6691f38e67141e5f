"""Operator 10, token counts: linear longest-match automaton.

Greedy word pieces: each white-space separated word, written as one space plus
its UTF-8 bytes, is cut from the left into the longest vocabulary pieces. The
vocabulary becomes a byte trie in which every node v stores, for the moment
no child fits, how many pieces are popped (``pops``) and where matching goes on
(``fail``): the node spelled by what is left of v's text after those pieces. A
word is then counted in one pass over its bytes, without building pieces or
reading a byte twice.

The vocabulary (a tiktoken rank file holding all 256 single bytes) is read once on
the driver; its path is a parameter. The automaton grows with the vocabulary,
not with the data, and is broadcast. Words met before in a task are looked up
in a bounded cache.

Defined cases: null or empty texts and texts of white space have no tokens;
repeated rows are counted alike; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_CACHE = 1 << 18
_CACHED_BYTES = 64


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links and popped-piece counts over a byte vocabulary."""

    def __init__(self, pieces: list[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for p in pieces:
            v = 0
            for b in p:
                if b not in child[v]:
                    child[v][b] = len(child)
                    child.append({})
                    final.append(False)
                v = child[v][b]
            final[v] = v != 0
        missing = [b for b in range(256) if b not in child[0] or not final[child[0][b]]]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        n = len(child)
        pops, fail = [0] * n, [-1] * n
        queue = deque([0])
        while queue:  # parents first: a node's link follows from its parent's
            u = queue.popleft()
            for b, v in child[u].items():
                queue.append(v)
                if final[v]:  # the whole text of v is a piece
                    pops[v], fail[v] = 1, 0
                    continue
                w, popped = fail[u], pops[u]
                while w >= 0 and b not in child[w]:
                    popped += pops[w]
                    w = fail[w]
                # u's text is popped piece by piece until b can follow what is left
                pops[v], fail[v] = popped, child[w][b]
        self.child, self.pops, self.fail = child, pops, fail

    def count(self, data: bytes) -> int:
        """Number of greedy longest-match pieces of ``data``."""
        child, pops, fail = self.child, self.pops, self.fail
        v = n = 0
        for b in data:
            while (w := child[v].get(b, -1)) < 0:
                n += pops[v]
                v = fail[v]
            v = w
        while v:
            n += pops[v]
            v = fail[v]
        return n


class _Words(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        n = self.count(b" " + word)
        if len(word) <= _CACHED_BYTES:  # long words are counted anew, so the cache is bounded in bytes as well
            self[word] = n
        return n


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | list[bytes] = VOCABULARY) -> DataFrame:
    """Per document: id, n_words, n_tokens (long)."""
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(shared.value)
        for b in batches:
            n_words, n_tokens = [], []
            for t in b.column(1):
                words = (t.as_py() or "").encode().split()
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             names=["_id", "n_words", "n_tokens"])

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, n_words long, n_tokens long").withColumnRenamed("_id", id_col)
