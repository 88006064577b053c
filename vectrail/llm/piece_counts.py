"""Token counts by a linear longest-match automaton over a vocabulary.

A word (a run of characters without white space, with one space before it) is cut greedily: from its
start the longest vocabulary entry, then from its end again. The trie of the entries has, for each node,
a failure link to the node that holds what remains after the entries that greedy matching pops there,
and the number of entries popped. With links followed ahead of time, a word costs one table step for
each byte, and its length in pieces is the sum of popped counts; no piece is ever built. Every single
byte is an entry, so each word has a cut. Words of a batch walk the automaton side by side.

Defined results: a null text counts as empty, with no words and no pieces; white space is the six ASCII
characters 09-0D and 20; texts are counted whole; equal rows give equal results; other columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import common
from vectrail.llm.byte_bpe import load_ranks

#: Bits of a table entry that hold the next node; those above hold the pieces popped on the way.
NODE_BITS = 20


class Automaton:
    def __init__(self, entries: list[bytes]):
        children: list[dict[int, int]] = [{}]
        depth, final = [0], [False]
        for entry in entries:
            v = 0
            for b in entry:
                if b not in children[v]:
                    children[v][b] = len(children)
                    children.append({})
                    depth.append(depth[v] + 1)
                    final.append(False)
                v = children[v][b]
            final[v] = True
        if len(children) >= 1 << NODE_BITS or any(not final[children[0].get(b, 0)] for b in range(256)):
            raise ValueError("the vocabulary is too large, or has no entry for some byte")
        n = len(children)
        #: Table rows: entry b is the node after byte b, and the pieces that this step pops.
        self.step = np.zeros((n, 256), dtype=np.int32)
        #: Pieces in the greedy cut of a node's own string.
        self.rest = np.zeros(n, dtype=np.int32)
        self.step[0] = [children[0][b] for b in range(256)]
        by_depth: dict[int, list[tuple[int, int, int]]] = {}
        for v in range(n):
            for b, c in children[v].items():
                by_depth.setdefault(depth[c], []).append((c, v, b))
        fail, popped, ends = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.array(final)
        mask = (1 << NODE_BITS) - 1
        for d in range(1, max(by_depth, default=0) + 1):
            node, parent, byte = (np.array(x) for x in zip(*by_depth[d]))
            # A whole entry pops as itself; otherwise the parent's pops come first, then those of the step from its link.
            way = self.step[fail[parent], byte] if d > 1 else np.zeros(len(node), dtype=np.int32)
            fail[node] = np.where(ends[node], 0, way & mask)
            popped[node] = np.where(ends[node], 1, popped[parent] + (way >> NODE_BITS))
            self.rest[node] = popped[node] + self.rest[fail[node]]
            self.step[node] = self.step[fail[node]] + (popped[node] << NODE_BITS)[:, None].astype(np.int32)
            inner = [(v, b, c) for v in node.tolist() for b, c in children[v].items()]
            if inner:
                v, b, c = (np.array(x) for x in zip(*inner))
                self.step[v, b] = c

    def lengths(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces in each of the byte strings data[start : start + size]."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state, count = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        flat, mask = self.step.ravel(), (1 << NODE_BITS) - 1
        live = len(order)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= k:
                live = int(np.searchsorted(-sizes, -k, side="left"))
            got = flat[(state[:live] << 8) + data[starts[:live] + k]]
            state[:live] = got & mask
            count[:live] += got >> NODE_BITS
        out = np.empty_like(count)
        out[order] = count + self.rest[state]
        return out


@functools.lru_cache(maxsize=1)
def automaton(path: str) -> Automaton:
    return Automaton(list(load_ranks(path)))


def count(machine: Automaton, run: list[str]) -> list[tuple[int, int, int]]:
    """Words, pieces, and pieces of the longest word, for each text."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in run]
    words = np.array(list(map(len, split)))
    data = np.frombuffer(b"".join(b" " + b" ".join(s) for s in split if s), dtype=np.uint8)
    starts = np.nonzero(data == 32)[0]
    pieces = machine.lengths(data, starts, np.diff(np.r_[starts, len(data)]))
    ends = np.cumsum(words)
    sums = np.r_[0, np.cumsum(pieces)]
    out = []
    for n, e in zip(words.tolist(), ends.tolist()):
        out.append((n, int(sums[e] - sums[e - n]), int(pieces[e - n : e].max()) if n else 0))
    return out


def piece_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces, most_pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for part in common.texts(b.column(1), 4_000_000) for r in count(automaton(path), part)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=["doc_id", "n_words", "n_pieces", "most_pieces"])

    return common.spread(docs.select(F.col("doc_id").cast("long"), text)).mapInArrow(run, "doc_id bigint, n_words bigint, n_pieces bigint, most_pieces bigint")


def op4_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
