"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First come the pairs whose fingerprints (the majority bits of those shingles) differ in two bits or fewer, joined
on the Golay-code keys of simhash and verified. Fingerprints of near copies may differ in more bits, so prefix
filtering finds the rest and loses no pair: with all shingles in one order, two sets of that similarity
share a shingle among the first n - ceil(0.8 n) + 1 of each. The order puts common shingles last, as far as
a sample of documents shows them; the sample and COMMON decide how many pairs are compared, not which are
found. Pairs that meet at a shingle are held against bounds from their sizes and places, and what is left
is verified by the intersection of the whole sets. Equal sets are one node throughout.

Only shingles that two prefixes hold are sent to the join: a first pass counts bare hashes, and a table of
bits lets the second pass leave out most others. Only components are wanted, and nodes of one component are not compared again. Of the nodes at one shingle, all are first compared with one leader; then only
nodes of different components are paired off, so a large family of copies makes few pairs.

Defined results: words and case as in simhash; fewer than five words are one shingle; null texts and texts
without words are equal; shingles are compared by 64-bit hashes; rows are told apart by doc_id and text, so
several texts may share a doc_id; a component is named by its smallest doc_id (and hash of the text); rows
without doc_id have no component and are kept; of rows that are equal in doc_id and text one is kept; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm import common, simhash
from vectrail.llm.components import components

WORDS, SEED = 5, 42
#: Similarity of near copies, as a fraction.
ALIKE, OF = 4, 5
#: One document of so many shows which shingles are common, and so many of those at most are put last.
SAMPLE, COMMON = 8, 1 << 17
#: Places in the table of shared shingles, for each and at most (128 MB).
BITS_EACH, BITS = 16, 1 << 30
#: Rounds with leaders before nodes are paired off.
ROUNDS = 2


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles, each once, in the order of their unsigned values."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), dtype=np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.zeros(0, dtype=np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def named(docs: DataFrame) -> DataFrame:
    """node (doc_id and a hash of the text) and text of each row."""
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of")).alias("node"), "text")


NODE = "struct<doc_id:bigint,of:bigint>"


def sets(rows: DataFrame) -> DataFrame:
    """node, s: the shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for b in batches for x in common.parts(b, 1)):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(t) for t in texts])], names=["node", "s"])

    return common.spread(rows).mapInArrow(lambda x: common.giving_back(run(x)), f"node {NODE}, s array<bigint>")


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and how often each is held in the sample."""
    some = sets(rows.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)).select(F.explode("s").alias("h"))
    held = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = np.asarray(held["h"]).astype(np.int64).view(np.uint64), np.asarray(held["n"]).astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


class Prefixes:
    """The shingles that a set of near copies must share one of: all but so many of the commonest, the rarest first."""

    def __init__(self, often: np.ndarray, times: np.ndarray):
        self.often, self.times = often, times

    def of(self, s: np.ndarray) -> np.ndarray:
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, s), len(self.often) - 1)
            s = s[np.argsort(np.where(self.often[at] == s, self.times[at], 0), kind="stable")]
        return s[: len(s) + (-ALIKE * len(s)) // OF + 1]


def shared_keys(rows: DataFrame, prefix) -> np.ndarray:
    """A table of truth values, as many as a power of two: whether a shingle with this remainder stands in two prefixes.

    It has BITS_EACH places for each such shingle, BITS at most; where that is too few, more rows pass and no pair is lost."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in (x for b in batches for x in common.parts(b, 1)):
            found = [prefix.value.of(shingles(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64))], names=["key"])

    keys = common.spread(rows).mapInArrow(lambda x: common.giving_back(run(x)), "key bigint").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    path = common.written(keys, "near-shared")
    keys = common.reread(spark, path)
    size = 1 << 16
    while size < min(BITS, BITS_EACH * keys.count()):
        size *= 2
    at = F.col("key").bitwiseAND(F.lit(size - 1))
    word = F.shiftright(at, 6).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")))
    words = keys.groupBy(word.alias("w")).agg(bits.alias("bits")).toArrow()  # BITS / 64 rows at most
    table = np.zeros(size // 64, dtype="<i8")
    table[np.asarray(words["w"]).astype(np.int64)] = np.asarray(words["bits"]).astype(np.int64)
    common.dropped(spark, path)
    return table.view(np.uint8)


def held_in(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    at = s & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def prefixes(rows: DataFrame) -> DataFrame:
    """node, sig (of the whole set), fp (fingerprint), n (shingles), s and at: those of the prefix that others may share, and their places in it."""
    spark = rows.sparkSession
    prefix = spark.sparkContext.broadcast(Prefixes(*common_shingles(rows)))
    table = spark.sparkContext.broadcast(shared_keys(rows, prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for b in batches for x in common.parts(b, 1)):
            each = [shingles(t) for t in texts]
            sig = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in each], pa.binary())
            fp = pa.array(np.array([simhash.majority(s) for s in each], dtype=np.uint64).view(np.int64))
            first = [prefix.value.of(s) for s in each]
            at = [np.nonzero(held_in(table.value, s))[0] for s in first]
            columns = [part.column(0), sig, fp, pa.array([len(s) for s in each], pa.int32()), _lists([s[i] for s, i in zip(first, at)]), _lists([i.view(np.uint64) for i in at])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "sig", "fp", "n", "s", "at"])

    return common.spread(rows).mapInArrow(lambda x: common.giving_back(run(x)), f"node {NODE}, sig binary, fp bigint, n int, s array<bigint>, at array<bigint>")


def _can_match(x: str, y: str) -> Column:
    """Sizes and places of a shared shingle leave room for the similarity."""
    nx, ny, px, py = (F.col(f"{t}.{c}") for c in ("n", "at") for t in (x, y))
    most = F.least(px, py) + 1 + F.least(nx - px, ny - py) - 1
    return (F.least(nx, ny) * OF >= F.greatest(nx, ny) * ALIKE) & (most * (ALIKE + OF) >= (nx + ny) * ALIKE)


def enough(met: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes with so many shingles (na, nb) that share as many shingles of their prefixes as
    near copies must. Of the prefixes, let one end before the other: what two sets share outside of both stands behind
    that end, so it is no more than the sets hold behind their prefixes."""
    most = lambda n: F.ceil(n * ALIKE / OF) - 1  # noqa: E731  shingles behind a prefix
    both = F.ceil((F.col("na") + F.col("nb")) * ALIKE / (ALIKE + OF))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return counted.where(F.col("c") >= both - F.greatest(most(F.col("na")), most(F.col("nb")))).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are near copies."""
    pairs = common.stored(pairs, "near-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    held = common.stored(sets(rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])), "near-sets")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(same * OF >= (F.size("x") + F.size("y") - same) * ALIKE).select("a", "b")


def by_fingerprint(distinct: DataFrame) -> DataFrame:
    """a, b: pairs of nodes to verify, whose fingerprints differ in few bits. distinct: node, fp."""
    first = common.stored(distinct.groupBy("fp").agg(F.min("node").alias("node")), "near-fingerprints")
    equal = distinct.select("fp", F.col("node").alias("b")).join(first, "fp").where("node < b").select(F.col("node").alias("a"), "b")
    return equal.unionByName(simhash.links(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def links(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: nodes that are near copies, enough of them to hold every component together. distinct: node, fp, n, s, at."""
    found = common.stored(verified(by_fingerprint(distinct), texts), "near-links")
    rows = distinct.select("node", "n", F.explode(F.arrays_zip("at", "s")).alias("x")).select("node", "n", "x.at", F.col("x.s").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    rows = rows.join(shared, "key")
    for k in range(ROUNDS + 1):
        known = components(found).select("node", "component")
        rows = rows.drop("component").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_keys = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
        rows = common.stored(rows.join(open_keys, "key"), "near-keys")
        if k < ROUNDS:
            first = F.min_by(F.struct("node", "n", "at", "component"), F.struct(F.xxhash64("node", F.lit(k)), "node"))
            other = rows.groupBy("key").agg(first.alias("l")).select("key", "l.*")
        else:
            other = rows
        x, y = rows.alias("x"), other.alias("y")
        once = F.col("x.node") < F.col("y.node") if k == ROUNDS else F.col("x.node") != F.col("y.node")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & once & (F.col("x.component") != F.col("y.component")) & _can_match("x", "y"))
        low = F.col("x.node") < F.col("y.node")
        pick = lambda c, first: F.when(low == first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
        met = met.select("x.key", pick("node", True).alias("a"), pick("node", False).alias("b"), pick("n", True).alias("na"), pick("n", False).alias("nb"))
        pairs = enough(met.distinct() if k < ROUNDS else met)  # a leader meets another leader from both sides
        found = common.stored(found.unionByName(verified(pairs, texts)), "near-links")
    return found


def classes(docs: DataFrame) -> DataFrame:
    """node (doc_id, of) and first (the node that names its component; null without doc_id) for each row."""
    rows = named(docs)
    held = common.stored(prefixes(rows), "near-prefixes")
    one = F.min(F.struct("node", "fp", "n", "s", "at")).alias("x")  # rows of one set differ in the node alone
    distinct = held.where("node.doc_id is not null").groupBy("sig").agg(one).select("sig", "x.*")
    distinct = common.stored(distinct, "near-nodes")
    found = components(links(distinct, rows.where("node.doc_id is not null")))
    by_sig = distinct.join(found, "node", "left").select("sig", F.coalesce("component", "node").alias("first"))
    out = held.select("node", "sig").join(by_sig, "sig", "left")
    return out.select("node", F.when(F.col("node.doc_id").isNotNull(), F.col("first")).alias("first"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their component, and those without doc_id."""
    found = common.stored(classes(docs), "near-classes")
    key = [common.unused(docs, n) for n in ("gone_doc", "gone_of")]
    gone = found.where("node != first").select("node.doc_id", "node.of").distinct().toDF(*key)
    kept = docs.join(gone, (docs["doc_id"] == gone[key[0]]) & (F.xxhash64(docs["text"]) == gone[key[1]]), "left_anti")
    if not found.where("first is not null").groupBy("node").count().where("count > 1").isEmpty():
        once = kept.where("doc_id is not null").withColumn(key[1], F.xxhash64("text")).dropDuplicates(["doc_id", key[1]]).drop(key[1])
        kept = once.unionByName(kept.where("doc_id is null"))
    return kept
