"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint has 64 bits in three segments. Of two differing bits at most, some segment is free, and
the segment after it or the one before it has one error at most; over the three cyclic pairs (free,
tolerant) one always fits. A key is the free segment's value with a codeword index of the perfect
binary Golay code [23, 12, 7] for the tolerant one. A word within two errors of its codeword gives that
codeword's index; a word at three errors gives the six codewords within four. Two words at distance one
then always share an index, so equal keys hold every linked pair, and the pairs are verified by counting
bits. Equal fingerprints are one row throughout.

A key that more than HOT distinct fingerprints share is not paired off: its fingerprints meet at the 65
values within one bit of each, which two fingerprints share exactly if they differ in two bits or fewer.
All that meet at a value are linked to the least of them, so no key makes pairs in the square of its rows.

Defined results: a text that is null or has no words has fingerprint zero and links like any other;
fewer than three words are one shingle; texts are hashed whole; a component is named by its smallest
doc_id; repeated rows keep one row each; rows without doc_id have no component; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm import common
from vectrail.llm.components import components

SHINGLE, SEED, ERRORS, HOT = 3, 42, 2, 32
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t) for part in common.texts(b.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return common.spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), text)).mapInArrow(run, "doc_id bigint, fp bigint")


@functools.lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and for each syndrome the error patterns
    that lead to nearby codewords: the leader, and with a leader of three errors the five of four."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [remainder(1 << i) for i in range(23)]
    table = np.zeros((1 << 11, 6), dtype=np.int64)
    filled = np.zeros(1 << 11, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = functools.reduce(int.__xor__, (unit[i] for i in bits), 0)
            if weight < 4 or filled[syndrome] and int(table[syndrome, 0]).bit_count() == 3:
                table[syndrome, filled[syndrome]] = sum(1 << i for i in bits)
                filled[syndrome] += 1
    table[filled == 1] = table[filled == 1, :1]
    low = np.array([functools.reduce(int.__xor__, (unit[i] for i in range(12) if w >> i & 1), 0) for w in range(1 << 12)])
    high = np.array([functools.reduce(int.__xor__, (unit[12 + i] for i in range(11) if w >> i & 1), 0) for w in range(1 << 11)])
    return low, high, table


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Six codeword indices of each 23-bit word; all the same where one is enough."""
    low, high, table = golay()
    return (words[:, None] ^ table[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for every key of each fingerprint, each once."""
    unsigned = fps.view(np.uint64)
    parts = [(unsigned >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    owner, keys = [], []
    for i in range(3):
        index = codeword_indices(parts[(i + 1) % 3])
        key = (i << 34 | parts[i] << 12)[:, None] | index
        new = np.ones_like(key, dtype=bool)
        new[:, 1:] = index[:, 1:] != index[:, :1]
        owner.append(np.nonzero(new)[0])
        keys.append(key[new])
    return np.concatenate(owner), np.concatenate(keys)


def with_keys(distinct: DataFrame) -> DataFrame:
    """key, fp, node for each key of each distinct fingerprint."""
    kind = distinct.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, keys = keys_of(np.asarray(b.column("fp")))
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("fp").take(at), b.column("node").take(at)], names=["key", "fp", "node"])

    return distinct.mapInArrow(run, f"key bigint, fp bigint, node {kind}")


def with_ball(hot: DataFrame) -> DataFrame:
    """value, node for the 65 values within one bit of each fingerprint."""
    kind = hot.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
        for b in batches:
            values = (np.asarray(b.column("fp")).view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), b.column("node").take(pa.array(np.repeat(np.arange(b.num_rows), 65)))], names=["value", "node"])

    return hot.mapInArrow(run, f"value bigint, node {kind}")


def links(distinct: DataFrame) -> DataFrame:
    """a, b: nodes (of any type with an order) of fingerprints (fp) that differ in two bits or fewer, enough of them to hold every component together."""
    keys = common.stored(with_keys(distinct), "golay-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keys = common.stored(keys.join(shared, "key"), "golay-shared")
    few = keys.where(F.col("n") <= HOT)
    x, y = few.alias("x"), few.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= ERRORS)
    pairs = x.join(y, near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    hot = keys.where(F.col("n") > HOT).select("fp", "node").distinct()
    met = with_ball(hot).withColumn("m", F.min("node").over(Window.partitionBy("value"))).where("m < node")
    return pairs.unionByName(met.select(F.col("node").alias("a"), F.col("m").alias("b")))


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id for each row."""
    fps = common.stored(fingerprints(docs, text, id_col), "fingerprints")
    distinct = common.stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    found = components(links(distinct))
    named = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
