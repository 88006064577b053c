"""Shards of near-equal bytes by a k-d tree over metadata.

A node of the tree is a box in the metadata dimensions (the logarithm of the size, and fixed places of
language and source on a line). It is split along the dimension in which its rows spread widest, at the
weighted median: the place where half of its bytes lie on either side. The median is found by summing
bytes in 2**BINS_LOG intervals, for all nodes of a level in one pass, and again inside the interval that
holds the half, until the miss is small. Rows of one place are told apart by the text's checksum, so
that equal texts (which share their metadata) stay together unless the cut falls inside their group, and
then by a hash of the id, so that a group of any size can be cut. Only interval sums reach the driver.

Defined results: a null text has no bytes (size 1, checksum of nothing); null metadata are a place of
their own; rows that agree in id, text and metadata cannot be told apart and share a shard; an empty
table has no rows; slots count from 0 in each shard without gaps; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm import common

SHARDS, BINS_LOG, SLOT_BUCKET = 16, 12, 20_000
#: The share of a node's bytes by which a cut may miss the half.
MISS = 1e-4
DIMENSIONS = ("size_place", "lang_place", "source_place")


def _of_node(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("node") + 1)


def measured(docs: DataFrame) -> DataFrame:
    """Each row's size and checksum, its place in each dimension (31 bits), and a hash of its id (63 bits).
    Equal texts take language and source from the one of the smallest doc_id, so that they share a place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    place = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c), F.lit("\0")).cast("binary")), 1)
    size = (F.octet_length(text) + 1).cast("bigint")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"), place("lang").alias("l"), place("source").alias("s"))
    rows = common.stored(rows, "sizes")
    first = rows.groupBy("same", "size").agg(F.min(F.struct("doc_id", "l", "s")).alias("first"))
    return rows.join(first, ["same", "size"]).select(
        "doc_id", "size", "text_crc32", F.col("first.l").alias("lang_place"), F.col("first.s").alias("source_place"),
        F.floor(F.log2("size") * (1 << 25)).cast("bigint").alias("size_place"), F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)).alias("mix"),
    )


def _narrow(rows: DataFrame, key: Column, low: list[int], high: list[int], left: list[float], miss: list[float], open_: list[bool]) -> list[bool]:
    """Move each open node's [low, high] (changed in place) to where `left` more bytes of its rows lie below.
    Nodes that end on a single key whose rows must still be cut are the ones reported."""
    n = len(low)
    inside = [False] * n
    while any(open_):
        shift = [max(0, (h - lo).bit_length() - BINS_LOG) for lo, h in zip(low, high)]
        held = rows.where(_of_node(open_) & (key >= _of_node(low)) & (key <= _of_node(high)))
        place = F.call_function("shiftright", key - _of_node(low), _of_node(shift))
        sums = held.groupBy("node", place.alias("bin")).agg(F.sum("size").alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        bins: list[list] = [[] for _ in range(n)]
        for r in sums.collect():  # 2**BINS_LOG + 1 rows for each node at most
            bins[r.node].append((r.bin, float(r.w), r.lo, r.hi))
        for i in range(n):
            if not open_[i]:
                continue
            for _, w, lo, hi in sorted(bins[i]):
                if left[i] <= miss[i]:  # the cut falls before this interval
                    low[i] = high[i] = lo
                    open_[i] = False
                    break
                if left[i] < w - miss[i]:
                    low[i], high[i] = lo, hi
                    if lo == hi:
                        open_[i], inside[i] = False, True
                    break
                left[i] -= w
                low[i] = high[i] = hi + 1  # all rows so far go below, unless another interval follows
            else:
                open_[i] = False
    return inside


def _split(rows: DataFrame, nodes: int) -> DataFrame:
    """Rows with node numbers 2 * node (below the cut) and 2 * node + 1."""
    stats = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{s}_{d}") for d in DIMENSIONS for s, f in (("lo", F.min), ("hi", F.max))]).collect()}
    if not stats:
        return rows.withColumn("node", F.col("node") * 2)
    whole = {d: max(1, max(r[f"hi_{d}"] for r in stats.values()) - min(r[f"lo_{d}"] for r in stats.values())) for d in DIMENSIONS}
    widest, low, high, left, miss = [], [], [], [], []
    for i in range(nodes):
        r = stats.get(i)
        d = max(range(len(DIMENSIONS)), key=lambda k: ((r[f"hi_{DIMENSIONS[k]}"] - r[f"lo_{DIMENSIONS[k]}"]) / whole[DIMENSIONS[k]], -k)) if r else 0
        widest.append(d)
        low.append(r[f"lo_{DIMENSIONS[d]}"] << 32 if r else 0)
        high.append((r[f"hi_{DIMENSIONS[d]}"] << 32) + (1 << 32) - 1 if r else 0)
        left.append(float(r.w) / 2 if r else 0.0)
        miss.append(float(r.w) * MISS if r else 0.0)
    key = F.element_at(F.array(*[F.shiftleft(F.col(d), 32) + F.col("text_crc32") for d in DIMENSIONS]), _of_node(widest) + 1)
    inside = _narrow(rows, key, low, high, left, miss, [i in stats for i in range(nodes)])
    mix_low, mix_high = [0] * nodes, [(1 << 63) - 1 if x else 0 for x in inside]
    _narrow(rows.where(key == _of_node(low)), F.col("mix"), mix_low, mix_high, left, miss, list(inside))
    below = (key < _of_node(low)) | ((key == _of_node(low)) & (F.col("mix") < _of_node(mix_low)))
    return rows.withColumn("node", F.col("node") * 2 + F.when(below, 0).otherwise(1))


def tree_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """measured() with a shard for each row: `shards` (a power of two) of them, or as many as make their mean at most target_bytes."""
    rows = common.stored(measured(docs), "measured")
    if target_bytes is not None:
        total, shards = rows.agg(F.sum("size")).first()[0] or 0, 1
        while total > shards * target_bytes:
            shards *= 2
    if not shards or shards & (shards - 1):
        raise ValueError("a k-d tree has a power of two leaves")
    rows, nodes = rows.withColumn("node", F.lit(0)), 1
    while nodes < shards:
        rows, nodes = common.stored(_split(rows, nodes), "tree-level"), nodes * 2
    return rows.withColumnRenamed("node", "shard")


def with_slots(rows: DataFrame) -> DataFrame:
    """A gapless number from 0 for each row of a shard. A shard is numbered in buckets of about SLOT_BUCKET rows,
    each on top of the rows of the buckets before it, so no task holds a shard."""
    total = rows.count()
    buckets = max(1, total // (SHARDS * SLOT_BUCKET))
    rows = rows.withColumn("bucket", F.pmod("mix", F.lit(buckets)))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("mix", "doc_id", "text_crc32", "size"))
    return rows.withColumn("number", number).join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("number") - 1)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.stored(tree_shards(common.table(spark, sf_dir, "documents")), "shards")
    return with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
