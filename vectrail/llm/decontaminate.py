"""Benchmark decontamination over templates.

Words that vary between versions of a question become typed placeholders: numbers (digits or number
words), units behind numbers, and names (capitalised words inside a sentence). Windows of template
words are hashed on both sides and joined on the hash. Of the windows that a document shares with an
item, those of one alignment are kept together, and what stands in their slots must be consistent: the
same value of the item always became the same value of the document, and different ones stayed
different. A document holds an item if consistent windows cover enough of the item's words.

Windows with fewer than LITERALS plain words would match anything by their template. Beside the template
hash, every window has a hash of its very words (number words as digits, case does not matter), so that an
item that is mostly numbers and names is still found word for word; an item of fewer than LITERALS words
is only held by a text that has no other words.

A document's windows are only sent to the join if a bit table of fixed size, made from the benchmark's
hashes, has their bits; the table lets every benchmark window pass, so it loses none, whatever the
benchmark's size. Whether the join broadcasts the benchmark side is left to the planner's size check.
Texts are told apart by their MD5 digests, so equal texts are judged once and ids may be null or repeated.

Defined results: case (outside names of changed questions), punctuation and white space do not matter; a
null text has no words and holds nothing; an item with fewer words than a window is one window; an item
without words is held by nothing; texts are read whole; repeated rows and repeated passages give one
result; an item that repeats itself is covered at all its places; items without item_id count, under a
null item_id; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import common

WINDOW, LITERALS, COVER = 8, 4, 0.5
#: Bits in the table of benchmark hashes (two are set for each), and words remembered by a worker.
BITS, REMEMBERED = 1 << 20, 300_000
#: Words that count as numbers, and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg ounce ounces pound pounds ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts".split())

DIGITS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}

_FIND = re.compile(r"[^\W_]+|[.!?:\n]").findall
PLAIN, STOP, NUMBER, UNIT, CAPITAL, NAME = range(6)
_MARK = {kind: np.uint64(xxhash.xxh64_intdigest(f"<{kind}>", 1)) for kind in (NUMBER, UNIT, NAME)}


def kind_of(token: str) -> int:
    low = token.lower()
    if not token[0].isalnum():
        return STOP
    if token.isdigit() or low in NUMBER_WORDS:
        return NUMBER
    if low in UNITS:
        return UNIT
    return CAPITAL if len(token) > 1 and token[0].isupper() and token[1:].islower() else PLAIN


class Places(dict):
    """Numbers of words, in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Reader:
    """Template words of texts, as arrays over all words of a run of texts."""

    def __init__(self) -> None:
        self.place = Places()
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.kinds = np.zeros(0, dtype=np.uint8)

    def read(self, run: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens; of those that are words the place among them, template hash, hash of the very word, kind, and text."""
        if len(self.place) > REMEMBERED:
            self.__init__()
        split = [_FIND(t) for t in run]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        new = list(islice(self.place, len(self.hashes), None))
        self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh64_intdigest(DIGITS.get(x := w.lower(), x)) for w in new), np.uint64, len(new))])
        self.kinds = np.concatenate([self.kinds, np.fromiter(map(kind_of, new), np.uint8, len(new))])
        kinds, owner = self.kinds[at], np.repeat(np.arange(len(run)), sizes)
        before = np.full(len(flat), STOP, dtype=np.uint8)
        before[1:] = kinds[:-1]
        before[np.r_[True, owner[1:] != owner[:-1]][: len(flat)]] = STOP
        kinds = np.where(kinds == CAPITAL, np.where(before == STOP, PLAIN, NAME), kinds)
        kinds = np.where((kinds == UNIT) & (before != NUMBER), PLAIN, kinds)
        own = self.hashes[at]
        hashes = own.copy()
        for kind, mark in _MARK.items():
            hashes[kinds == kind] = mark
        keep = np.nonzero(kinds != STOP)[0]
        return flat, keep, hashes[keep], own[keep], kinds[keep], owner[keep]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of so many: a polynomial, put together from windows whose sizes are powers of two."""
    out, have, part, width = None, 0, hashes, 1
    times = lambda n: np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))
    while True:
        if size & width:
            out = part if out is None else out[: max(0, len(part) - have)] * times(width) + part[have:]
            have += width
        if have == size:
            return out ^ (out >> np.uint64(29))
        part = part[: max(0, len(part) - width)] * times(width) + part[width:]
        width *= 2


def bits_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BITS - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(BITS.bit_length() - 1) & mask).astype(np.int64)


SCHEMA = "id binary, words bigint, size int, at bigint, hash bigint, very boolean, fills array<string>"
VERY_WORDS = np.uint64(0xA5A5A5A5A5A5A5A5)


def windows(texts: DataFrame, sizes: tuple[int, ...] | None = None, table=None) -> DataFrame:
    """A row for each window of texts (id, text): place, hash, whether that is of the very words, and what fills its
    slots (a document's windows of very words leave that out, as it is what fills the item's).

    sizes and table: of a document's windows, the items' sizes and the bit table that windows must pass. Without
    them the texts are items, each with windows of one size, at every place; of a document's equal windows one is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            ids, base = b.column(0).to_pylist(), 0
            for part in common.texts(b.column(1), 1_000_000):
                tokens, place, hashes, own, kinds, owner = reader.read(part)
                counts = np.bincount(owner, minlength=len(part))
                starts = np.cumsum(counts) - counts
                plain = np.r_[0, np.cumsum(kinds == PLAIN)]
                rows: list[tuple] = []
                for size in sizes or range(1, WINDOW + 1):
                    if len(hashes) < size:
                        continue
                    inside = owner[: len(owner) - size + 1] == owner[size - 1 :]
                    if sizes is None:
                        inside &= np.minimum(counts, WINDOW)[owner[: len(inside)]] == size
                    elif size < LITERALS:
                        inside &= counts[owner[: len(inside)]] == size
                    for template in (True, False):
                        if template:
                            h, ok = window_hashes(hashes, size), inside & (plain[size:] - plain[: len(inside)] >= LITERALS)
                        else:
                            h, ok = window_hashes(own, size) ^ VERY_WORDS, inside
                        if table is not None:
                            one, two = bits_of(h)
                            ok = ok & table.value[one]
                            ok[ok] = table.value[two[ok]]
                        seen = set()
                        for i in np.nonzero(ok)[0].tolist():
                            fills = tuple(DIGITS.get(x := tokens[place[j]].lower(), x) for j in range(i, i + size) if kinds[j] != PLAIN) if template or table is None else ()
                            t = int(owner[i])
                            if sizes is not None:
                                if (t, int(h[i]), fills) in seen:
                                    continue
                                seen.add((t, int(h[i]), fills))
                            rows.append((ids[base + t], int(counts[t]), size, i - int(starts[t]), int(h[i].astype(np.int64)), not template, list(fills)))
                base += len(part)
                if rows:
                    kinds_ = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds_)], names=["id", "words", "size", "at", "hash", "very", "fills"])

    return common.spread(texts.select("id", "text")).mapInArrow(lambda x: common.giving_back(run(x)), SCHEMA)


def judged(shared: list[dict], words: int) -> tuple[float, bool]:
    """Share of an item's words that consistent windows cover, and whether all slots hold the item's own values."""
    by: dict[int, list[dict]] = {}
    for w in shared:
        by.setdefault(w["doc_at"] - w["item_at"], []).append(w)
    covered: set[int] = set()
    forth: dict[str, str] = {}
    back: dict[str, str] = {}
    same = True
    for _, aligned in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
        f, b, mine, equal = dict(forth), dict(back), set(), True
        for w in sorted(aligned, key=lambda w: (not w["very"], w["item_at"], w["doc_fills"])):
            pairs = list(zip(w["item_fills"], w["item_fills"] if w["very"] else w["doc_fills"]))
            if all(f.get(x, y) == y and b.get(y, x) == x for x, y in pairs):
                f.update(pairs)
                b.update((y, x) for x, y in pairs)
                equal &= all(x == y for x, y in pairs)
                mine.update(range(w["item_at"], w["item_at"] + w["size"]))
        if mine - covered:
            covered |= mine
            forth, back, same = f, b, same and equal
    return len(covered) / max(1, words), same


def bit_table(found: DataFrame) -> np.ndarray:
    """BITS truth values; the driver gets at most BITS numbers, however large the benchmark."""
    one = F.expr(f"cast((hash & {BITS - 1}) as int)")
    two = F.expr(f"cast((shiftrightunsigned(hash, {BITS.bit_length() - 1}) & {BITS - 1}) as int)")
    table = np.zeros(BITS, dtype=bool)
    table[[r[0] for r in found.select(F.explode(F.array(one, two))).distinct().collect()]] = True
    return table


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def held(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """id, item, covered, exact for every item that a text holds; id and item are digests of texts."""
    spark = docs.sparkSession
    theirs = common.stored(windows(items.select(digest(F.col("text")).alias("id"), "text").dropDuplicates(["id"])), "benchmark-windows")
    sizes = tuple(sorted(r[0] for r in theirs.select("size").distinct().collect())) or (WINDOW,)  # WINDOW sizes at most
    table = spark.sparkContext.broadcast(bit_table(theirs))
    mine = windows(docs.select(digest(F.col(text)).alias("id"), F.col(text).alias("text")), sizes, table)
    mine = mine.select("id", "size", "hash", "very", F.col("at").alias("doc_at"), F.col("fills").alias("doc_fills"))
    theirs = theirs.select(F.col("id").alias("item"), "words", "size", "hash", F.col("at").alias("item_at"), F.col("fills").alias("item_fills"))
    pairs = mine.join(theirs, ["size", "hash"]).groupBy("id", "item").agg(F.max("words").alias("words"), F.collect_set(F.struct("doc_at", "item_at", "size", "very", "doc_fills", "item_fills")).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judged(s.as_py(), n) for s, n in zip(b.column("shared"), b.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("item"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.bool_())], names=["id", "item", "covered", "exact"])

    return pairs.mapInArrow(run, "id binary, item binary, covered double, exact boolean").where(F.col("covered") >= COVER)


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, covered, exact for every item that a document holds; for ids that several texts share, the greatest cover."""
    found = held(docs, benchmark, text)
    items = benchmark.select(digest(F.col("text")).alias("item"), F.col("item_id").cast("long").alias("item_id")).distinct()
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text)).alias("id"))
    each = mine.join(found.join(items, "item"), "id")
    return each.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.bool_or("exact").alias("exact"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item."""
    key = common.unused(docs, "digest")
    gone = held(docs, benchmark).select(F.col("id").alias(key)).distinct()
    return docs.join(gone, digest(docs["text"]) == gone[key], "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items (sorted list of item_id, without nulls), covered (largest share of an item), exact, for each document."""
    docs, benchmark = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    items = benchmark.select(digest(F.col("text")).alias("item"), "item_id").distinct()
    found = held(docs, benchmark).join(items, "item").groupBy("id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("covered").alias("covered"), F.bool_and("exact").alias("exact"))
    rows = docs.select("doc_id", digest(F.col("text")).alias("id")).join(found, "id", "left")
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("covered", F.lit(0.0)).alias("covered"), "exact")
