"""Line deduplication by a segment-partition edit join, in DataFrame operations alone.

Lines (text between line feeds, without spaces, tabs and carriage returns at the ends) are linked if few
insertions, deletions and replacements turn one into the other: one for every CHARS characters of the
shorter line, EDITS at most, so that a line of fewer than CHARS characters is linked to none. A line that
others probe is cut into one segment more than it may have edits; a linked line of the same or greater
length holds one of them unchanged, at a place that the two lengths and the segment's number narrow to a
few starts. Line and segment make a key, and lines that share a key are verified by a banded bit-parallel
edit distance.

Only keys that two different lines share matter. A first pass sums up every key in a fixed-size state
(partial sums before the shuffle, so a line that stands everywhere costs a row for each task), and the
keys that are shared set bits in a table of fixed size. The second pass keeps lines with such a bit,
each once, and joins those on their keys. The join's condition compares a signature of the characters,
which hardly any lines that are no versions of each other pass, and then the edit distance, so it gives
linked pairs only. Within a crowd of lines that share a segment and have about one length, comparisons of
signatures (not rows, and not edit distances) still grow with the square of the crowd; skewed keys are
split over tasks. Lines with equal text are one line throughout.

Defined results: a null text has no lines, an empty text has one empty line; empty lines hold nothing that
could repeat and are always kept; a class is named by its smallest (doc_id, line_no), nulls first, in the
text with the smallest hash if rows of one doc_id differ; the line of that place is kept, equal lines and
linked ones go, whatever their length; equal rows (doc_id and text) carry the same places and stay alike;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import common
from vectrail.llm.components import components

#: The most edits, and characters of a line for each edit.
EDITS, CHARS = 2, 10
#: Bits of the table of shared keys.
TABLE_LOG = 22


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, of (a hash of the text), line_no (from 0), line, n_chars and the line's identity k of 96 bits."""
    split = docs.select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    lines = split.select("doc_id", "of", "line_no", F.trim(F.col("raw"), F.lit(" \t\r")).alias("line"))
    return lines.select("*", F.length("line").alias("n_chars"), F.struct(F.xxhash64("line").alias("h"), F.hash("line").alias("g")).alias("k"))


def allowed(n_chars: Column) -> Column:
    """Edits between a line of so many characters and one that is not shorter."""
    return F.least(F.lit(EDITS), F.floor(n_chars / CHARS).cast("int"))


def _places() -> list[tuple[int, int, int, int]]:
    """(edits, segment, characters that the other line has less, shift of the start) of all substrings that a line probes with."""
    found = []
    for edits in range(1, EDITS + 1):
        for less in range(edits + 1):
            for i in range(edits + 1):
                before, behind = i, edits - i  # edits that may lie on either side of the segment
                found += [(edits, i, less, move) for move in range(max(-before, less - behind), min(before, less + behind) + 1)]
    return found


def with_keys(lines: DataFrame) -> DataFrame:
    """lines with key and own, a row for each place: keys of the line's own segments (own) and of the substrings that
    may be a segment of a line with fewer characters. A constant list is exploded and the key computed from its
    numbers, so the generated code stays small enough to be compiled. Substrings are taken from characters of four
    bytes, whose places need no count of the characters before them."""
    params = lambda least: F.array(*[F.struct(*(F.lit(x).alias(n) for n, x in zip(("edits", "i", "less", "move"), p))) for p in _places() if p[0] >= least])
    whole = F.col("n_chars") >= CHARS * EDITS + EDITS  # with any fewer characters EDITS are allowed as well
    wide = common.unused(lines, "wide")
    rows = lines.withColumn(wide, F.encode("line", "UTF-32")).withColumn("p", F.explode(F.when(whole, params(EDITS)).otherwise(params(1)))).withColumn("m", F.col("n_chars") - F.col("p.less")).where(whole | (allowed(F.col("m")) == F.col("p.edits")))
    parts, i = F.col("p.edits") + 1, F.col("p.i")
    base, extra = F.call_function("div", F.col("m"), parts).cast("int"), F.col("m") % parts  # later segments take the remainder
    start = i * base + F.greatest(F.lit(0), i - (parts - extra)) + 1 + F.col("p.move")
    size = base + (i >= parts - extra).cast("int")
    key = F.xxhash64(F.substring(F.col(wide), 4 * start - 3, 4 * size), i, F.col("m"))
    return rows.select(*lines.columns, key.alias("key"), ((F.col("p.less") == 0) & (F.col("p.move") == 0)).alias("own"))


def _odd(parts: Column) -> Column:
    """64 bits: whether the parts that a hash puts into each of 64 classes are odd in number."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64(c).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, c: a.bitwiseXOR(bit(c)))


def signature(line: Column) -> Column:
    """Odd classes of characters, of which an edit changes two at most, and of words, of which it changes three (one word becomes two)."""
    return F.struct(_odd(F.split(line, "")).alias("chars"), _odd(F.split(line, " ")).alias("words"))


def _near(a: Column, b: Column, edits: Column) -> Column:
    apart = lambda part: F.bit_count(a[part].bitwiseXOR(b[part]))
    return (apart("chars") <= 2 * edits) & (apart("words") <= 3 * edits)


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rows_after(matches: Column) -> Column:
    """The last rows of the automaton in within()."""
    width = 2 * EDITS + 1
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << EDITS & (1 << width) - 1).alias(f"r{e}") for e in range(EDITS + 1)])

    def step(rows: Column, match: Column) -> Column:
        new = [rows["r0"].bitwiseAND(match)]
        for e in range(1, EDITS + 1):
            last = rows[f"r{e - 1}"]
            moves = last.bitwiseOR(F.shiftright(last, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(rows[f"r{e}"].bitwiseAND(match).bitwiseOR(moves).bitwiseAND(F.lit((1 << width) - 1)))
        return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(new)])

    return F.aggregate(matches, start, step, lambda r: F.array(*[r[f"r{e}"] for e in range(EDITS + 1)]))


def within(a: Column, b: Column, n_a: Column, n_b: Column, edits: Column) -> Column:
    """Whether so many edits (EDITS at most) turn line a into b; n_a <= n_b <= n_a + EDITS are their characters.

    What the lines have in common at their ends is found by bisection and left out. The rest is compared by a banded
    bit-parallel automaton: after j characters of b, bit t of row e tells whether the first j + t - EDITS characters
    of a become those with e edits or fewer. A character of b updates the 2 * EDITS + 1 bits of a row at once: the
    same bit where the characters match, else from the row before by replacement, insertion and deletion."""
    cut = lambda text, start, size: F.substring(text, 4 * start + 1, 4 * size)  # noqa: E731  characters of four bytes
    sizes = F.array(*[F.lit(1 << i) for i in range(16, -1, -1)])
    zero = F.lit(0)

    def head(x: Column) -> Column:
        return F.aggregate(sizes, zero, lambda p, s: F.when((p + s <= x["n"]) & (cut(x["a"], p, s) == cut(x["b"], p, s)), p + s).otherwise(p))

    def tail(x: Column) -> Column:
        same = lambda q, s: cut(x["a"], x["n"] - q - s, s) == cut(x["b"], x["m"] - q - s, s)
        return F.aggregate(sizes, zero, lambda q, s: F.when((x["p"] + q + s <= x["n"]) & same(q, s), q + s).otherwise(q))

    def matches(x: Column) -> Column:
        at = lambda j: sum((F.when(cut(x["a"], j + t, F.lit(1)) == cut(x["b"], j, F.lit(1)), 1 << t).otherwise(0) for t in range(2 * EDITS + 1)), zero)
        return F.transform(F.sequence(zero, x["m"] - 1), at)

    def rest(x: Column) -> Column:
        pad, q = F.lit(b"\xff\xff\xff\xff" * EDITS), x["q"]
        middle = F.struct(F.concat(pad, cut(x["a"], x["p"], x["n"] - x["p"] - q)).alias("a"), cut(x["b"], x["p"], x["m"] - x["p"] - q).alias("b"), (x["m"] - x["p"] - q).alias("m"))
        last = lambda y: F.call_function("shiftright", F.get(_rows_after(matches(y)), x["e"]), x["n"] - x["m"] + EDITS)
        return _bound(middle, lambda y: F.when(y["m"] == 0, F.lit(True)).otherwise(last(y).bitwiseAND(F.lit(1)) == 1))

    whole = F.struct(F.encode(a, "UTF-32").alias("a"), F.encode(b, "UTF-32").alias("b"), n_a.alias("n"), n_b.alias("m"), edits.alias("e"))
    with_p = lambda x: F.struct(*(x[c].alias(c) for c in "abnme"), head(x).alias("p"))
    with_q = lambda x: F.struct(*(x[c].alias(c) for c in "abnmep"), tail(x).alias("q"))
    return _bound(whole, lambda x: _bound(with_p(x), lambda y: _bound(with_q(y), rest)))


def _bit(key: Column) -> tuple[Column, Column]:
    """Word and bit of a key in the table."""
    at = key.bitwiseAND(F.lit((1 << TABLE_LOG) - 1))
    return F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def shared_bits(long: DataFrame) -> DataFrame:
    """One row: an array of 2**TABLE_LOG / 64 numbers with the bits of all keys that two different lines share."""
    spark = long.sparkSession
    each = with_keys(long.select(F.col("k.h").alias("h"), "line", "n_chars")).select("h", "key", "own")
    shared = each.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("own").alias("own")).where("own and a != b")
    word, bit = _bit(F.col("key"))
    words = shared.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    every = spark.range((1 << TABLE_LOG) // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    table = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("t"))
    return common.stored(table.select(F.col("t.bits").alias("t")), "shared-bits")


def links(lines: DataFrame) -> DataFrame:
    """a, b: identities of different lines within the edits that the shorter one allows, each pair once."""
    long = lines.where(F.col("n_chars") >= CHARS)
    bits = shared_bits(long).select("t").scalar()
    word, bit = _bit(F.col("key"))
    held = F.call_function("shiftrightunsigned", F.get(bits, word), bit).bitwiseAND(F.lit(1)) == 1
    each = with_keys(long.select("k", "line", "n_chars")).withColumn("key", F.explode(F.array("key")))  # else the filter works out a key for each use
    live = each.where(held)
    live = live.groupBy("k").agg(F.first("line").alias("line"), F.first("n_chars").alias("n"), F.collect_set(F.struct("key", "own")).alias("keys"))
    live = common.stored(live.withColumn("sig", signature(F.col("line"))), "live-lines")
    rows = live.select("k", "n", "sig", F.explode("keys").alias("x")).select("k", "n", "sig", "x.key", "x.own")
    shared = rows.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1").select("key")
    rows = rows.join(shared, "key").join(live.select("k", "line"), "k")
    rows = common.stored(rows, "line-keys")
    own, probe = rows.where("own").alias("o"), rows.alias("p")
    different = (F.col("o.n") < F.col("p.n")) | ((F.col("o.n") == F.col("p.n")) & (F.col("o.k") < F.col("p.k")))
    edits = allowed(F.col("o.n"))
    linked = different & _near(F.col("o.sig"), F.col("p.sig"), edits) & within(F.col("o.line"), F.col("p.line"), F.col("o.n"), F.col("p.n"), edits)
    return own.join(probe, (F.col("o.key") == F.col("p.key")) & linked).select(F.col("o.k").alias("a"), F.col("p.k").alias("b")).distinct()


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, of, line_no, n_chars, class (doc_id, line_no, of), n_links, keep: a row for each line."""
    lines = lines_of(docs)
    found = common.stored(links(lines), "line-links")
    counts = found.select(F.col("a").alias("k")).unionAll(found.select(F.col("b").alias("k"))).groupBy("k").agg(F.count("*").alias("n_links"))
    named = components(found).select(F.col("node").alias("k"), "component")
    places = common.stored(lines.select("doc_id", "of", "line_no", "n_chars", "k"), "lines")
    first = places.groupBy("k").agg(F.min(F.struct("doc_id", "line_no", "of")).alias("first"))
    linked = first.join(counts, "k").join(named, "k", "left").withColumn("component", F.coalesce("component", "k"))
    linked = linked.join(linked.groupBy("component").agg(F.min("first").alias("class")), "component").select("k", "class", "n_links")
    joined = places.join(first, "k").join(linked, "k", "left").withColumn("class", F.coalesce("class", "first"))
    keep = (F.col("n_chars") == 0) | (F.struct("doc_id", "line_no", "of") == F.col("class"))
    return joined.select("doc_id", "of", "line_no", "n_chars", "class", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), keep.alias("keep"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, n_chars, class_doc_id, class_line_no, n_links (different lines that are linked to it), keep: a row for each line."""
    return placed(docs).select("doc_id", "line_no", "n_chars", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), "n_links", "keep")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the lines that are not kept taken out of each text, and n_chars, if there, counted anew. No row goes."""
    gone = placed(docs).where("not keep").groupBy("doc_id", "of").agg(F.collect_set("line_no").alias("gone"))
    names = [common.unused(docs, n) for n in ("line_doc", "line_of", "line_gone")]
    gone = common.stored(gone.toDF(*names), "lines-gone")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[names[0]]) & (F.xxhash64(docs["text"]) == gone[names[1]]), "left")
    parts, out = F.split("text", "\n"), gone[names[2]]
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), out), lambda i: F.get(parts, i))
    joined = joined.withColumn("text", F.when(out.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(out.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.drop(*names)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


#: DuckDB's edit distance counts bytes: these letters become one byte each (control characters that no line holds).
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßáâäçèéêíîñóöúü"
_BYTES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 31)])
def _held(parts: int) -> str:
    """That b holds one of so many segments of a."""
    base, extra = f"(a.n // {parts})", f"(a.n % {parts})"
    cut = lambda i: f"a.c[{i} * {base} + greatest(0, {i} - {parts} + {extra}) + 1 : {i} * {base} + greatest(0, {i} - {parts} + {extra}) + {base} + CASE WHEN {i} >= {parts} - {extra} THEN 1 ELSE 0 END]"
    return "(" + " OR ".join(f"contains(b.c, {cut(i)})" for i in range(parts)) + ")"


_PAIRS = " UNION ALL ".join(
    f"SELECT a.line AS a, b.line AS b FROM long a JOIN long b ON b.n >= a.n AND b.n <= a.n + {e} AND (a.n < b.n OR a.line < b.line) AND {_held(e + 1)} "
    f"WHERE least({EDITS}, a.n // {CHARS}) = {e} AND levenshtein(a.c, b.c) <= {e}"
    for e in range(1, EDITS + 1)
)
OP6_SQL = f"""
WITH RECURSIVE parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, trim(p[i], ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
first AS (SELECT line, length(line) AS n, min({{'d': doc_id, 'l': line_no}}) AS place FROM lines GROUP BY line),
long AS (SELECT line, n, place, translate(line, '{_LETTERS}', {_BYTES}) AS c FROM first WHERE n >= {CHARS}),
pairs AS MATERIALIZED ({_PAIRS}),
sides AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS x, a AS y FROM sides UNION SELECT r.x, s.b FROM reach r JOIN sides s ON s.a = r.y),
named AS (SELECT x AS line, min(place) AS class FROM reach JOIN first ON first.line = y GROUP BY x),
counted AS (SELECT a AS line, count(*) AS n_links FROM sides GROUP BY a)
SELECT doc_id, line_no, CAST(first.n AS INTEGER) AS n_chars, coalesce(class, place).d AS class_doc_id, coalesce(class, place).l AS class_line_no,
       CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, first.n = 0 OR coalesce(class, place) = {{'d': doc_id, 'l': line_no}} AS keep
FROM lines JOIN first USING (line) LEFT JOIN named USING (line) LEFT JOIN counted USING (line)
"""
