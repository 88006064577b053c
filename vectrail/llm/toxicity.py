"""Toxicity by maximum-scoring segments over word log-odds.

Fit: on a bounded sample of labelled documents (TRAIN_DOCS, by the order of a hash of doc_id, equal texts
once). A word's occurrences count once for each pair of neighbours (its context), so that copies and
passages that many documents share weigh like one. A word's chance of standing in a toxic text has a
Dirichlet prior at the chance of its beginning or ending, whichever says more; a beginning (ending) of n
characters has its prior at the one of n - 1, the shortest at the overall share. Each step moves the
log-odds only as far as they leave SURE standard errors behind, so what is seldom seen keeps the log-odds
of its prior. The score of every word, seen or not, is its log-odds against the overall share less DRIFT:
words that speak for a clean text are below -DRIFT.

Search: one linear pass over a text's scores finds every maximal segment (the segments that no longer
or shorter neighbour beats). How high chance segments reach is fitted on clean documents that the model
has not seen: the sample is cut in two, and each half is read with what the other half taught. Segments
above THRESHOLD of the best scores of clean documents are taken as exponential in their excess, so that
n words have (1 + rate * n) * exp(-decay * score) of a score or more. A segment is significant if fewer
than E_MOST like it are expected. A text's evidence is the most unlikely of the events that r segments
reach the score of its r-th best (a Poisson count; beyond r = 1 only segments above the threshold); a
logistic curve, fitted on the halves' evidence, turns it into a probability.

Defined results: a null text counts as empty and has the least evidence, as a text of one neutral word;
repeated label rows count once, toxic if any says so; null labels and labels other than 0 and 1 are
ignored; without labels of both kinds no word counts and every score is the smoothed base rate; equal
rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import common

TRAIN_DOCS = 20_000
#: Lengths of beginnings and endings, weight of a prior in contexts, and standard errors that are left behind.
STEMS, PRIOR, SURE = (3, 4, 5, 6), 8.0, 3.0
DRIFT, E_MOST, THRESHOLD = 0.1, 0.01, 0.9
HELD_OUT = 5
#: Words whose scores a worker remembers, and parts that the sample's vocabulary is dealt into.
REMEMBERED, PARTS = 200_000, 64

_FIND = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    return _FIND(text.lower())


def logit(p: float) -> float:
    return math.log(p / (1.0 - p))


def moved(prior: float, toxic: float, clean: float) -> float:
    """Log-odds after some toxic and clean contexts, from those of the prior; as far as they are sure."""
    chance = 1.0 / (1.0 + math.exp(-prior))
    n = toxic + clean + PRIOR
    p = (toxic + PRIOR * chance) / n
    step = logit(min(max(p, 1e-9), 1 - 1e-9)) - prior
    left = abs(step) - SURE / math.sqrt(n * p * (1.0 - p))
    return prior + math.copysign(left, step) if left > 0 else prior


def beginnings(word: str) -> list[str]:
    return [word[:n] + "-" for n in STEMS if len(word) > n]


def endings(word: str) -> list[str]:
    return ["-" + word[-n:] for n in STEMS if len(word) > n]


def stem_odds(words: Iterable[tuple[str, float, float]], base: float, parts=beginnings) -> dict[str, float]:
    """Log-odds of the beginnings (or endings) of words with their toxic and clean contexts; those that differ from their prior."""
    sums: dict[str, list[float]] = {}
    for word, toxic, clean in words:
        for f in parts(word):
            s = sums.setdefault(f, [0.0, 0.0])
            s[0] += toxic
            s[1] += clean
    out: dict[str, float] = {}
    for f in sorted(sums, key=len):  # shorter ones are the priors of longer ones
        prior = stem_prior(out, f, base)
        odds = moved(prior, *sums[f])
        if odds != prior:
            out[f] = odds
    return out


def stem_prior(known: dict[str, float], f: str, base: float) -> float:
    """Log-odds of the longest shorter beginning (or ending) of f that has its own."""
    for n in range(len(f) - 2, min(STEMS) - 1, -1):
        shorter = f[:n] + "-" if f[-1] == "-" else "-" + f[-n:]
        if shorter in known:
            return known[shorter]
    return base


def word_prior(known: dict[str, float], word: str, base: float) -> float:
    """Log-odds of the longest known beginning or ending of a word, of the one that differs more from base."""
    a, b = stem_prior(known, word + "-", base), stem_prior(known, "-" + word, base)
    return a if abs(a - base) >= abs(b - base) else b


def word_odds(words: Iterable[tuple[str, float, float]], stems: dict[str, float], base: float) -> dict[str, float]:
    """Log-odds of the words that differ from their prior."""
    out = {}
    for word, toxic, clean in words:
        prior = word_prior(stems, word, base)
        odds = moved(prior, toxic, clean)
        if odds != prior:
            out[word] = odds
    return out


class Scores(dict):
    """Scores by word, worked out when first asked for."""

    def __init__(self, known: dict[str, float], base: float):
        super().__init__()
        self.known, self.base = known, base

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        odds = self.known[word] if word in self.known else word_prior(self.known, word, self.base)
        self[word] = score = odds - self.base - DRIFT
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """First place, last place and sum of each maximal segment, in order."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # Parallel stacks: first and last place, sums before and behind, and the last entry with a smaller sum before.
    first, last, low, high, link = [], [], [], [], []
    for i in np.nonzero(scores > 0)[0].tolist():
        start, before, total = i, float(sums[i]), float(sums[i + 1])
        j = len(first) - 1
        while True:
            while j >= 0 and low[j] >= before:
                j = link[j]
            if j < 0 or high[j] >= total:
                break
            start, before = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:]
            j = link[j]
            del link[len(first) :]
        first.append(start)
        last.append(i)
        low.append(before)
        high.append(total)
        link.append(j)
    return [(a, b, h - x) for a, b, x, h in zip(first, last, low, high)]


@dataclasses.dataclass
class Model:
    """known: log-odds of words, beginnings (abc-) and endings (-abc) that differ from their prior."""

    known: dict[str, float]
    base: float = 0.0
    decay: float = 1.0
    rate: float = 0.0
    threshold: float = 0.0
    slope: float = 0.0
    offset: float = -20.0

    def __post_init__(self) -> None:
        self.scores = Scores(self.known, self.base)

    def __reduce__(self):
        return Model, tuple(getattr(self, f.name) for f in dataclasses.fields(self))

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        return segments(np.fromiter(map(self.scores.__getitem__, words), np.float64, len(words)))

    def expected(self, score: float, n: int) -> float:
        """Logarithm of the number of chance segments of that score or more in n words."""
        return math.log1p(self.rate * n) - self.decay * score

    def evidence(self, scores: list[float], n: int) -> float:
        """The greatest, over r, of the negative logarithms of the chance that r segments of n words reach the r-th of these scores."""
        most = 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            log_e = self.expected(s, n)
            e = math.exp(log_e)
            if r == 1:
                most = -math.log(-math.expm1(-e)) if log_e > -30 else -log_e
            elif s <= self.threshold or e >= r:
                break
            else:  # the tail of the Poisson distribution, bounded by its first term and a geometric series
                most = max(most, e - r * log_e + math.lgamma(r + 1) + math.log1p(-e / (r + 1)))
        return most

    def judged(self, text: str) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Probability of a text, and its significant passages: first word, last word, score, number expected by chance."""
        words = words_of(text)
        found, n = self.segments(words), max(1, len(words))
        x = self.slope * math.asinh(self.evidence([s for _, _, s in found], n)) + self.offset
        passages = [(a, b, s, math.exp(e)) for a, b, s in found if (e := self.expected(s, n)) < math.log(E_MOST)]
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x)))), passages


def remainder(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.crc32(id_col.cast("string").cast("binary")) % of


def contexts(words: list[str]) -> set[tuple[str, str, str]]:
    """Each word with its neighbours, once."""
    return set(zip(["", *words[:-1]], words, [*words[1:], ""]))


#: What the counts of a word are of: clean or toxic contexts, in one half of the sample or in all of it.
COUNTS = ("clean0", "clean1", "toxic0", "toxic1", "clean", "toxic")
#: The columns that teach the models of each half and of the whole sample.
TAUGHT_BY = (("toxic0", "clean0"), ("toxic1", "clean1"), ("toxic", "clean"))


def counted(sample: DataFrame) -> DataFrame:
    """w and COUNTS: in how many different contexts a word stands. sample: text, toxic, half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, toxic, half in zip(b.column("text"), b.column("toxic").to_pylist(), b.column("half").to_pylist()):
                found = list(contexts(words_of(t.as_py() or "")))
                for i in range(0, len(found), 200_000):
                    part = found[i : i + 200_000]
                    h = np.fromiter(map(xxhash.xxh64_intdigest, map("\n".join, part), repeat(0)), np.uint64, len(part)).view(np.int64)
                    side = pa.array(np.full(len(part), 1 << (2 * toxic + half), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in part], pa.string()), pa.array(h), side], names=["w", "h", "side"])

    each = sample.select("text", "toxic", "half").mapInArrow(lambda x: common.giving_back(run(x)), "w string, h bigint, side int").groupBy("w", "h").agg(F.bit_or("side").alias("sides"))
    held = {name: F.sum((F.col("sides").bitwiseAND(mask) != 0).cast("bigint")) for name, mask in zip(COUNTS, (1, 2, 4, 8, 3, 12))}
    return each.groupBy("w").agg(*(held[c].alias(c) for c in COUNTS))


def _columns(b: pa.RecordBatch, m: int) -> list[tuple[str, int, int]]:
    toxic, clean = TAUGHT_BY[m]
    rows = zip(b.column("w").to_pylist(), b.column(toxic).to_pylist(), b.column(clean).to_pylist())
    return [x for x in rows if x[1] or x[2]]


def learned(words: DataFrame, bases: list[float]) -> list[dict[str, float]]:
    """What is known to each model of TAUGHT_BY."""

    def found_in(parts: DataFrame, find) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[list] = [[], [], []]
            for b in batches:  # a share of the sample's vocabulary
                for m in range(3):
                    rows[m] += _columns(b, m)
            for m in range(3):
                found = find(rows[m], m)
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], names=["m", "f", "odds"])

        return parts.mapInArrow(lambda x: common.giving_back(run(x)), "m int, f string, odds double").collect()  # what is sure in the bounded sample

    long, n = words.where(F.length("w") > min(STEMS)), min(STEMS)
    stems: list[dict[str, float]] = [{}, {}, {}]
    for key, parts in ((F.substring("w", 1, n), beginnings), (F.right("w", F.lit(n)), endings)):
        for r in found_in(long.repartition(PARTS, key), lambda rows, m, parts=parts: stem_odds(rows, bases[m], parts)):
            stems[r.m][r.f] = r.odds
    known = [dict(x) for x in stems]
    for r in found_in(words.repartition(PARTS, "w"), lambda rows, m: word_odds(rows, stems[m], bases[m])):
        known[r.m][r.f] = r.odds
    return known


def tail_of(clean: DataFrame, threshold: float) -> tuple[float, float]:
    """Decay and rate of segments above the threshold, in rows (n words, segments); likeliest for exponential excesses, with the weight of one more of size 1."""
    over = F.filter("segments", lambda s: s > threshold)
    sums = clean.select("n", F.size(over).alias("k"), F.aggregate(over, F.lit(0.0), lambda a, s: a + s - threshold).alias("excess"))
    k, excess, n = (x or 0 for x in sums.agg(F.sum("k"), F.sum("excess"), F.sum("n")).first())
    decay = (k + 1) / (excess + 1)
    return decay, k / max(1, n) * math.exp(decay * threshold)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of the likeliest curve, with Platt's smoothed targets and a weak pull of the slope to 1."""
    if not len(y):
        return 0.0, -20.0
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 0.0, math.log((n1 + 1) / (n0 + 1))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 0.5) / (n0 + 0.5))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * x).sum() + 0.1 * (a - 1), (p - t).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)), float(b)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the labels that are not held out."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id"), HELD_OUT) != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # train_docs rows of two numbers at most
    sample = sample.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"]).select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("half"))
    sample = common.stored(common.spread(sample), "toxicity-sample")
    kinds = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(1) or not kinds.get(0):
        slope, offset = logistic(np.zeros(sum(kinds.values())), np.repeat([float(t) for t in kinds], list(kinds.values())))
        return Model({}, slope=slope, offset=offset)
    words = common.stored(counted(sample), "toxicity-contexts")
    sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
    bases = [logit((sums[t] + 1) / (sums[t] + sums[c] + 2)) for t, c in TAUGHT_BY]
    known = learned(words, bases)
    halves = [Model(known[m], bases[m]) for m in range(2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, half in zip(b.column("text"), b.column("half").to_pylist()):
                words = words_of(t.as_py() or "")
                rows.append((len(words), sorted((s for _, _, s in halves[1 - half].segments(words)), reverse=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), b.column("toxic")], names=["n", "segments", "toxic"])

    read = common.stored(sample.mapInArrow(run, "n bigint, segments array<double>, toxic int"), "toxicity-halves")
    clean = read.where("toxic = 0")
    best = clean.select(F.coalesce(F.get("segments", F.lit(0)), F.lit(0.0)).alias("s")).toArrow()  # train_docs rows at most, as below
    threshold = float(np.quantile(np.asarray(best["s"], dtype=np.float64), THRESHOLD))
    draft = Model(known[2], bases[2], *tail_of(clean, threshold), threshold)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [draft.evidence(found, max(1, n)) for found, n in zip(b.column("segments").to_pylist(), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("toxic")], names=["x", "toxic"])

    seen = read.mapInArrow(evidence, "x double, toxic int").toArrow()
    slope, offset = logistic(np.arcsinh(np.asarray(seen["x"], dtype=np.float64)), np.asarray(seen["toxic"], dtype=np.float64))
    return dataclasses.replace(draft, slope=slope, offset=offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant passages of each text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            scores, spans = [], []
            for t in b.column("text"):
                chance, found = m.judged(t.as_py() or "")
                scores.append(chance)
                spans.append([dict(zip(("first", "last", "score", "expected"), p)) for p in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "passages"])
        m.scores.clear()

    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lambda x: common.giving_back(run(x)), "doc_id bigint, score double, passages array<struct<first:bigint,last:bigint,score:double,expected:double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below one half."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([held.value.judged(t.as_py() or "")[0] < 0.5 for t in b.column("text")], pa.bool_()))
        held.value.scores.clear()

    return common.spread(docs).mapInArrow(lambda x: common.giving_back(run(x)), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), HELD_OUT) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("bigint").alias("n_passages"))
