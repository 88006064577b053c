"""Language identification of code-switched text with a linear-chain conditional random field.

Each word of a text gets a label. A word's features are its affixes, its character n-grams with the
ends marked, and the word itself (the lexicon feature), hashed into a table of weights. Transition
weights between the labels of neighbouring words are learned with them. Forward-backward gives each
word's chances; the text's language is the one with the largest mean chance, which is the score.

Fit: SAMPLE documents of each language at most (by the order of a hash of doc_id), WINDOWS runs of RUN
words of each, spread over the whole text. Chains for training join runs of one and of several
languages, so that switches are seen; the likelihood of the chains is climbed by Adagrad.

Defined results: a null text, or one without letters, is `und` with score 0; without any labelled
document every text is `und`; ties go to the language that sorts first; every word of a text counts,
however long the text; repeated rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm import common
from vectrail.llm.toxicity import remainder

SAMPLE, WINDOWS, RUN = 600, 6, 6
CHAIN, CHAINS, EPOCHS, BATCH, RATE, PULL, STAY = 5, 6000, 3, 500, 0.3, 1e-4, 0.8
BUCKETS, REMEMBERED = 1 << 16, 300_000
HELD_OUT, FOLDS = 2, 4
UNKNOWN = "und"

_FIND = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return [w for w in _FIND(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str) -> list[int]:
    """Buckets of the word, of its affixes of one to three characters, and of its 2- and 3-grams."""
    ends = f"<{word}>"
    n = len(word)
    found = ["w" + word]
    for k in range(1, min(3, n) + 1):
        found += ["p" + word[:k], "s" + word[n - k :]]
    found += [ends[i : i + 2] for i in range(n + 1)]
    found += [ends[i : i + 3] for i in range(n)]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for f in found]


def emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Sum of feature weights of each word."""
    per_word = [features(w) for w in words]
    sizes = np.fromiter(map(len, per_word), np.int64, len(per_word))
    flat = np.fromiter(chain.from_iterable(per_word), np.int64, int(sizes.sum()))
    return np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0) if len(words) else np.zeros((0, weights.shape[1]))


def marginals(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each label at each place of chains (chains x places x labels), and expected moves summed over all."""
    b, t, n = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    if lengths is not None:
        emit[np.arange(t)[None, :] >= lengths[:, None]] = 1.0
    step = np.exp(moves - moves.max())
    ahead = np.empty_like(emit)
    a = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    ahead[:, 0] = a
    for i in range(1, t):
        a = (a @ step) * emit[:, i]
        a /= a.sum(axis=1, keepdims=True)
        ahead[:, i] = a
    out = np.empty_like(emit)
    back = np.ones((b, n))
    pairs = np.zeros((n, n))
    last = (lengths if lengths is not None else np.full(b, t)) - 1
    for i in range(t - 1, -1, -1):
        if lengths is not None:
            back[last <= i] = 1.0
        p = ahead[:, i] * back
        out[:, i] = p / p.sum(axis=1, keepdims=True)
        if i:
            e = emit[:, i] * back
            if lengths is None:
                joint = ahead[:, i - 1][:, :, None] * step[None] * e[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = e @ step.T
            back /= back.sum(axis=1, keepdims=True)
    return out, pairs


@dataclasses.dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray


def train(runs: dict[str, list[list[str]]], seed: int = 0) -> Model:
    """A model from runs of RUN words of each language."""
    languages = sorted(lang for lang, r in runs.items() if r)
    n, rng = len(languages), np.random.default_rng(seed)
    weights, moves = np.zeros((BUCKETS, n)), np.zeros((n, n))
    if n < 2:
        return Model(languages, weights, moves)
    pool = [(k, r) for k, lang in enumerate(languages) for r in runs[lang]]
    by_label = [np.array([i for i, (k, _) in enumerate(pool) if k == label]) for label in range(n)]
    vocabulary: dict[str, int] = {}
    ids = np.array([[vocabulary.setdefault(w, len(vocabulary)) for w in r] for _, r in pool])
    per_word = [np.array(features(w)) for w in vocabulary]
    labels = np.empty((CHAINS, CHAIN), dtype=np.int64)
    labels[:, 0] = rng.integers(0, n, CHAINS)
    for j in range(1, CHAIN):
        labels[:, j] = np.where(rng.random(CHAINS) < STAY, labels[:, j - 1], rng.integers(0, n, CHAINS))
    drawn = np.empty_like(labels)
    for label in range(n):
        at = labels == label
        drawn[at] = rng.choice(by_label[label], int(at.sum()))
    truth = np.repeat(labels, RUN, axis=1)
    words = ids[drawn].reshape(CHAINS, CHAIN * RUN)
    seen_w, seen_m = np.full_like(weights, 1e-2), np.full_like(moves, 1.0)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(CHAINS), max(1, CHAINS // BATCH)):
            distinct, place = np.unique(words[rows], return_inverse=True)
            parts = [per_word[i] for i in distinct.tolist()]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = np.concatenate(parts)
            emit = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)
            place = place.reshape(len(rows), -1)
            chance, pairs = marginals(emit[place], moves)
            wanted = np.eye(n)[truth[rows]]
            lead = wanted - chance
            by_word = np.stack([np.bincount(place.ravel(), lead[..., k].ravel(), len(distinct)) for k in range(n)], axis=1)
            spread = np.repeat(by_word, sizes, axis=0)
            grad = np.stack([np.bincount(flat, spread[:, k], BUCKETS) for k in range(n)], axis=1) / len(rows) - PULL * weights
            moved = np.zeros((n, n))
            np.add.at(moved, (truth[rows][:, :-1].ravel(), truth[rows][:, 1:].ravel()), 1.0)
            grad_m = (moved - pairs) / len(rows)
            seen_w += grad * grad
            seen_m += grad_m * grad_m
            weights += RATE * grad / np.sqrt(seen_w)
            moves += RATE * grad_m / np.sqrt(seen_m)
    return Model(languages, weights, moves)


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model from the documents that are not held out."""
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", F.col(label).alias("label")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).select("doc_id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, found = [], []
            for t, lang in zip(b.column(0), b.column(1).to_pylist()):
                words = words_of(t.as_py())
                starts = sorted({round(x) for x in np.linspace(0, len(words) - RUN, WINDOWS)}) if len(words) >= RUN else []
                names += [lang] * len(starts)
                found += [words[s : s + RUN] for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["label", "run"])

    # SAMPLE ids for each language at most; a repeated document stands once
    sample = docs.select("doc_id", text).join(F.broadcast(chosen.distinct()), "doc_id").dropDuplicates(["doc_id", "label"])
    runs: dict[str, list[list[str]]] = {}
    for r in sample.select(text, "label").mapInArrow(run, "label string, run array<string>").collect():  # SAMPLE * WINDOWS runs for each language at most
        runs.setdefault(r.label, []).append(r.run)
    return train({k: sorted(v) for k, v in runs.items()})


class Labeller:
    """A model with the emissions of words seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(model.languages)))

    def chances(self, run: list[str]) -> list[np.ndarray | None]:
        """Of each text the chances of each language at each word; None without words."""
        if len(self.place) > REMEMBERED:
            self.place.clear()
            self.known = self.known[:0]
        split = [words_of(t) for t in run]
        new = list(set().union(*split).difference(self.place)) if split else []
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.known = np.concatenate([self.known, emissions(self.model.weights, new)])
        at = [np.fromiter(map(self.place.__getitem__, s), np.int64, len(s)) for s in split]
        order = sorted((i for i, s in enumerate(split) if s), key=lambda i: len(split[i]))
        out: list[np.ndarray | None] = [None] * len(run)
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < 256 and len(split[order[end]]) <= 1.25 * len(split[order[start]]) + 8:
                end += 1
            rows = order[start:end]
            lengths = np.array([len(split[i]) for i in rows])
            padded = np.zeros((len(rows), int(lengths.max())), dtype=np.int64)
            for k, i in enumerate(rows):
                padded[k, : lengths[k]] = at[i]
            chance, _ = marginals(self.known[padded], self.model.moves, lengths)
            for k, i in enumerate(rows):
                out[i] = chance[k, : lengths[k]]
            start = end
        return out


def label(docs: DataFrame, model: Model, text: str = "text", with_words: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, and with_words the language of each word."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang_pred string, score double" + (", words array<string>" if with_words else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        names = held.value.languages
        for b in batches:
            pred, score, words = [], [], []
            for part in common.texts(b.column(1)):
                for c in labeller.chances(part) if names else [None] * len(part):
                    mean = None if c is None else c.mean(axis=0)
                    k = None if mean is None else int(mean.argmax())
                    pred.append(UNKNOWN if k is None else names[k])
                    score.append(0.0 if k is None else min(1.0, float(mean[k])))
                    if with_words:
                        words.append([] if c is None else [names[j] for j in c.argmax(axis=1)])
            cols = [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(words, pa.list_(pa.string()))] if with_words else []), names=["doc_id", "lang_pred", "score", *(["words"] if with_words else [])])

    return common.spread(docs.select(F.col("doc_id").cast("long"), text)).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = label(docs, fit(docs))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
