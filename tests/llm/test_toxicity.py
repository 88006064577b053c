"""Segments, counts, evidence and decay against brute force, and held-out accuracy on invented documents."""

import itertools
import math
import random

import numpy as np
import pytest

from vectrail.llm import toxicity as t


def slow_segments(scores):
    """Maximal segments by their definition: the best range (of equal ones the longest), then the same to its left and right."""

    def best(a, b):
        ranges = ((sum(scores[i : j + 1]), j - i, -i) for i in range(a, b) for j in range(i, b))
        total, size, start = max(ranges, default=(0, 0, 0))
        if total <= 0:
            return []
        i = -start
        return best(a, i) + [(i, i + size, total)] + best(i + size + 1, b)

    return best(0, len(scores))


def test_segments_equal_their_definition():
    rng = random.Random(2)
    for _ in range(150):
        scores = [rng.choice([-0.1, -0.1, -0.4]) + rng.choice([0, 0, 0, 0.3, 0.9, 1.7]) + rng.random() / 1000 for _ in range(rng.randrange(1, 35))]
        got = t.segments(np.array(scores))
        want = slow_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert t.segments(np.zeros(0)) == []


def test_evidence_is_the_least_poisson_tail():
    rng = random.Random(3)
    model = t.Model({}, 0.0, 0.8, 0.002, threshold=1.0)
    for _ in range(50):
        n, scores = rng.randrange(1, 3000), [rng.random() * 9 for _ in range(rng.randrange(1, 7))]
        tails = []
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            e = (1 + 0.002 * n) * math.exp(-0.8 * s)
            if r == 1 or s > 1.0 and e < r:
                tails.append(sum(math.exp(-e) * e**k / math.factorial(k) for k in range(r, 80)))
            else:
                break
        assert model.evidence(scores, n) == pytest.approx(-math.log(min(tails)), abs=0.1)
    assert model.evidence([], 5) == 0.0 and model.evidence([3000.0, 1.0], 5) > 2000


def test_tail_of_known_excesses(spark):
    rows = [(100, [3.0, 1.5, 0.2]), (300, []), (600, [2.0])]
    decay, rate = t.tail_of(spark.createDataFrame(rows, "n bigint, segments array<double>"), 1.0)
    assert decay == pytest.approx(4 / (2 + 0.5 + 1 + 1)) and rate == pytest.approx(0.003 * math.exp(decay))


def test_counts_and_stems_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [(" ".join(rng.choice(["abcdefg", "abcdxy", "abq", "xyzabc", "qqabc", "to", "be"]) for _ in range(30)), rng.randrange(2), rng.randrange(2)) for _ in range(40)] + [("", 1, 0), (None, 0, 1)]
    sides = {}
    for text, toxic, half in docs:
        words = t.words_of(text or "")
        for i, w in enumerate(words):
            sides.setdefault((words[i - 1] if i else "", w, words[i + 1] if i + 1 < len(words) else ""), set()).add((toxic, half))
    want = {}
    for (_, w, _), held in sides.items():
        row = want.setdefault(w, [0] * 6)
        for k, side in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)]):
            row[k] += side in held
        row[4] += any(not x for x, _ in held)
        row[5] += any(x for x, _ in held)
    words = t.counted(spark.createDataFrame(docs, "text string, toxic int, half int")).cache()
    assert {r.w: [r[c] for c in t.COUNTS] for r in words.collect()} == want
    skewed = words.withColumn("toxic", words.toxic * 40)
    rows = [(r.w, r.toxic, r.clean) for r in skewed.collect()]
    stems = t.stem_odds(rows, -2.0) | t.stem_odds(rows, -2.0, t.endings)
    known = t.learned(skewed, [-2.0, -2.0, -2.0])
    assert known[2] == stems | t.word_odds(rows, stems, -2.0) and "abc-" in stems and "-abc" in stems


def test_log_odds_move_only_as_far_as_they_are_sure():
    assert t.moved(-2.0, 0, 0) == t.moved(-2.0, 1, 2) == -2.0
    up, down = t.moved(-2.0, 50, 0), t.moved(-2.0, 0, 5000)
    assert up > 0 and down < -2.0
    for toxic, clean in itertools.product([0, 3, 30, 300], repeat=2):
        n = toxic + clean + t.PRIOR
        p = (toxic + t.PRIOR / (1 + math.exp(2))) / n
        step, error = t.logit(p) + 2, t.SURE / math.sqrt(n * p * (1 - p))
        want = 0 if abs(step) <= error else step - math.copysign(error, step)
        assert t.moved(-2.0, toxic, clean) == pytest.approx(want - 2.0)


def corpus(spark, n=400):
    rng = random.Random(4)
    words = ["w" + "".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(80)]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["slurone", "slurtwo", "slur" + str(i)]))
        rows.append((i, " ".join(text), "clash", 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "clash", 0.5), (1001, "", "clash", 0.5), (None, "slurone", "clash", 0.5)]
    labels += [(2000, 1), (3, None), (None, 1), (7, 5), labels[0]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic string, score double"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_documents(spark):
    docs, labels = corpus(spark)
    model = t.fit(docs, labels)
    scores = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    assert len(scores) == docs.count() and all(0.0 <= s <= 1.0 for s in scores.values())
    held = [r.doc_id for r in labels.where("doc_id < 400").where(t.remainder(labels.doc_id, t.HELD_OUT) == 0).collect()]
    assert len(held) > 40 and all((scores[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert scores[1000] == scores[1001] < 0.5
    clean = t.keep_clean(docs, model)
    assert clean.schema == docs.schema
    kept = {r.doc_id for r in clean.collect()}
    assert {1000, 1001} <= kept and not kept & set(range(0, 400, 4)) and len(kept & set(range(400))) == 300


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 20)
    assert all(r.score < 0.5 for r in t.score(docs, t.fit(docs, labels.limit(0))).collect())
    assert t.score(docs.limit(0), t.fit(docs.limit(0), labels)).collect() == []
