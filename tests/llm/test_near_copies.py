"""Near copies against the Jaccard similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_simhash import slow_fingerprint
from vectrail.llm import near_copies


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def slow_kept(rows):
    held = {i: slow_set(t) for i, t in rows}
    kept, seen = [], set()
    for i in sorted(held):
        if i in seen:
            continue
        kept.append(i)
        waiting = [i]
        while waiting:
            at = waiting.pop()
            seen.add(at)
            waiting += [j for j in held if j not in seen and j not in waiting and alike(held[at], held[j])]
    return kept


@pytest.mark.parametrize("rounds", [0, near_copies.ROUNDS])
def test_stage_equals_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rng = random.Random(4)
    texts = [None, "", " \t", "One", "one", "One Two", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(12, 160))]
        texts.append(" ".join(base))
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(["x", "yy", "zzz"])
            texts.append(" ".join(words[: rng.choice([len(words), len(words) - 3])]))
    passage = " ".join(rng.choice("qrstuvw") * 2 for _ in range(30))
    texts += [passage + " " + " ".join(str(rng.random()) for _ in range(20)) for _ in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, (9, texts[9]), (None, "one")], "doc_id bigint, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    assert sorted(i for i in got if i is not None) == slow_kept(rows) and got.count(None) == 1
    fps, held = {i: slow_fingerprint(t) for i, t in rows}, {i: slow_set(t) for i, t in rows}
    assert any(alike(held[i], held[j]) and (fps[i] ^ fps[j]).bit_count() > 2 for i in held for j in held)


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "only here once", 0), (1, text, 0), (1, text, 1), (2, text + " more", 2), (2, "only there once", 2), (None, text, 3), (3, None, 4), (4, "", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, gone_doc int")
    out = near_copies.keep_one(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert got == [(0, text), (1, "only here once"), (1, text), (2, "only there once"), (3, "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_copies.classes(df).collect() == []
