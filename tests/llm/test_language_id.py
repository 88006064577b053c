"""Forward-backward against all label sequences, and held-out accuracy on invented languages."""

import itertools
import random

import numpy as np
import pytest

from vectrail.llm import language_id as g


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    got, _ = g.marginals(scores, moves, lengths)
    for c, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[c, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[c, :n], want / want.sum(axis=1, keepdims=True))


def text(rng, lang, n):
    parts = {"aa": ["tha", "ing", "er", "wh"], "bb": ["sch", "ü", "keit", "ein"], "cc": ["ção", "lh", "os", "ado"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(8, 60)), lang, "clash") for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(1000, None, "aa", "clash"), (1001, "", None, "clash"), (1002, "12 34 ²!", "bb", "clash"), (1003, text(rng, "aa", 9000), None, "clash"), (None, text(rng, "bb", 9), "bb", "clash")]
    rows += [(1004, text(rng, "aa", 30) + " " + text(rng, "cc", 30), None, "clash"), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")


def test_held_out_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(g, "CHAINS", 1500)
    model = g.fit(docs)
    assert model.languages == ["aa", "bb", "cc"]
    found = g.label(docs, model, with_words=True).collect()
    assert len(found) == docs.count()
    rows = {r.doc_id: r for r in found}
    held = [r.doc_id for r in docs.where("doc_id < 240").where(g.remainder(docs.doc_id, g.FOLDS) == g.HELD_OUT).collect()]
    assert np.mean([rows[i].lang_pred == ["aa", "bb", "cc"][i % 3] for i in held]) > 0.97
    assert all((rows[i].lang_pred, rows[i].score) == (g.UNKNOWN, 0.0) for i in (1000, 1001, 1002))
    assert rows[1003].lang_pred == "aa" and len(rows[1003].words) == 9000
    mixed = rows[1004].words
    assert np.mean([w == "aa" for w in mixed[:30]]) > 0.9 and np.mean([w == "cc" for w in mixed[30:]]) > 0.9


def test_nothing_to_learn(spark, docs):
    model = g.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in g.label(docs.limit(5), model).collect()} == {g.UNKNOWN}
    assert g.label(docs.limit(0), g.fit(docs.limit(0))).collect() == []
