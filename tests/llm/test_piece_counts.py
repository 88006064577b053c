"""Automaton lengths against greedy matching."""

import random

import public_tokenizers

from vectrail.llm import piece_counts as p

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(entries, text):
    longest, counts = max(map(len, entries)), []
    for word in (text or "").encode().split():
        word, at, n = b" " + word, 0, 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in entries)
            n += 1
        counts.append(n)
    return len(counts), sum(counts), max(counts, default=0)


def test_small_vocabularies():
    rng = random.Random(3)
    for _ in range(30):
        entries = [bytes([b]) for b in range(256)] + [bytes(rng.choice(b" abc") for _ in range(rng.randint(2, 7))) for _ in range(25)]
        machine = p.Automaton(entries)
        texts = ["".join(rng.choice("abc  \n") for _ in range(rng.randint(0, 50))) for _ in range(40)]
        assert p.count(machine, texts) == [greedy(set(entries), t) for t in texts]


def test_frames(spark):
    entries = set(p.load_ranks(PATH))
    texts = [None, "", " \n", "plain words", "é" * 400, "x" * 5000, "a b", "日本 語\x0bt"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "a", 1)], "doc_id bigint, text string, n_words int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_pieces, r.most_pieces) for r in p.piece_counts(df, PATH).collect())
    assert got == sorted([(i, *greedy(entries, t)) for i, t in enumerate(texts)] + [(3, *greedy(entries, texts[3])), (-1, *greedy(entries, "a"))])
    assert p.piece_counts(df.limit(0), PATH).collect() == []
    assert [r.n_pieces for r in p.piece_counts(df.where("doc_id < 3"), PATH).collect()] == [0, 0, 0]
