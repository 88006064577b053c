"""SimHash classes against a comparison of all pairs."""

import random

import numpy as np
import xxhash

from vectrail.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_words_at_distance_one_share_a_codeword():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 1 << 23, 5000)
    near = words ^ (1 << rng.integers(0, 23, 5000))
    a, b = simhash.codeword_indices(words), simhash.codeword_indices(near)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(400)) for _ in range(4)]
    texts = [None, "", " \t", "One", "one", "One Two", "one\x0btwo", base[0].upper()]
    for b in base:
        for _ in range(25):
            words = b.split(" ")
            words[rng.randrange(len(words))] = rng.choice(["x", "yy", "zzz"])
            texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(9, texts[9]), (9, texts[9])]
    df = spark.createDataFrame([(i, t, "extra", "c") for i, t in rows], "doc_id bigint, text string, fp string, component_id string")
    got = simhash.classes(df).collect()
    fps = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(fps)
    assert len(got) == len(rows)
    assert all(r.fp % 2**64 == fps[r.doc_id] and r.component_id == want[r.doc_id] for r in got)


def test_hot_keys_link_the_same_rows(spark, monkeypatch):
    rng = random.Random(5)
    fps = {i: sum(1 << b for b in rng.sample(range(43, 64), 2)) for i in range(120)}
    least = {v: i for i, v in reversed(fps.items())}
    rows = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v, i) for v, i in least.items()], "fp bigint, node bigint")
    want = slow_components({r.node: r.fp % 2**64 for r in rows.collect()})
    for hot in (2, 1000):
        monkeypatch.setattr(simhash, "HOT", hot)
        found = {r.node: r.component for r in simhash.components(simhash.links(rows)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.classes(df).collect() == []
