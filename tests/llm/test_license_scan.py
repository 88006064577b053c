"""Places and spans against plain search."""

import random
import re

from pyspark.sql import functions as F

from vectrail.llm import license_scan as s


def slow_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_places(words):
    return sorted((k, i) for k, p in enumerate(s.PHRASES) for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def test_places_equal_plain_search():
    rng = random.Random(5)
    pool = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "licensed", "under", "x", "é", "K", "cc-by", "ALL"]
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        tokens = s.words(text)
        assert [t.decode() for t in tokens] == slow_words(text)
        assert sorted(s.standard().scan(tokens)[0]) == slow_places(slow_words(text))


def test_matching_statistics():
    rng = random.Random(6)
    sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(12)] for _ in range(3)]
    m = s.Automaton(sequences)
    held = {tuple(q[i:j]) for q in sequences for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
    for n in range(1, 6):
        for _ in range(60):
            run = tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(n))
            v, ok = 0, True
            for w in run:
                v = m.arcs[v].get(m.number.get(w), -1)
                if v < 0:
                    ok = False
                    break
            assert ok == (run in held)


def test_spans_survive_changes():
    label, template = s.TEMPLATES[1]
    words = template.split()
    changed = words[:10] + ["extra", "words"] + words[10:20] + words[22:]
    spans = s.standard().scan([w.encode() for w in ["before"] * 5 + changed + ["after"]])[1]
    assert [x[0] for x in spans] == [label] and spans[0][1] == 5 and spans[0][3] > 0.85
    assert s.standard().scan([w.encode() for w in words[:8]])[1] == []


def test_frames(spark):
    texts = [None, "", "no words of law", "Licensed under CC BY-NC 4.0.", "All rights\nreserved. ALL RIGHTS RESERVED", "released under the MIT license " * 200]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(4, texts[4], "clash"), (None, texts[3], "clash")], "doc_id bigint, text string, labels string")
    got = s.scan(df)
    assert got.count() == 8
    rows = {r.doc_id: r for r in got.withColumn("n", F.size("places")).collect()}
    assert rows[0].n_words == 0 and rows[0].n == 0 and rows[2].spans == []
    assert rows[3].n == 1 and {x.label for x in rows[3].spans} == {"cc-by-nc-4.0"} and rows[4].n == 2
    assert len(rows[5].spans) >= 1
    assert s.scan(df.limit(0)).collect() == []
