"""Line classes against the edit distance of all pairs."""

import random

from vectrail.llm import line_dedup as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow(docs):
    places = sorted(((i, n), line.strip(" \t\r")) for i, t in docs if t is not None for n, line in enumerate(t.split("\n")))
    parent = {}
    for _, line in places:
        parent[line] = line

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = sorted(parent)
    links = dict.fromkeys(texts, 0)
    for n, a in enumerate(texts):
        for b in texts[n + 1 :]:
            most = min(d.EDITS, len(min(a, b, key=len)) // d.CHARS)
            if most and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    first = {}
    for place, line in places:
        first.setdefault(root(line), place)
    return {(place, first[root(line)], links[line], not line or place == first[root(line)]) for place, line in places}


def edited(rng, line, times):
    for _ in range(times):
        at = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        line = line[:at] + ("" if kind == 0 else rng.choice("xyé ")) + line[at + (kind != 1) :]
    return line


def fixture():
    rng = random.Random(11)
    words = ["alpha", "bé", "gamma", "delta", "of", "the", "日本", "omega"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 14))) for _ in range(12)]
    docs = [(0, None), (1, ""), (2, "\n\n"), (3, "short\nshort"), (4, "short"), (5, "a\n\nbcd\nfifteen letters"), (6, "a\nbce\nfifteen lettres\nfifteen letter")]
    for i in range(7, 70):
        docs.append((i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randint(1, 4)))))
    docs += [(100 + i, "This line stands in a great many documents, word for word.\r") for i in range(60)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", len(t or ""), "clash", "clash") for i, t in docs], "doc_id bigint, text string, lang string, n_chars bigint, k string, line string")


def test_distance_within_a_band(spark):
    rng = random.Random(17)
    rows = []
    for _ in range(400):
        line = "".join(rng.choice("abé日😀 ") for _ in range(rng.choice([1, 2, 3, 10, 70, 300])))
        other = edited(rng, line, rng.choice([0, 1, 2, 2, 3, 4]))
        a, b = sorted((line, other), key=len)
        if a and len(b) - len(a) <= d.EDITS:
            rows += [(a, b, len(a), len(b), e, distance(a, b) <= e, distance(a, b)) for e in range(d.EDITS + 1)]
    got = spark.createDataFrame(rows, "a string, b string, n int, m int, e int, want boolean, flips int")
    assert got.where("want").count() > 100 < got.where("not want").count()
    assert got.where(d.within(got.a, got.b, got.n, got.m, got.e) != got.want).count() == 0
    assert got.where(~d._near(d.signature(got.a), d.signature(got.b), got.flips)).count() == 0


def test_classes_equal_brute_force(spark):
    docs = fixture()
    got = d.classes(frame(spark, docs)).collect()
    want = slow(docs)
    assert len(got) == len(want)
    assert {((r.doc_id, r.line_no), (r.class_doc_id, r.class_line_no), r.n_links, r.keep) for r in got} == want


def test_texts_without_repeats(spark):
    docs = fixture()
    df = frame(spark, docs)
    kept = {p for p, _, _, keep in slow(docs) if keep}
    out = d.without_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: r for r in out.collect()}
    for i, t in docs:
        want = None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) in kept)
        assert got[i].text == want and got[i].n_chars == len(want or "")


def test_repeated_rows_and_nameless_rows(spark):
    long = "A line that is long enough to be compared with other lines."
    df = spark.createDataFrame([(1, long), (1, long), (2, long + "!"), (None, "x"), (None, None), (3, "x\nonly here"), (3, "only there\nx\nand\nwords of it")], "doc_id bigint, text string")
    df = df.withColumn("gone", df.doc_id).withColumn("line_doc", df.doc_id)
    out = d.without_repeats(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id or -1, r.text) for r in out.collect() if r.text is not None)
    assert got == [(-1, "x"), (1, long), (1, long), (2, ""), (3, "only here"), (3, "only there\nand\nwords of it")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert d.classes(df).collect() == [] and d.without_repeats(df).collect() == []


def test_versions_of_one_line(spark):
    rng = random.Random(13)
    head = "the beginning of this line stands in a great many versions of one and the same text"
    lines = {edited(rng, f"{head} and ends {rng.choice(['soon', 'so', 'son', 'not'])} {rng.choice(['here', 'there', 'hero'])}", rng.choice([0, 1, 2])) for _ in range(60)}
    docs = list(enumerate(sorted(lines)))
    got = d.classes(frame(spark, docs)).collect()
    assert {((r.doc_id, r.line_no), (r.class_doc_id, r.class_line_no), r.n_links, r.keep) for r in got} == slow(docs)


def test_each_key_is_worked_out_once(spark, monkeypatch):
    """The filter by shared keys computed the key of a place twice, and its row once more; substrings walked through the line's characters."""
    plans, stored = {}, d.common.stored
    monkeypatch.setattr(d.common, "stored", lambda df, what: plans.update({what: df._jdf.queryExecution().optimizedPlan().toString()}) or stored(df, what))
    docs = spark.createDataFrame([(1, "eine Zeile mit Wörtern\nund noch eine"), (2, "eine Zeile mit Worten")], "doc_id bigint, text string")
    d.links(d.lines_of(docs)).collect()
    found = plans["live-lines"]
    assert found.count("xxhash64(substring(") == 1 and "xxhash64(substring(line" not in found
