"""Lines of any length are compared, with fewer edits for shorter ones."""

import random

import corpus_pipeline
from tests.llm import test_line_dedup as base
from vectrail.llm import line_dedup as d


def fixture():
    rng = random.Random(21)
    docs = [(0, None), (1, ""), (2, "a\nbc\n\nabcde\nabcdefg"), (3, "short\nshort"), (4, "short"), (5, "x" * 39 + "\nzz top")]
    heads = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (5, 6, 7, 9, 10, 12, 19, 20, 22, 38, 39, 40, 41) for _ in range(3)]
    for i in range(6, 50):
        docs.append((i, "\n".join(base.edited(rng, rng.choice(heads), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 4)))))
    return docs


def test_all_lines_equal_brute_force(spark):
    docs = fixture()
    df = base.frame(spark, docs)
    got = {((r.doc_id, r.line_no), (r.class_doc_id, r.class_line_no), r.n_links, r.keep) for r in d.classes(df).collect()}
    texts = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    want = base.slow(docs)
    assert got == want
    kept = {p for p, _, _, keep in want if keep}
    assert texts[4] != "short"
    for i, t in docs:
        assert texts[i] == (None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) in kept))
