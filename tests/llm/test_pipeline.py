"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_byte_bpe import other
from tests.llm.test_line_dedup import slow
from tests.llm.test_simhash import slow_components, slow_fingerprint

ITEM = "a quick question about seven green boats that cross the wide river before the sun sets over the far hills tonight"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["w" + "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    shared = line(60)
    for i in range(240):
        text = "\n".join(line(rng.randint(8, 20)) for _ in range(3))
        if i % 5 == 0:
            text = " ".join(w + (" slurone slurtwo" if n % 9 == 4 else "") for n, w in enumerate(text.split(" ")))
        if i % 7 == 1:
            text += "\n" + shared
        if i % 11 == 2:
            text += " " + ITEM
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(300, docs[1][1], "en", "s", docs[1][4]), (301, None, None, None, None), (302, "", "en", "s", 0), (303, "one short line", "en", "s", 14), (None, "nameless", "en", "s", 8)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        rows = {r.doc_id: r for r in out.collect()}
        if name != "byte_bpe":
            assert out.columns == names
        if name == "toxicity":
            assert before.keys() - rows.keys() == set(range(0, 240, 5))
        elif name == "line_dedup":
            kept = {p for p, _, _, keep in slow([(i, r.text) for i, r in before.items() if i is not None]) if keep}
            for i, r in before.items():
                want = r.text if i is None or r.text is None else "\n".join(t for n, t in enumerate(r.text.split("\n")) if (i, n) in kept)
                assert rows[i].text == want
            assert rows[300].text != before[300].text
        elif name == "simhash":
            classes = slow_components({i: slow_fingerprint(r.text) for i, r in before.items() if i is not None})
            assert {i for i in rows if i is not None} == set(classes.values()) and None in rows
        elif name == "decontaminate":
            assert before.keys() - rows.keys() == {i for i, r in before.items() if r.text and ITEM in r.text} != set()
        else:
            enc = other()
            for i, r in before.items():
                ids = np.array(enc.encode_ordinary(r.text or ""), dtype="<u4")
                assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
                assert rows[i].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
            assert corpus_pipeline.run(spark, folder).count() == len(rows)
        docs = corpus_pipeline.common.stored(out)
