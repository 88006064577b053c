"""Round trips, and the ids of another library."""

import random

import numpy as np
import public_tokenizers
import tiktoken

from vectrail.llm import byte_bpe as b

TEXTS = [None, "", " ", "  ", "a  b", "a   b \n\n c", "x \t y", "end ", "end\t ", "it's 12,345.67 we'll", "<|endoftext|>", "é😀日本‍́", "a" * 3000, "\x1c\x85  z", "Éé's ½²", "word." * 10]


def other():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.load_ranks(b.vocabulary_path()), special_tokens={})


def texts():
    rng = random.Random(1)
    return TEXTS + ["".join(rng.choice("ab é  .,'s1\n\t😀日") for _ in range(rng.randint(1, 60))) for _ in range(300)]


def test_ids_and_bytes():
    codec, enc = b.codec(b.vocabulary_path()), other()
    for run in (texts(), texts()[::-1]):  # the second time from memory
        for t, raw in zip(run, codec.encode([t or "" for t in run])):
            assert np.frombuffer(raw, "<u4").tolist() == enc.encode_ordinary(t or "")
            assert codec.decode(raw) == (t or "").encode()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(b, "CACHE_ENTRIES", 5)
    codec, enc = b.Codec(b.vocabulary_path()), other()
    for t in texts():
        assert np.frombuffer(codec.encode([t or ""])[0], "<u4").tolist() == enc.encode_ordinary(t or "")
        assert len(codec.words) < 200 and not any(len(w) > b.CACHE_CHARS for w in codec.words)


def test_offsets_of_split_characters():
    codec = b.codec(b.vocabulary_path())
    raw = codec.encode(["é😀a"])[0]
    assert codec.offsets(raw) == [(0, 1), (1, 2), (1, 2), (2, 3)]


def test_frames(spark):
    rows = [(i, t, 5, "clash") for i, t in enumerate(TEXTS)] + [(0, None, 5, "clash"), (None, "x", 5, "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids string")
    path = b.vocabulary_path()
    ids = b.encode(df, path, with_offsets=True)
    assert ids.count() == len(rows)
    back = {r.doc_id: bytes(r.raw).decode() for r in b.decode(ids, path).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}
    found = b.digests(df, path).collect()
    assert len(found) == len(rows) and sum(r.n_tokens == 0 for r in found) == 3
    assert b.digests(df.limit(0), path).collect() == []
