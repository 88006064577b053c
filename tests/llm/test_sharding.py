"""Properties of shards: balance, gapless slots, groups of equal texts."""

import random
import zlib
from collections import Counter

from vectrail.llm import sharding as s


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1) for i, t, lang, src in rows], "doc_id bigint, text string, lang string, source string, size int")


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(s, "SLOT_BUCKET", 5)
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(1, 60) + str(i), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])) for i in range(900)]
    rows += [(1000 + i, "the same text in a great many rows", "en", rng.choice("abc")) for i in range(400)]
    rows += [(2000 + i, f"twin {i // 2}", "en", rng.choice("abc")) for i in range(60)] + [(3000, None, None, None), (3001, "", None, None), (3001, "", None, None), (None, "z", "en", "a")]
    got = s.with_slots(s.tree_shards(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(16))
    largest = max(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 4 * largest
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {i: t for i, t, *_ in rows}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    twins = {}
    for r in got:
        if r.doc_id is not None and 2000 <= r.doc_id < 3000:
            twins.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(v) > 1 for v in twins.values()) <= 2


def test_target_bytes_and_empty(spark):
    rows = [(i, "y" * 99, "en", "a") for i in range(64)]
    got = s.tree_shards(frame(spark, rows), target_bytes=1700).collect()
    assert Counter(Counter(r.shard for r in got).values()) == {16: 4}
    assert s.with_slots(s.tree_shards(frame(spark, []).limit(0))).collect() == []
