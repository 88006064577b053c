"""Decontamination against hand-made cases and plain containment."""

import random
import re
from pathlib import Path

from vectrail.llm import decontaminate as d

ITEM = "A train leaves the old station with 12 passengers and Anna pays 30 dollars for 5 km of travel. How much does Anna owe in total now?"


def run(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string, hash string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): (r.covered, r.exact) for r in d.contained(docs, bench).collect()}, docs, bench


def test_exact_and_changed_questions(spark):
    changed = ITEM.replace("12", "77").replace("Anna", "Boris").replace("30", "45").replace("5 km", "9 miles")
    crossed = ITEM.replace("Anna pays", "Boris pays")  # one name became two
    texts = [
        "Some words before it. " + ITEM + " And after it.",
        ("x%%% " + ITEM.upper() + "!! ") * 50,
        changed,
        crossed,
        "A train leaves the old station with nothing to say about the rest of the day at all",
        None,
        "",
        ITEM[:20],
    ]
    found, docs, bench = run(spark, texts, [ITEM, "short one", None, ""])
    assert {k[0] for k in found} >= {0, 1, 2} and all(k[1] == 0 for k in found)
    assert not {4, 5, 6, 7} & {k[0] for k in found}
    assert found[0, 0] == (1.0, True)
    assert found[2, 0][0] == 1.0 and not found[2, 0][1]
    assert found.get((3, 0), (0, None))[0] < 1.0
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {4, 5, 6, 7} <= {r.doc_id for r in kept.collect()}


def test_items_of_numbers_and_repeated_items(spark):
    sums, units = "Compute 12 + 7 * 45 - 3 then 9 / 3 and 88", "Evaluate 12 apples minus 30"
    verse = "row the boat gently down the long stream. " * 6
    texts = [sums, "Say: " + units.replace("12", "twelve") + "!", verse, "Compute 12 + 7 * 45 - 3 then 9 / 3 and 89 " * 2, "Yes, no.", "Yes, no, perhaps.", "now " + sums.upper()]
    found, _, _ = run(spark, texts, [sums, units, verse, "yes no"])
    assert {k for k, v in found.items() if v == (1.0, True)} == {(0, 0), (1, 1), (2, 2), (4, 3), (6, 0)}
    assert not {k for k in found if k[0] == 5}


def test_rows_without_ids_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, ITEM), (7, ITEM), (7, "clean words"), (None, "clean words"), (8, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, ITEM), (3, "some other item of plain words that nobody holds"), (3, None)], "item_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in d.decontaminate(docs, bench).collect()) == [(0, "clean words"), (7, "clean words"), (8, "")]
    assert [(r.item_id, r.covered) for r in d.contained(docs, bench).where("doc_id = 7").collect()] == [(None, 1.0)]


def test_very_long_text_and_repeated_rows(spark):
    long = "filler words go on " * 60_000 + ITEM + " and more filler" * 60_000
    found, docs, bench = run(spark, [long, long, "filler words go on"], [ITEM, ITEM])
    assert {k: v for k, v in found.items()} == {(i, j): (1.0, True) for i in (0, 1) for j in (0, 1)}


def test_slots_equal_a_plain_matcher(spark):
    """Questions over one template, with slots filled at random: held if the item's values map one to one to the document's."""
    rng = random.Random(6)
    names, numbers = ["Anna", "Boris", "Clara"], ["3", "14", "159"]
    fill = lambda: [rng.choice(names), rng.choice(numbers), rng.choice(names), rng.choice(numbers)]
    shape = "when {} took the {} small round cakes to {} there were only {} cakes left"
    items, docs = [fill() for _ in range(12)], [fill() for _ in range(60)]
    found, _, _ = run(spark, ["So " + shape.format(*x) for x in docs], [shape.format(*x) for x in items])
    digests = {}
    for i, x in enumerate(docs):
        for j, y in enumerate(items):
            pairs = set(zip(y, x))
            one_to_one = len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
            digests[i, j] = one_to_one
            if one_to_one:
                assert found[i, j] == (1.0, x == y)
            else:
                assert found.get((i, j), (0.0, False))[0] < 1.0
    assert any(digests.values()) and not all(digests.values())


def test_nothing_to_search(spark):
    assert run(spark, [ITEM], [])[0] == {}
    assert run(spark, [], [ITEM])[0] == {}


def test_equals_plain_containment_on_whole_words(spark):

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        return
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    found = {(r.doc_id, r.item_id) for r in d.contained(docs, bench).collect()}
    assert whole and whole <= found and len(found - whole) <= 0.1 * len(whole) + 1
