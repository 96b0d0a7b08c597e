import random

import pytest

from counterpoise.llm import decontaminate
from counterpoise.llm.common import words

ITEMS = "item_id string, text string"


def brute(doc, items, window):
    mask, found = [False] * len(doc), set()
    for name, seq in items:
        size = min(window, len(seq))
        for j in range(len(seq) - size + 1 if seq else 0):
            for i in range(len(doc) - size + 1):
                if doc[i : i + size] == seq[j : j + size]:
                    found.add(name)
                    mask[i : i + size] = [True] * size
    return mask, found


def test_automaton_is_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        letters, window = rng.choice([2, 3, 6]), rng.choice([2, 3, 4])
        items = [(str(i), [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(9))]) for i in range(rng.randrange(4))]
        doc = [b"%d" % rng.randrange(letters + 1) for _ in range(rng.randrange(25))]
        stretches, found = decontaminate.Automaton(items, window).find(doc)
        mask = [any(a <= k < b for a, b in stretches) for k in range(len(doc))]
        assert (mask, found) == brute(doc, items, window)


@pytest.mark.parametrize("shard_words", [100_000, 5])
def test_find(spark, shard_words):
    long = " ".join(f"w{i}" for i in range(60_000))
    items = spark.createDataFrame([("7", "One two, three FOUR five"), ("12", "w17 w18 w19 w20 w21 w22"), ("x", None), ("y", ""), ("z", "alpha beta"), (None, "q r s t"), ("7b", "two three four five")], ITEMS)
    docs = spark.createDataFrame(
        [(1, "zero one two three four five six"), (2, "two three"), (3, None), (4, ""), (5, long), (6, "beta alpha-beta. alpha"), (1, "zero one two three four five six"), (None, "alpha beta")],
        "doc_id int, text string",
    ).selectExpr("doc_id", "text", "doc_id as row")
    got = decontaminate.find(docs, items, window=4, shard_words=shard_words)
    assert got.columns == ["doc_id", "text", "row", "n_words", "stretches", "items"]
    want = [(r["item_id"], words(r["text"])) for r in items.collect() if r["item_id"] is not None]
    rows = got.collect()
    assert len(rows) == 8
    for r in rows:
        mask, found = brute(words(r["text"])[:100], want, 4)
        assert r["items"] == sorted(found)
        assert sum(s["b"] - s["a"] for s in r["stretches"]) == sum(mask)
        assert r["n_words"] == len(words(r["text"]))


def test_empty_items_and_docs(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.find(docs, none).first()["stretches"] == []
    some = spark.createDataFrame([("i", "a b c")], ITEMS)
    assert decontaminate.find(docs.limit(0), some).count() == 0
    assert decontaminate.remove(docs, none).collect() == docs.collect()


def test_remove_cuts_spans_and_drops_mostly_covered(spark):
    items = spark.createDataFrame([("i", "eins zwei drei vier")], ITEMS)
    docs = spark.createDataFrame([(1, "Vor: Eins, zwei\ndrei vier! nach und mehr é", 9), (2, "eins zwei drei vier", 9), (3, "nichts", 9), (4, None, 9)], "doc_id int, text string, items int")
    got = {r["doc_id"]: (r["text"], r["items"]) for r in decontaminate.remove(docs, items, min_words=4).collect()}
    assert got == {1: ("Vor: ! nach und mehr é", 9), 3: ("nichts", 9), 4: (None, 9)}
