"""Copies that typed windows cannot see."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.llm import decontamination

WORDS = "river stone garden window market engine bridge winter summer doctor teacher music paper silver forest candle".split()
QUESTION = "A train leaves Oslo with 120 passengers and travels 60 km to reach Bergen before the evening ferry departs with 120 people"
NAMES = "Anna Berta Carla Dora Emma Frida Greta Hanna 12 Ida Jana 31 Klara"


def _found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.leaks(docs, table).collect()}


def test_copies_in_another_case(spark):
    texts = [
        f"intro {QUESTION.upper()} end", f"intro {QUESTION.lower()} end", QUESTION.upper().replace("60 KM", "75 KM"),
        f"so {NAMES} there", f"so {NAMES.upper()} there", "so Anna Berta 12 Ida there are Carla Dora 31 Klara and Emma Frida Greta Hanna",
        "9 8 7 6 5 4 3 2 1 0", "1 2 3 4 5 6 7 8 9 0", "NOTHING OF THIS IS IN ANY ITEM AT ALL SO IT STAYS",
    ]
    found = _found(spark, texts, [QUESTION, NAMES, "1 2 3 4 5 6 7 8 9 0"])
    assert found == {
        (0, 1): "verbatim", (1, 1): "verbatim", (2, 1): "reparameterised",
        (3, 2): "verbatim", (4, 2): "verbatim", (7, 3): "verbatim",
    }


def test_one_conflict_leaves_the_rest_of_a_diagonal(spark):
    item = "The old ferry leaves Oslo at noon with 120 guests and 45 crates while slow winds push it far out to sea. The crew of Oslo then counts 120 sails"
    texts = [
        item.replace("The crew", "A crew"), item.replace("Oslo then", "Olso then"),
        item.replace("120", "80").replace("45", "80").replace("Oslo", "Rome"),
        " ".join(f"w{i}" if i % 4 == 0 else w for i, w in enumerate(item.split())),
    ]
    assert {d for d, _ in _found(spark, texts, [item])} == {0, 1, 2}


def test_majority_of_a_diagonal():
    name, num = decontamination.NAME, decontamination.NUMBER
    window = lambda place, *slots: (place, " ".join([*(k for k, _, _ in slots), "word"]), [a for _, a, _ in slots], [b for _, _, b in slots])
    met = [window(9 * i, (name, "Oslo", to)) for i, to in enumerate(["Rome", "Rome", "Pisa", "Oslo"])]
    assert decontamination.consistent(met) == ([0, 9, 27], 1)
    assert decontamination.consistent([window(0, (num, "1", "7"), (num, "2", "7"))]) == ([0], 2)
    assert decontamination.consistent([window(0, (name, "A", "X")), window(9, (name, "B", "X")), window(18, (name, "B", "X"))]) == ([9, 18], 1)


def test_a_phrase_of_many_items_does_not_pair_them_all(spark):
    phrase = "please read the following text with care and then answer the question that stands below it"
    rng = random.Random(11)
    own = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(10)) + rng.choice("abcdef") for _ in range(40))
    items = [(i, f"{phrase} {own()}") for i in range(60)]
    docs = [(i, f"{own()} {phrase} {own()}") for i in range(60)] + [(100 + i, f"{own()} {items[i][1]} {own()}") for i in range(5)] + [(None, items[7][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    windows = decontamination.item_windows(bench)
    sent = windows.select(F.lit(1).alias("doc_id"), F.lit(1).alias("text_hash"), "template", "hash", "words").where("words like 'please%'").distinct()
    # a text that holds the phrase's first windows alone is nominated for no item
    assert sent.count() >= 2 and decontamination._nominated(sent, windows, decontamination.COVERAGE).count() == 0
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()}
    assert found == {(100 + i, i) for i in range(5)} | {(None, 7)}


def test_short_items_can_be_asked_for(spark):
    docs = spark.createDataFrame([(1, "he asked: Capital of France? and left"), (2, "the capital of Spain"), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "capital of France"), (2, "What is it")], "item_id long, text string")
    assert decontamination.leaks(docs, items).count() == 0
    found = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.leaks(docs, items, shortest=1).collect()}
    assert found == {(1, 1): "verbatim", (2, 1): "reparameterised"}
