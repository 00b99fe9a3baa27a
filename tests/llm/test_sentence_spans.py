"""Repeated stretches of short sentences."""

from __future__ import annotations

import random

from quire.llm import sentence_spans


def _texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in sentence_spans.without_repeats(docs).collect()}


def test_short_sentences_are_removed(spark):
    shouts = " ".join(f"{w}!!" for w in "come now and see our great new store before winter ends today".split())
    mixed = "We saw it all there on that day. Yes. No. Why not? Go on. It was the best of all of our days. So be it. Amen."
    han = "春天来了花开满园\n大家都很高兴\n一起去公园散步"
    alone = "Yes. No. Why not? Go on."  # under ten words together
    texts = [f"Own words open this one text here.\n{part}\nOther words close it." for part in (shouts, mixed, han)]
    copies = [f"Then another opening of its own.\n{part}\nLast line is different again." for part in (shouts, mixed, han)]
    got = _texts(spark, [*texts, *copies, f"A text of its own. {alone}"])
    assert [got[i] for i in (1, 2, 3)] == texts
    assert [got[i] for i in (4, 5, 6)] == ["Then another opening of its own.\nLast line is different again."] * 3
    assert got[7] == f"A text of its own. {alone}"


def test_repeated_stretches_are_covered_to_both_ends():
    draw = random.Random(5)
    for _ in range(300):
        sizes = [draw.choice((1, 1, 2, 3, 9)) for _ in range(draw.randrange(2, 14))]
        a = draw.randrange(len(sizes))
        b = draw.randrange(a, len(sizes)) + 1
        start, stop = sentence_spans._bounds(sentence_spans.np.array(sizes))
        covered = {i for s, e in zip(start, stop) if a <= s and e <= b for i in range(s, e)}
        whole = b - a >= 2 and sum(sizes[a:b]) >= sentence_spans.LEAST_WORDS
        assert covered == (set(range(a, b)) if whole else set())


def test_passages_go_and_phrases_stay(spark):
    phrase = "All rights reserved by the author of this text. Ask before you copy any of it."
    passage = " ".join(f"In sentence number {i} the old sailor told another part of his story." for i in range(5))
    texts = [f"Opening words of this one here.\n{phrase}\n{passage}\nIts end.", f"A different start for that one.\n{phrase}\nSome words between.\n{passage}\nLast words."]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentence_spans.without_repeats(docs, sentence_spans.PASSAGE).collect()}
    assert got[1]["text"] == texts[0] and got[2]["text"] == f"A different start for that one.\n{phrase}\nSome words between.\nLast words."
    assert got[2]["n_removed"] == 5


def test_runs_of_any_length_can_be_asked_for(spark):
    docs = spark.createDataFrame([(1, "Yes. No. Own words of one."), (2, "Other words here. Yes. No.")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in sentence_spans.without_repeats(docs, least=0).collect()}
    assert got == {1: "Yes. No. Own words of one.", 2: "Other words here. "}
    assert all(r["n_removed"] == 0 for r in sentence_spans.without_repeats(docs).collect())
