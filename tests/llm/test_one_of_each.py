"""Which rows of a component stay."""

from __future__ import annotations

from quire.llm import jaccard

COPY, OTHER, UNIQUE = "a b c d e f g h", "one two three four five six", "q r s t u v w x y z"


def _kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    return sorted((tuple(r) for r in kept.collect()), key=str)


def test_rows_are_decided_by_id_and_text(spark):
    rows = [
        (1, COPY, "a"), (None, COPY, "a"), (None, UNIQUE, "a"),  # a copy without an id and a unique text without one
        (None, OTHER, "a"), (None, OTHER.upper(), "a"),  # copies of one another, none with an id
        (5, COPY, "a"), (5, "five own words of this text", "a"),  # one id, one text a copy
        (6, "six own words and some more", "b"), (6, "six own words and some more", "a"),  # a repeated row
        (7, "", "a"), (8, "", "a"), (None, "", "a"), (None, None, "a"),
    ]
    kept = _kept(spark, rows)
    others = [r for r in kept if r[1] in (OTHER, OTHER.upper())]
    assert len(others) == 1 and others[0] in rows
    want = [rows[0], rows[2], rows[6], rows[8], *rows[9:]]
    assert [r for r in kept if r not in others] == sorted(want, key=str)
