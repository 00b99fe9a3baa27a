"""Stages keep a user's columns, whatever their names and types; repeated ids teach once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import language, quality
from quire.llm.common import one_text

OWN = [
    "n", "row", "_doc", "_hash", "_m", "_w", "_p", "_copies", "_copy", "_more", "_source", "_found", "bucket", "key", "size", "best", "cls",
    "text_hash", "kept_id", "kept_hash", "leak_id", "leak_hash", "comp", "a.dotted name", "with`tick",
]
TEXT = "the quick brown fox jumps over the lazy dog and runs through the wide green field again {}"


def _docs(spark):
    rows = [(i, TEXT.format(f"number {i} of many other words {i * 7} here {i * 13} and {i * 3} there"), "en", f"s{i % 3}", 10) for i in range(30)]
    rows += [(30, TEXT.format("x"), "en", "s0", 10), (31, TEXT.format("x"), "en", "s1", 10), (31, TEXT.format("x"), "en", "s1", 10)]
    rows += [(None, TEXT.format("other words altogether in this one, none of them met before"), "en", None, None), (32, "", "en", "s0", 0), (33, None, None, "s0", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({f"{c}": F.lit(f"own {c}") for c in OWN if "." not in c and "`" not in c})
    return docs.select("*", F.lit("own a.dotted name").alias("a.dotted name"), F.lit("own with`tick").alias("with`tick"), F.create_map(F.lit("k"), F.col("doc_id")).alias("map"))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_own_columns(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, "What is the capital of Australia and how many people live there in 1990?")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    docs = _docs(spark)
    out = stage(spark, docs, str(tmp_path))
    more = ["shard"] if name == "sharding" else []
    assert out.columns == docs.columns + more
    rows = out.collect()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert rows
    for r in rows:
        assert (r["doc_id"], r["text"]) in texts
        assert all(r[c] == f"own {c}" for c in OWN) and r["map"] == {"k": r["doc_id"]}
    if name == "jaccard_join":
        assert sorted(r["doc_id"] for r in rows if r["text"] == TEXT.format("x")) == [30]
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == docs.columns + more and empty.collect() == []


def test_repeated_ids_teach_once(spark):
    rows = [(1, f"text number {i}", "en") for i in range(500)] + [(2, "ein deutscher Satz", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert one_text(docs, "doc_id", "lang").count() == 2
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    space = quality.fit(docs, labels)
    assert len(space.votes) <= 2
    assert set(language.fit(docs).languages) <= {"en", "de"}
