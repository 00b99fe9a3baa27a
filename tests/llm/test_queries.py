"""Registered corpus queries beside their SQL on the smallest tables; the pipeline stage by stage."""

from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from quire.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR
from tools.check_oracle import compare, connect, type_note


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    relation = connect(SF_DIR).sql(ORACLES[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], relation.columns, relation.fetchall()) is None
    assert type_note(df, relation) == ""


def test_pipeline(spark):
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert out and set(out[0].asDict()) == {*columns, "shard"}
    assert {r["doc_id"] for r in out} <= ids and all(0 <= r["shard"] < 24 for r in out)
