"""Skew-proof operators give the same rows with and without heavy keys."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quire.operators import ordered as O
from quire.operators.aggregates import corpus_fingerprint, latency_summary, table_fingerprint
from quire.registry import queries
from tests.conftest import SF_DIR, rows


def _events(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    # one key holds most rows, one is null
    key = F.when(F.col("user_id") < 3, F.col("user_id")).when(F.col("user_id") > 12, F.lit(None)).otherwise(F.lit(99))
    return events.select(key.alias("k"), "event_id", "ts", F.floor("value").alias("v"))


CASES = {
    "row_number": lambda df: O.with_row_number(df, ["k"], ["-ts", "event_id"], "n"),
    "previous": lambda df: O.with_previous(df, ["k"], ["ts", "event_id"], {"pv": "v", "pt": "ts"}),
    "running": lambda df: O.with_running(
        df, ["k"], ["ts", "event_id"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("min", "v")}
    ),
    "newest": lambda df: O.newest(df, ["k"], ["ts", "event_id"]),
    "top": lambda df: O.top_rows(df, ["k"], ["-v", "event_id"], 3),
}


@pytest.mark.parametrize("case", CASES)
def test_heavy_keys_give_the_same_rows(spark, case):
    plain = rows(CASES[case](_events(spark)))
    spark.conf.set("quire.taskBytes", "0")
    spark.conf.set("quire.taskRows", "5")
    try:
        assert O.has_heavy_key(_events(spark), ["k"])
        split = CASES[case](_events(spark))
        assert rows(split.select(CASES[case](_events(spark)).columns)) == plain
    finally:
        spark.conf.unset("quire.taskBytes")
        spark.conf.unset("quire.taskRows")


@pytest.mark.parametrize(
    "name",
    [
        "retention_deletions", "coalesced_snapshots", "revision_gaps", "change_kinds", "promoted_bases",
        "event_append_outcomes", "retry_audit", "replayed_ledger", "document_commit_replay",
        "rate_limited_snapshots", "latency_summary", "assigned_order", "safe_names", "lease_timeline",
    ],
)
def test_queries_hold_under_heavy_keys(spark, name):
    plain = queries()[name](spark, SF_DIR)
    expected = rows(plain)
    spark.conf.set("quire.taskBytes", "0")
    spark.conf.set("quire.taskRows", "3")
    try:
        assert rows(queries()[name](spark, SF_DIR).select(plain.columns)) == expected
    finally:
        spark.conf.unset("quire.taskBytes")
        spark.conf.unset("quire.taskRows")


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fingerprints_ignore_order_and_partitions(spark, parts):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey", "o_orderstatus")
    mixed = orders.orderBy(F.rand(parts)).repartition(parts)
    assert rows(table_fingerprint(mixed)) == rows(table_fingerprint(orders))
    files = orders.select(
        F.lit("text").alias("kind"), F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("relative_path"),
        F.lit(1).alias("bytes"), F.col("o_orderstatus").alias("content_hash"),
    )
    assert rows(corpus_fingerprint(files.orderBy(F.rand(parts)).repartition(parts))) == rows(corpus_fingerprint(files))
    changed = files.withColumn("bytes", F.when(F.col("relative_path") == "p/1", 2).otherwise(1))
    assert rows(corpus_fingerprint(changed)) != rows(corpus_fingerprint(files))


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", v) for v in [5, 1, 3, 2, 4]] + [("b", 7)], "k string, v bigint")
    assert rows(latency_summary(df, ["k"], "v")) == [("a", 5, 3, 5), ("b", 1, 7, 7)]


def test_intermediate_tables_can_be_removed(spark):
    from quire import session

    held = list(session._written)
    session._written.clear()
    try:
        assert session.durable(spark.range(5)).count() == 5
        path = session._written[0]
        assert spark.read.parquet(path).count() == 5
        assert session.remove_written(spark) == 1
        with pytest.raises(AnalysisException):
            spark.read.parquet(path).count()
        assert session.remove_written(spark) == 0
    finally:
        session._written.extend(held)
