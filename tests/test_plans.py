"""What the physical plans must show: pruning, pushdown, map-side cuts."""

from __future__ import annotations

import pathlib
import re

from pyspark.sql import functions as F

from quire.operators.ordered import newest, top_rows
from quire.plans import search as S
from quire.registry import queries
from quire.registry.roles import ledger, operations
from quire.session import estimated_bytes, spread
from tests.conftest import SF_DIR


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_rows_are_cut_before_the_shuffle(spark):
    for df in (
        newest(operations(spark, SF_DIR), ["document_id"], ["created_at", "queue_id"]),
        top_rows(ledger(spark, SF_DIR), ["document_id"], ["revision"], 5),
    ):
        plan = _plan(df)
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(queries()["batch_status"](spark, SF_DIR))
    assert "ReadSchema" in plan and "o_clerk" not in plan and "c_acctbal" not in plan
    plan = _plan(queries()["change_kinds"](spark, SF_DIR))
    assert "l_tax" not in plan and "l_discount" not in plan


def test_filters_reach_the_scan(spark):
    plan = _plan(queries()["dangling_references"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(l_partkey)]" in plan
    plan = _plan(queries()["missing_remote_candidates"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(c_acctbal", plan)


def test_search_does_not_shuffle(spark):
    corpus = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumnRenamed("doc_id", "document_id")
    assert "Exchange" not in _plan(S.search(corpus, "the", excerpts=True))


def test_one_shuffle_for_plain_windows(spark):
    for name in ("revision_gaps", "change_kinds", "coalesced_snapshots", "retry_audit"):
        assert _plan(queries()[name](spark, SF_DIR)).count("Exchange hashpartitioning") == 1, name


def test_no_nested_loops_or_cross_products(spark):
    for name in ("codepoint_blocks", "documents_under_folder", "blocked_deletes", "missing_paths", "missing_chapters", "volume_coverage", "rule_decisions", "trash_plan", "name_clashes"):
        plan = _plan(queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_spread_leaves_large_or_many_files_alone(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert estimated_bytes(docs) > 0
    assert "REPARTITION_BY_NUM" in _plan(spread(docs, "doc_id"))
    many = spark.read.parquet(*[f"{SF_DIR}/documents.parquet"] * 1)
    assert _plan(spread(many.limit(0).where(F.lit(False)), "doc_id"))


def test_sources_name_no_forbidden_calls():
    root = pathlib.Path(__file__).resolve().parent.parent / "quire"
    for path in root.rglob("*.py"):
        text = path.read_text()
        for call in ("localCheckpoint", "crossJoin", ".toPandas(", ".rdd"):
            assert call not in text, (path.name, call)
