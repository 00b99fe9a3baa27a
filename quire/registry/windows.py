"""Queries on snapshots, ledgers and operation lanes: the ordered rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import grapheme_count
from quire.operators import aggregates as A, windows as W
from quire.operators.ordered import newest, with_row_number
from quire.registry.core import register
from quire.registry.roles import (
    CHAPTERS_SQL,
    LEDGER_ORDER,
    LEDGER_ORDER_SQL,
    LEDGER_SQL,
    NODES_SQL,
    OP_EVENTS_SQL,
    OPERATIONS_SQL,
    SNAPSHOTS_SQL,
    chapters,
    ledger,
    nodes,
    op_events,
    operations,
    snapshots,
    table,
)

_NOW = "TIMESTAMP '2024-01-28 12:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-28 12:00:00'")


@register("retention_deletions", f"""WITH {SNAPSHOTS_SQL.strip()},
banded AS (
  SELECT *, CASE WHEN created_at < {_NOW} - INTERVAL 24 HOUR THEN CAST(created_at AS DATE) END AS d
  FROM snapshots WHERE NOT is_pinned AND created_at <= {_NOW}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, d ORDER BY created_at DESC, backup_id) AS n FROM banded)
SELECT backup_id, document_id, created_at FROM ranked
WHERE n > CASE WHEN d IS NULL THEN 2 ELSE 1 END OR created_at < {_NOW} - INTERVAL 336 HOUR""")
def retention_deletions(spark, folder):
    out = W.retention_deletions(snapshots(spark, folder), _now(), recent=2, days=14)
    return out.select("backup_id", "document_id", "created_at")


@register("backup_inventory", f"""WITH {SNAPSHOTS_SQL.strip()},
shared AS (SELECT *, document_id || reason AS shared_id FROM snapshots)
SELECT shared_id AS backup_id, document_id, created_at, is_pinned FROM shared
QUALIFY row_number() OVER (PARTITION BY shared_id ORDER BY is_pinned DESC, created_at DESC) = 1""")
def backup_inventory(spark, folder):
    shared = snapshots(spark, folder).withColumn(
        "backup_id", F.concat(F.col("document_id").cast("string"), "reason")
    )
    return W.newest_first(W.distinct_backups(shared)).select(
        "backup_id", "document_id", "created_at", "is_pinned"
    )


@register("coalesced_snapshots", f"""WITH {SNAPSHOTS_SQL.strip()},
marked AS (SELECT *, lag(reason) OVER (PARTITION BY document_id ORDER BY created_at, backup_id) AS before
  FROM (SELECT backup_id, document_id, created_at, reason FROM snapshots))
SELECT backup_id, document_id, reason FROM marked
WHERE NOT (reason IN ('automaticSave', 'editingInterval', 'documentClose') AND coalesce(before = reason, false))""")
def coalesced_snapshots(spark, folder):
    # the reason stands in for the content hash, which makes repeats frequent
    named = snapshots(spark, folder).withColumn("content_hash", F.col("reason"))
    return W.coalesce_duplicates(named).select("backup_id", "document_id", "reason")


@register("current_documents", f"""WITH {LEDGER_SQL.strip()}
SELECT document_id, revision, line_id, content_hash, is_deleted, created_at FROM ledger
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY revision DESC, created_at DESC, arrival DESC,
  line_id DESC, project_id DESC, byte_count DESC) = 1""")
def current_documents(spark, folder):
    rows = W.current_rows(ledger(spark, folder), "document_id", LEDGER_ORDER)
    return rows.select("document_id", "revision", "line_id", "content_hash", "is_deleted", "created_at")


@register("revision_gaps", f"""WITH {LEDGER_SQL.strip()},
marked AS (SELECT *, lag(revision) OVER (PARTITION BY document_id ORDER BY {LEDGER_ORDER_SQL}) AS previous FROM ledger)
SELECT document_id, revision, previous, coalesce(previous, 0) + 1 AS expected FROM marked
WHERE revision <> coalesce(previous, 0) + 1""")
def revision_gaps(spark, folder):
    rows = W.sequence_gaps(ledger(spark, folder), ["document_id"], "revision", LEDGER_ORDER)
    return rows.select("document_id", "revision", "previous", "expected")


@register("change_kinds", f"""WITH {LEDGER_SQL.strip()},
marked AS (SELECT *, lag(is_deleted) OVER w AS gone, lag(relative_path) OVER w AS path,
    lag(content_hash) OVER w AS hash
  FROM ledger WINDOW w AS (PARTITION BY document_id ORDER BY {LEDGER_ORDER_SQL}))
SELECT document_id, revision, line_id,
  CASE WHEN gone IS NULL THEN 'create' WHEN NOT gone AND is_deleted THEN 'delete'
    WHEN gone AND NOT is_deleted THEN 'restore' WHEN path <> relative_path AND hash = content_hash THEN 'move'
    ELSE 'update' END AS kind
FROM marked""")
def change_kinds(spark, folder):
    rows = W.classify_change(ledger(spark, folder), "document_id", LEDGER_ORDER)
    return rows.select("document_id", "revision", "line_id", "kind")


@register("folder_change_kinds", """
WITH versions AS (
  SELECT o_custkey AS folder_id, o_orderkey AS revision, o_orderstatus = 'F' AS is_deleted,
    CASE WHEN o_totalprice > 250000 THEN o_orderpriority END AS parent_id, o_orderpriority AS name FROM orders),
marked AS (SELECT *, lag(revision) OVER w AS seen, lag(is_deleted) OVER w AS gone,
    lag(parent_id) OVER w AS was_in, lag(name) OVER w AS was_named
  FROM versions WINDOW w AS (PARTITION BY folder_id ORDER BY revision))
SELECT folder_id, revision, CASE WHEN seen IS NULL THEN 'create' WHEN NOT gone AND is_deleted THEN 'delete'
  WHEN gone AND NOT is_deleted THEN 'restore' WHEN was_in IS DISTINCT FROM parent_id THEN 'move'
  WHEN was_named <> name THEN 'rename' ELSE 'update' END AS kind FROM marked""")
def folder_change_kinds(spark, folder):
    versions = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("folder_id"),
        F.col("o_orderkey").alias("revision"),
        (F.col("o_orderstatus") == "F").alias("is_deleted"),
        F.when(F.col("o_totalprice") > 250000, F.col("o_orderpriority")).alias("parent_id"),
        F.col("o_orderpriority").alias("name"),
    )
    return W.classify_folder_change(versions, "folder_id", ["revision"]).select(
        "folder_id", "revision", "kind"
    )


_HEADS_SQL = f"""WITH {OPERATIONS_SQL.strip()},
heads AS (SELECT * FROM operations WHERE status NOT IN ('completed', 'cancelled')
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at, queue_id) = 1)"""


@register("lane_heads", _HEADS_SQL + " SELECT document_id, queue_id, status, created_at FROM heads")
def lane_heads(spark, folder):
    heads = W.lane_heads(operations(spark, folder), ["document_id"], ["created_at", "queue_id"])
    return heads.select("document_id", "queue_id", "status", "created_at")


@register("unblocked_operations", f"""WITH {OPERATIONS_SQL.strip()},
active AS (SELECT * FROM operations WHERE status NOT IN ('completed', 'cancelled'))
SELECT a.queue_id, a.document_id FROM active a WHERE a.status = 'pending' AND NOT EXISTS (
  SELECT 1 FROM active b WHERE b.document_id = a.document_id AND b.queue_id < a.queue_id)""")
def unblocked_operations(spark, folder):
    heads = W.lane_heads(operations(spark, folder), ["document_id"], ["queue_id"])
    return heads.where("status = 'pending'").select("queue_id", "document_id")


@register("ready_limit", _HEADS_SQL + """
SELECT queue_id, document_id, status FROM heads WHERE status IN ('pending', 'retry_wait')
ORDER BY queue_id LIMIT 50""")
def ready_limit(spark, folder):
    heads = W.lane_heads(operations(spark, folder), ["document_id"], ["created_at", "queue_id"])
    ready = heads.where(F.col("status").isin("pending", "retry_wait"))
    return ready.select("queue_id", "document_id", "status").orderBy("queue_id").limit(50)


@register("ready_projects", _HEADS_SQL + """
SELECT project_id, min(queue_id) AS first_queue_id FROM heads
WHERE status = 'pending' OR (status = 'retry_wait' AND created_at <= TIMESTAMP '1998-01-01 00:00:00')
GROUP BY project_id ORDER BY 2""")
def ready_projects(spark, folder):
    return A.ready_projects(operations(spark, folder), F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))


@register("next_retry", _HEADS_SQL + """
SELECT project_id, min(created_at) AS next_attempt_at FROM heads WHERE status = 'retry_wait' GROUP BY project_id""")
def next_retry(spark, folder):
    return A.next_retry(operations(spark, folder))


@register("promoted_bases", f"""WITH {LEDGER_SQL.strip()},
ops AS (SELECT *, revision AS result_revision, CASE WHEN is_deleted THEN NULL ELSE base_revision END AS base FROM ledger),
marked AS (SELECT *, lag(result_revision) OVER w AS lr, lag(content_hash) OVER w AS lh
  FROM ops WINDOW w AS (PARTITION BY document_id ORDER BY {LEDGER_ORDER_SQL}))
SELECT document_id, revision, line_id, coalesce(base, lr) AS base_revision,
  base IS NULL AND lr IS NOT NULL AS promoted, CASE WHEN base IS NULL AND lr IS NOT NULL THEN lh END AS base_hash
FROM marked""")
def promoted_bases(spark, folder):
    ops = ledger(spark, folder).withColumns(
        {
            "result_revision": F.col("revision"),
            "base_revision": F.when(~F.col("is_deleted"), F.col("base_revision")),
        }
    )
    rows = W.promote_base(ops, ["document_id"], LEDGER_ORDER)
    return rows.select("document_id", "revision", "line_id", "base_revision", "promoted", "base_hash")


@register("newest_local_state", f"""WITH {OPERATIONS_SQL.strip()},
local AS (SELECT *, CASE WHEN error_code IS NULL THEN base_revision END AS generation FROM operations
  WHERE status NOT IN ('completed', 'cancelled'))
SELECT document_id, queue_id, generation FROM local
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY (generation IS NOT NULL) DESC,
  generation DESC NULLS LAST, created_at DESC, queue_id DESC) = 1""")
def newest_local_state(spark, folder):
    ops = operations(spark, folder).withColumns(
        {
            "generation": F.when(F.col("error_code").isNull(), F.col("base_revision")),
            "document_sequence": F.col("created_at"),
        }
    )
    return W.newest_local(ops).select("document_id", "queue_id", "generation")


@register("assigned_order", f"""WITH {NODES_SQL.strip()},
known AS (SELECT * FROM nodes WHERE kind = 'folder'), fresh AS (SELECT * FROM nodes WHERE kind = 'text'),
last AS (SELECT parent_id, max(user_order) AS m FROM known GROUP BY parent_id)
SELECT f.id, f.parent_id, coalesce(l.m, -1) + row_number() OVER (PARTITION BY f.parent_id ORDER BY f.name) AS user_order
FROM fresh f LEFT JOIN last l ON f.parent_id IS NOT DISTINCT FROM l.parent_id""")
def assigned_order(spark, folder):
    tree = nodes(spark, folder)
    rows = W.assign_order(tree.where("kind = 'folder'"), tree.where("kind = 'text'"), ["name"])
    return rows.select("id", "parent_id", "user_order")


@register("chapters_until_short", f"""WITH {CHAPTERS_SQL.strip()},
stops AS (SELECT project_id, min(number) AS first_short FROM chapters
  WHERE length_grapheme(text) < 300 GROUP BY project_id)
SELECT c.project_id, c.number, s.first_short FROM chapters c LEFT JOIN stops s USING (project_id)
WHERE s.first_short IS NULL OR c.number < s.first_short""")
def chapters_until_short(spark, folder):
    sized = chapters(spark, folder).select(
        "project_id", "number", grapheme_count(F.col("text")).alias("characters")
    )
    return W.until_short(sized, ["project_id"]).select("project_id", "number", "first_short")


@register("latest_conflicts", f"""WITH {OPERATIONS_SQL.strip()}
SELECT document_id, queue_id, error_code FROM operations WHERE status = 'conflict'
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, queue_id DESC) = 1""")
def latest_conflicts(spark, folder):
    conflicts = operations(spark, folder).where("status = 'conflict'")
    rows = newest(conflicts, ["document_id"], ["created_at", "queue_id"])
    return rows.select("document_id", "queue_id", "error_code")


@register("event_positions", f"""WITH {OP_EVENTS_SQL.strip()}
SELECT operation_id, event_id, arrival,
  row_number() OVER (PARTITION BY operation_id ORDER BY event_sequence, arrival, event_id, device_id) AS position
FROM op_events""")
def event_positions(spark, folder):
    order = ["event_sequence", "arrival", "event_id", "device_id"]
    rows = with_row_number(op_events(spark, folder), ["operation_id"], order, "position")
    return rows.select("operation_id", "event_id", "arrival", "position")
