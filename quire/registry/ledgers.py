"""Queries on the version ledger, the operation queue and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.windows import current_rows
from quire.plans import ledger as L
from quire.registry.core import register
from quire.registry.roles import (
    LEDGER_ORDER,
    LEDGER_ORDER_SQL,
    LEDGER_SQL,
    NODE_PATHS_SQL,
    CORPUS_SQL,
    OP_EVENTS_SQL,
    OPERATIONS_SQL,
    SNAPSHOTS_SQL,
    corpus,
    ledger,
    op_events,
    operations,
    snapshots,
    table,
    with_digest,
)
from quire.session import shared_folder
from quire.sources.sinks import insert_only, read_inserted

_LEDGER = f"WITH {LEDGER_SQL.strip()}"
_OPS = f"WITH {OPERATIONS_SQL.strip()}"
_ARRIVAL = ["created_at", "arrival", "line_id", "project_id", "byte_count"]
# projects of a hundred documents, whose requests meet in paths and operation ids
_REQUESTS_SQL = f"""WITH RECURSIVE {LEDGER_SQL.strip()},
requests AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {', '.join(_ARRIVAL)}) AS seq
  FROM (SELECT document_id, document_id // 100 AS project_id, revision, base_revision, line_id, document_id // 100 || '-' || line_id % 1500 AS operation_id,
    'part/' || line_id % 700 AS relative_path, byte_count, content_hash, is_deleted, device_id, created_at, arrival FROM ledger))"""


def _requests(spark, folder):
    # numbered before ids, paths and digests are made, which so need no exchange
    project, line = F.col("project_id").cast("string"), F.col("line_id")
    rows = ledger(spark, folder).withColumn("project_id", F.expr("document_id div 100"))
    return with_digest(L.numbered_requests(rows.drop("content_hash", "operation_id", "relative_path"), _ARRIVAL)).withColumns({
        "operation_id": F.concat_ws("-", project, (line % 1500).cast("string")),
        "relative_path": F.concat(F.lit("part/"), (line % 700).cast("string")),
    })


@register("replayed_ledger", _REQUESTS_SQL + f""",
queued AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {', '.join(_ARRIVAL)}, document_id, seq) AS n,
    document_id || ':' || base_revision || device_id || relative_path || content_hash || is_deleted AS payload FROM requests),
walk AS (
  SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS document_id, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS operation_id,
    CAST([] AS STRUCT(d BIGINT, rev BIGINT, path VARCHAR)[]) AS docs, CAST([] AS STRUCT(o VARCHAR, p VARCHAR)[]) AS ops, CAST('' AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS revision
  FROM queued
  UNION ALL
  SELECT project_id, n, document_id, seq, operation_id,
    CASE WHEN outcome = 'committed' THEN list_append(list_filter(docs, lambda x: x.d <> document_id),
      {{'d': document_id, 'rev': base_revision + 1, 'path': CASE WHEN NOT is_deleted THEN relative_path END}}) ELSE docs END,
    CASE WHEN outcome = 'committed' THEN list_append(ops, {{'o': operation_id, 'p': payload}}) ELSE ops END,
    outcome, CASE WHEN outcome IN ('committed', 'replayed') THEN base_revision + 1 END
  FROM (SELECT q.*, w.docs, w.ops,
      CASE WHEN len(list_filter(w.ops, lambda x: x.o = q.operation_id)) > 0
        THEN CASE WHEN list_contains(w.ops, {{'o': q.operation_id, 'p': q.payload}}) THEN 'replayed' ELSE 'OPERATION_ID_REUSED' END
        WHEN base_revision = 0 AND len(list_filter(w.docs, lambda x: x.d = q.document_id)) > 0 THEN 'DOCUMENT_ALREADY_EXISTS'
        WHEN base_revision = 0 AND is_deleted THEN 'INVALID_ARGUMENT'
        WHEN base_revision > 0 AND len(list_filter(w.docs, lambda x: x.d = q.document_id)) = 0 THEN 'DOCUMENT_NOT_FOUND'
        WHEN base_revision > 0 AND len(list_filter(w.docs, lambda x: x.d = q.document_id AND x.rev = q.base_revision)) = 0 THEN 'REVISION_CONFLICT'
        WHEN NOT is_deleted AND len(list_filter(w.docs, lambda x: x.d <> q.document_id AND coalesce(x.path = q.relative_path, false))) > 0 THEN 'PATH_CONFLICT'
        ELSE 'committed' END AS outcome
    FROM walk w JOIN queued q ON q.project_id = w.project_id AND q.n = w.n + 1))
SELECT document_id, seq, operation_id, outcome, revision FROM walk WHERE n > 0""")
def replayed_ledger(spark, folder):
    return L.replay_ledger(_requests(spark, folder), _ARRIVAL)


_PAYLOAD_SQL = "relative_path || content_hash || is_deleted"


def _with_digest(spark, folder):
    return ledger(spark, folder).withColumn(
        "payload_digest", F.concat("relative_path", "content_hash", F.col("is_deleted").cast("string"))
    )


@register("idempotency", _LEDGER + f""",
marked AS (SELECT *, {_PAYLOAD_SQL} AS payload, row_number() OVER w AS n, first_value({_PAYLOAD_SQL}) OVER w AS first_payload
  FROM ledger WINDOW w AS (PARTITION BY operation_id ORDER BY {LEDGER_ORDER_SQL}))
SELECT operation_id, line_id, created_at, CASE WHEN n = 1 THEN 'first' WHEN payload = first_payload THEN 'replay' ELSE 'reused' END AS verdict
FROM marked""")
def idempotency(spark, folder):
    rows = L.idempotency(_with_digest(spark, folder), LEDGER_ORDER)
    return rows.select("operation_id", "line_id", "created_at", "verdict")


@register("reused_operation_ids", _LEDGER + f"""
SELECT operation_id, count(DISTINCT {_PAYLOAD_SQL}) AS payloads FROM ledger GROUP BY operation_id HAVING count(DISTINCT {_PAYLOAD_SQL}) > 1""")
def reused_operation_ids(spark, folder):
    return L.reused_operation_ids(_with_digest(spark, folder))


_CURRENT_SQL = """current AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY revision DESC,
  created_at DESC, arrival DESC, line_id DESC, project_id DESC, byte_count DESC) = 1)"""


@register("path_ownership", _LEDGER + f""", {_CURRENT_SQL}
SELECT project_id, relative_path, count(DISTINCT document_id) AS holders, min(document_id) AS first_holder FROM current
WHERE NOT is_deleted GROUP BY 1, 2 HAVING count(DISTINCT document_id) > 1""")
def path_ownership(spark, folder):
    return L.path_ownership(current_rows(ledger(spark, folder), "document_id", LEDGER_ORDER))


@register("revision_conflicts", _LEDGER + f""", {_CURRENT_SQL}
SELECT l.document_id, l.line_id, l.base_revision, c.revision AS current_revision FROM ledger l JOIN current c USING (document_id)
WHERE l.base_revision <> c.revision""")
def revision_conflicts(spark, folder):
    rows = ledger(spark, folder)
    found = L.revision_conflicts(rows, current_rows(rows, "document_id", LEDGER_ORDER))
    return found.select("document_id", "line_id", "base_revision", "current_revision")


@register("batch_outcomes", """
WITH intents AS (SELECT l_orderkey AS batch_id, ((l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS sequence,
  CASE WHEN l_quantity > 45 THEN 'REVISION_CONFLICT' WHEN l_tax > 0.07 THEN 'FOLDER_NOT_FOUND' END AS code FROM lineitem)
SELECT batch_id, count(*) AS intents, min(sequence) FILTER (WHERE code IS NOT NULL) AS failed_sequence,
  arg_min(code, sequence) FILTER (WHERE code IS NOT NULL) AS code, count(code) = 0 AS applied FROM intents GROUP BY batch_id""")
def batch_outcomes(spark, folder):
    intents = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        (
            ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 100
            + F.col("l_quantity").cast("bigint")
        ).alias("sequence"),
        F.when(F.col("l_quantity") > 45, "REVISION_CONFLICT").when(F.col("l_tax") > 0.07, "FOLDER_NOT_FOUND").alias("code"),
    )
    return L.batch_outcome(intents)


_EVENT_ORDER = ["recorded_at", "arrival", "device_id", "event_sequence"]


@register("event_append_outcomes", f"""WITH RECURSIVE {OP_EVENTS_SQL.strip()},
offered AS (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY {', '.join(_EVENT_ORDER)}) AS n FROM op_events),
walk AS (
  SELECT operation_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS arrival, false AS closed,
    CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS kinds, CAST('' AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS sequence
  FROM (SELECT DISTINCT operation_id FROM offered)
  UNION ALL
  SELECT operation_id, n, event_id, arrival,
    closed OR (outcome = 'appended' AND event_type IN ('committed', 'replayed', 'cancel_requested', 'superseded')),
    CASE WHEN outcome = 'appended' THEN list_append(ids, event_id) ELSE ids END,
    CASE WHEN outcome = 'appended' THEN list_append(kinds, event_type) ELSE kinds END, outcome,
    CASE outcome WHEN 'appended' THEN len(ids) + 1 WHEN 'replayed' THEN list_position(ids, event_id) END
  FROM (SELECT o.operation_id, o.n, o.event_id, o.arrival, o.event_type, w.closed, w.ids, w.kinds,
      CASE WHEN list_contains(w.ids, o.event_id) THEN
          CASE WHEN w.kinds[list_position(w.ids, o.event_id)] = o.event_type THEN 'replayed' ELSE 'EVENT_ID_REUSED' END
        WHEN w.closed THEN 'OPERATION_TERMINAL' ELSE 'appended' END AS outcome
    FROM walk w JOIN offered o ON o.operation_id = w.operation_id AND o.n = w.n + 1))
SELECT operation_id, event_id, arrival, outcome, CAST(sequence AS BIGINT) AS sequence FROM walk WHERE n > 0""")
def event_append_outcomes(spark, folder):
    rows = L.event_append_rules(op_events(spark, folder), _EVENT_ORDER)
    return rows.select("operation_id", "event_id", "arrival", "outcome", "sequence")


@register("rate_limited_snapshots", f"""WITH RECURSIVE {SNAPSHOTS_SQL.strip()},
autos AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, backup_id) AS n FROM snapshots WHERE reason = 'automaticSave'),
walk AS (SELECT document_id, n, backup_id, created_at AS last_kept, true AS kept FROM autos WHERE n = 1
  UNION ALL SELECT document_id, n, backup_id, CASE WHEN keep THEN created_at ELSE last_kept END, keep
  FROM (SELECT a.document_id, a.n, a.backup_id, a.created_at, w.last_kept,
      a.byte_count < 1048576 OR a.created_at - w.last_kept >= INTERVAL 172800 SECOND AS keep
    FROM walk w JOIN autos a ON a.document_id = w.document_id AND a.n = w.n + 1))
SELECT document_id, backup_id FROM walk WHERE kept""")
def rate_limited_snapshots(spark, folder):
    # saves lie hours apart in this table, so the interval is two days
    return L.rate_limit_large(snapshots(spark, folder), seconds=172800).select("document_id", "backup_id")


@register("retry_audit", """
WITH attempts AS (SELECT user_id AS operation_id, event_id, CAST(extract(day FROM ts) AS BIGINT) AS attempt,
    CASE WHEN event_type = 'error' THEN 'LEASE_CONFLICT' ELSE 'TIMEOUT' END AS code, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
marked AS (SELECT *, lag(s) OVER w AS b, lag(attempt) OVER w AS a, lag(code) OVER w AS c FROM attempts
  WINDOW w AS (PARTITION BY operation_id ORDER BY s, event_id)),
timed AS (SELECT operation_id, event_id, CAST(s - b AS DOUBLE) AS gap_seconds,
    CASE WHEN c = 'LEASE_CONFLICT' THEN 3.0 ELSE least(300.0, 2.0 * power(2.0, least(greatest(a - 1, 0), 30))) END::DOUBLE AS expected_seconds,
    CASE WHEN c = 'LEASE_CONFLICT' THEN 0.0 ELSE 0.2 END AS j FROM marked WHERE b IS NOT NULL)
SELECT operation_id, event_id, gap_seconds, expected_seconds FROM timed
WHERE gap_seconds < expected_seconds * (1 - j) OR gap_seconds > expected_seconds * (1 + j)""")
def retry_audit(spark, folder):
    attempts = table(spark, folder, "events").select(
        F.col("user_id").alias("operation_id"),
        "event_id",
        F.dayofmonth("ts").cast("bigint").alias("attempt"),
        F.when(F.col("event_type") == "error", "LEASE_CONFLICT").otherwise("TIMEOUT").alias("error_code"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_seconds"),
    )
    rows = L.retry_audit(attempts, ["at_seconds", "event_id"])
    return rows.select("operation_id", "event_id", "gap_seconds", "expected_seconds")


@register("failure_breakdown", f"""WITH handling(error_code, handling, rebase) AS (VALUES {', '.join(
    f"('{c}', '{h}', {str(r).lower()})" for c, h, r in L.FAILURE_HANDLING)}),
attempts AS (SELECT user_id AS project_id, CASE event_type WHEN 'error' THEN 'REVISION_CONFLICT' WHEN 'click' THEN 'TIMEOUT'
  WHEN 'view' THEN 'FORBIDDEN' WHEN 'signup' THEN 'P0002' END AS error_code FROM events)
SELECT project_id, coalesce(handling, 'retry') AS handling, coalesce(rebase, false) AS rebase_candidate, count(*) AS failures
FROM attempts LEFT JOIN handling USING (error_code) WHERE error_code IS NOT NULL GROUP BY 1, 2, 3""")
def failure_breakdown(spark, folder):
    kind = F.col("event_type")
    attempts = table(spark, folder, "events").select(
        F.col("user_id").alias("project_id"),
        F.when(kind == "error", "REVISION_CONFLICT").when(kind == "click", "TIMEOUT").when(kind == "view", "FORBIDDEN")
        .when(kind == "signup", "P0002").alias("error_code"),
    )
    return L.failure_breakdown(attempts)


_CODED_SQL = """coded AS (SELECT * REPLACE (CASE WHEN status = 'conflict' AND operation_kind = 'create' THEN 'DOCUMENT_ALREADY_EXISTS'
    WHEN status = 'conflict' AND operation_kind = 'update' THEN 'DOCUMENT_NOT_FOUND' WHEN status = 'conflict' AND operation_kind = 'move' THEN 'LEASE_CONFLICT'
    WHEN status = 'blocked' AND operation_kind = 'delete' THEN 'FORBIDDEN' ELSE error_code END AS error_code) FROM operations)"""


def _coded(spark, folder):
    status, kind = F.col("status"), F.col("operation_kind")
    code = (
        F.when((status == "conflict") & (kind == "create"), "DOCUMENT_ALREADY_EXISTS")
        .when((status == "conflict") & (kind == "update"), "DOCUMENT_NOT_FOUND")
        .when((status == "conflict") & (kind == "move"), "LEASE_CONFLICT")
        .when((status == "blocked") & (kind == "delete"), "FORBIDDEN")
        .otherwise(F.col("error_code"))
    )
    return operations(spark, folder).withColumn("error_code", code)


@register("stuck_work", _OPS + f""", {_CODED_SQL},
active AS (SELECT * FROM coded WHERE status NOT IN ('completed', 'cancelled')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, queue_id) = 1 AS head FROM active),
judged AS (SELECT *, CASE WHEN status = 'inflight' THEN 'pending' WHEN status = 'conflict' AND error_code = 'DOCUMENT_NOT_FOUND' AND head THEN 'createAtZero'
  WHEN status = 'blocked' AND error_code = 'FORBIDDEN' AND head THEN 'pending'
  WHEN status = 'conflict' AND error_code IN ('LEASE_CONFLICT', 'DOCUMENT_ALREADY_EXISTS')
    AND document_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'pending' END AS action FROM ranked)
SELECT queue_id, document_id, status, error_code, action FROM judged WHERE action IS NOT NULL""")
def stuck_work(spark, folder):
    conflicts = table(spark, folder, "events").where("event_type = 'error'").select(F.col("user_id").alias("document_id"))
    return L.stuck_work(_coded(spark, folder), conflicts)


@register("noop_saves", _OPS + """,
saves AS (SELECT event_id AS save_id, user_id AS document_id, event_type AS relative_path, props AS content_hash FROM events),
state AS (SELECT c_custkey AS document_id, CASE WHEN c_acctbal > 4000 THEN 'click' ELSE 'view' END AS base_path,
  '{"k": ' || c_custkey % 100 || '}' AS base_hash, 1 AS server_revision, c_acctbal < 0 AS is_deleted FROM customer),
busy AS (SELECT DISTINCT document_id FROM operations WHERE status NOT IN ('completed', 'cancelled')),
judged AS (SELECT save_id, s.document_id, CASE WHEN is_deleted THEN 'documentDeleted' WHEN relative_path = base_path AND content_hash = base_hash
    AND s.document_id NOT IN (SELECT document_id FROM busy) THEN 'unchanged' END AS reason FROM saves s JOIN state USING (document_id))
SELECT * FROM judged WHERE reason IS NOT NULL""")
def noop_saves(spark, folder):
    saves = table(spark, folder, "events").select(
        F.col("event_id").alias("save_id"), F.col("user_id").alias("document_id"),
        F.col("event_type").alias("relative_path"), F.col("props").alias("content_hash"),
    )
    state = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("document_id"),
        F.when(F.col("c_acctbal") > 4000, "click").otherwise("view").alias("base_path"),
        F.concat(F.lit('{"k": '), (F.col("c_custkey") % 100).cast("string"), F.lit("}")).alias("base_hash"),
        F.lit(1).alias("server_revision"),
        (F.col("c_acctbal") < 0).alias("is_deleted"),
    )
    return L.drop_noops(saves, state, operations(spark, folder))


@register("coalesced_tree_orders", _OPS + """,
waiting AS (SELECT * FROM operations WHERE operation_kind = 'treeOrder' AND status IN ('pending', 'retry_wait', 'blocked')),
ranked AS (SELECT *, first_value(queue_id) OVER (PARTITION BY document_id ORDER BY created_at DESC, queue_id DESC) AS kept_queue_id FROM waiting)
SELECT queue_id, document_id, kept_queue_id FROM ranked WHERE queue_id <> kept_queue_id""")
def coalesced_tree_orders(spark, folder):
    return L.coalesce_tree_orders(operations(spark, folder))


@register("rebased_operations", _OPS + """,
lanes AS (SELECT DISTINCT document_id FROM operations WHERE status = 'conflict' AND error_code = 'REVISION_CONFLICT'),
active AS (SELECT *, first_value(queue_id) OVER (PARTITION BY document_id ORDER BY created_at DESC, queue_id DESC) AS last FROM operations
  WHERE status NOT IN ('completed', 'cancelled') AND document_id IN (SELECT document_id FROM lanes))
SELECT queue_id, document_id, CASE WHEN queue_id = last THEN 'pending' ELSE 'cancelled' END AS new_status,
  CASE WHEN queue_id = last THEN document_id + 7 ELSE base_revision END AS new_base FROM active""")
def rebased_operations(spark, folder):
    remote = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("document_id"), (F.col("c_custkey") + 7).alias("revision")
    )
    return L.rebase_ops(operations(spark, folder), remote)


@register("resolution_check", """
WITH c AS (SELECT o_orderkey AS conflict_id, CASE o_orderstatus WHEN 'F' THEN 'keep_local' WHEN 'O' THEN 'use_remote' END AS resolution,
  left(o_orderpriority, 1) AS chosen_hash, CAST(CAST(o_totalprice AS BIGINT) % 5 + 1 AS VARCHAR) AS local_hash, CAST(o_custkey % 5 + 1 AS VARCHAR) AS remote_hash FROM orders)
SELECT conflict_id, CASE WHEN resolution IS NULL THEN 'unresolved' WHEN CASE resolution WHEN 'keep_local' THEN '3' ELSE remote_hash END = chosen_hash
  THEN 'valid' ELSE 'mismatch' END AS "check" FROM c""")
def resolution_check(spark, folder):
    status = F.col("o_orderstatus")
    conflicts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("conflict_id"),
        F.when(status == "F", "keep_local").when(status == "O", "use_remote").alias("resolution"),
        F.left("o_orderpriority", F.lit(1)).alias("chosen_hash"),
        F.lit("3").alias("local_hash"),
        (F.col("o_custkey") % 5 + 1).cast("string").alias("remote_hash"),
    )
    return L.resolve_report(conflicts).select("conflict_id", "check")


_PULL_SQL = f"""{_OPS}, {LEDGER_SQL.strip()}, {_CURRENT_SQL},
state AS (SELECT c_custkey AS document_id, CAST(c_nationkey % 8 AS BIGINT) AS server_revision FROM customer WHERE c_acctbal < 8000),
flags AS (SELECT document_id, bool_or(status NOT IN ('completed', 'cancelled') AND base_revision > 480000) AS unfinished,
  bool_or(status = 'conflict' AND base_revision > 45000) AS open_conflict,
  bool_or(status = 'blocked' AND base_revision > 95000) AS blocked, bool_or(status = 'conflict' AND base_revision < 5000) AS path_conflict FROM operations GROUP BY document_id),
editing AS (SELECT user_id AS document_id, bool_or(event_type = 'click' AND value > 60) AS is_composing, bool_or(event_type = 'view' AND value > 60) AS is_dirty,
  bool_or(event_type = 'signup' AND value > 40) AS is_open FROM events GROUP BY user_id)"""


@register("pull_decisions", _PULL_SQL + """,
joined AS (SELECT c.document_id, c.revision, c.is_deleted, s.server_revision, s.server_revision IS NOT NULL AS known,
    s.server_revision IS NOT NULL AND c.revision <= s.server_revision AS stale, coalesce(unfinished, false) AS unfinished,
    coalesce(open_conflict, false) AS open_conflict, coalesce(blocked, false) AS blocked, coalesce(path_conflict, false) AS path_conflict,
    coalesce(is_composing, false) AS composing, coalesce(is_dirty, false) AS dirty, coalesce(is_open, false) AS opened
  FROM current c LEFT JOIN state s USING (document_id) LEFT JOIN flags USING (document_id) LEFT JOIN editing USING (document_id)),
reasoned AS (SELECT *, CASE WHEN stale THEN CASE WHEN open_conflict THEN 'unresolvedConflict' WHEN blocked THEN 'blockedOperation'
      WHEN path_conflict THEN 'pathOccupied' WHEN unfinished THEN 'pendingOperation' END
    ELSE CASE WHEN known AND open_conflict THEN 'unresolvedConflict' WHEN known AND blocked THEN 'blockedOperation' WHEN known AND unfinished THEN 'pendingOperation'
      WHEN composing THEN 'markedTextComposition' WHEN dirty THEN 'dirtyEditor' WHEN is_deleted AND opened THEN 'remoteDeletion' END END AS reason FROM joined)
SELECT document_id, revision, CASE WHEN reason IS NOT NULL THEN 'mergeRequired' WHEN stale THEN 'upToDate'
  WHEN is_deleted AND revision <= 5 THEN 'baselineOnly' ELSE 'applied' END AS outcome, reason FROM reasoned""")
def pull_decisions(spark, folder):
    current = current_rows(ledger(spark, folder), "document_id", LEDGER_ORDER)
    state = table(spark, folder, "customer").where("c_acctbal < 8000").select(
        F.col("c_custkey").alias("document_id"), (F.col("c_nationkey") % 8).cast("bigint").alias("server_revision")
    )
    status, base = F.col("status"), F.col("base_revision")
    flags = operations(spark, folder).groupBy("document_id").agg(
        F.bool_or(~status.isin("completed", "cancelled") & (base > 480000)).alias("has_unfinished"),
        F.bool_or((status == "conflict") & (base > 45000)).alias("has_open_conflict"),
        F.max(F.when((status == "blocked") & (base > 95000), "FORBIDDEN")).alias("blocked_code"),
        F.bool_or((status == "conflict") & (base < 5000)).alias("has_path_conflict"),
    )
    kind, value = F.col("event_type"), F.col("value")
    editing = table(spark, folder, "events").groupBy(F.col("user_id").alias("document_id")).agg(
        F.bool_or((kind == "click") & (value > 60)).alias("is_composing"),
        F.bool_or((kind == "view") & (value > 60)).alias("is_dirty"),
        F.bool_or((kind == "signup") & (value > 40)).alias("is_open"),
    )
    purges = current.select("document_id", F.lit(5).cast("bigint").alias("purge_revision"))
    return L.pull_decisions(current, state, flags, editing, purges)


@register("purge_eligible", _LEDGER + f""", {_CURRENT_SQL}
SELECT c.document_id, c.revision FROM current c JOIN (SELECT user_id AS document_id, max(CAST(floor(value / 5) AS BIGINT)) AS p FROM events GROUP BY 1) USING (document_id)
WHERE c.is_deleted AND c.revision <= p""")
def purge_eligible(spark, folder):
    current = current_rows(ledger(spark, folder), "document_id", LEDGER_ORDER)
    purges = table(spark, folder, "events").groupBy(F.col("user_id").alias("document_id")).agg(
        F.max(F.floor(F.col("value") / 5).cast("bigint")).alias("purge_revision")
    )
    return L.purge_eligible(current, purges).select("document_id", "revision")


@register("applied_baseline", _LEDGER + f""", {_CURRENT_SQL},
state AS (SELECT o_orderkey AS document_id, CAST(3 AS BIGINT) AS revision, 'part/' || o_custkey AS relative_path, 'old' AS content_hash, o_orderstatus = 'F' AS is_deleted FROM orders),
owners AS (SELECT relative_path, min(document_id) AS lo, max(document_id) AS hi FROM state WHERE NOT is_deleted GROUP BY 1),
usable AS (SELECT c.* FROM current c LEFT JOIN owners o USING (relative_path) WHERE c.is_deleted OR lo IS NULL OR (lo = c.document_id AND hi = c.document_id))
SELECT coalesce(s.document_id, u.document_id) AS document_id,
  CASE WHEN s.revision IS NULL OR u.revision > s.revision THEN u.revision ELSE s.revision END AS revision,
  CASE WHEN s.revision IS NULL OR u.revision > s.revision THEN u.relative_path ELSE s.relative_path END AS relative_path,
  CASE WHEN s.revision IS NULL OR u.revision > s.revision THEN u.content_hash ELSE s.content_hash END AS content_hash,
  CASE WHEN s.revision IS NULL OR u.revision > s.revision THEN u.is_deleted ELSE s.is_deleted END AS is_deleted
FROM state s FULL OUTER JOIN usable u ON s.document_id = u.document_id""")
def applied_baseline(spark, folder):
    state = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.lit(3).cast("bigint").alias("revision"),
        F.concat(F.lit("part/"), F.col("o_custkey").cast("string")).alias("relative_path"),
        F.lit("old").alias("content_hash"),
        (F.col("o_orderstatus") == "F").alias("is_deleted"),
    )
    current = current_rows(ledger(spark, folder), "document_id", LEDGER_ORDER)
    return L.apply_baseline(state, current)


@register("legacy_boundary", _LEDGER + """
SELECT document_id, line_id, operation_id FROM ledger WHERE project_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
AND operation_id NOT IN (SELECT o_orderkey || '-' || left(o_orderpriority, 1) FROM orders)""")
def legacy_boundary(spark, folder):
    mode = F.when(F.col("s_acctbal") > 0, "ID_BASED").otherwise("LEGACY")
    projects = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("project_id"), mode.alias("mode"))
    batches = table(spark, folder, "orders").select(
        F.concat_ws("-", F.col("o_orderkey").cast("string"), F.left("o_orderpriority", F.lit(1))).alias("operation_id")
    )
    return L.legacy_boundary(ledger(spark, folder), projects, batches).select("document_id", "line_id", "operation_id")


@register("acknowledgement_audit", """
SELECT o_orderkey AS operation_id, CASE WHEN o_custkey % 9 = 0 THEN 'documentId' WHEN o_orderpriority = '1-URGENT' THEN 'relativePath'
  WHEN o_orderstatus = 'P' THEN 'deletionFlag' WHEN o_custkey % 7 = 0 THEN 'contentHash' WHEN o_custkey % 5 = 0 THEN 'revision'
  WHEN (o_custkey % 4 = 0) <> (o_orderstatus = 'F') THEN 'operationKind' END AS problem
FROM orders WHERE o_custkey % 9 = 0 OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' OR o_custkey % 7 = 0 OR o_custkey % 5 = 0
  OR (o_custkey % 4 = 0) <> (o_orderstatus = 'F')""")
def acknowledgement_audit(spark, folder):
    key, status = F.col("o_custkey"), F.col("o_orderstatus")
    orders = table(spark, folder, "orders").withColumn("_text", key.cast("string"))
    base = F.when(key % 4 == 0, 0).otherwise(3)
    requests = orders.select(
        F.col("o_orderkey").alias("operation_id"), key.alias("document_id"), F.concat(F.lit("a/"), "_text").alias("relative_path"),
        (status == "F").alias("is_deleted"), F.col("_text").alias("content"), base.alias("base_revision"),
    )
    responses = orders.select(
        F.col("o_orderkey").alias("operation_id"),
        F.when(key % 9 == 0, -1).otherwise(key).alias("r_document_id"),
        F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "A/").otherwise("a/"), "_text").alias("r_relative_path"),
        F.when(status == "P", True).otherwise(status == "F").alias("r_is_deleted"),
        F.sha2(F.when(key % 7 == 0, "x").otherwise(F.col("_text")).cast("binary"), 256).alias("r_content_hash"),
        (base + F.when(key % 5 == 0, 2).otherwise(1)).alias("r_revision"),
        F.when(status == "F", "create").otherwise("update").alias("r_kind"),
    )
    return L.acknowledgement_audit(requests, responses)


@register("initial_snapshot", f"""WITH {CORPUS_SQL.strip()},
orders_doc AS (SELECT project_id, sha256(string_agg(relative_path, chr(10) ORDER BY relative_path)) AS h FROM (SELECT DISTINCT project_id,
  split_part(relative_path, '/', 1) AS relative_path FROM corpus) GROUP BY project_id)
SELECT CAST(0 AS BIGINT) AS stage, project_id, CAST(NULL AS VARCHAR) AS relative_path, 'ensure' AS kind, CAST(NULL AS VARCHAR) AS content_hash FROM (SELECT DISTINCT project_id FROM corpus)
UNION ALL SELECT 1, project_id, relative_path, 'create', sha256(text) FROM corpus WHERE NOT is_deleted AND NOT contains(relative_path, '휴지통')
UNION ALL SELECT 2, project_id, NULL, 'reorder', h FROM orders_doc""")
def initial_snapshot(spark, folder):
    from quire.plans.search import searchable

    files = corpus(spark, folder)
    projects = files.select("project_id").distinct()
    roots = files.select("project_id", F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("r")).distinct()
    orders = roots.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("r")), "\n").alias("tree_order"))
    return L.initial_snapshot(searchable(files), projects, orders)


@register("cancel_answers", f"""WITH {OPERATIONS_SQL.strip()},
requests AS (SELECT event_id AS seq, user_id AS operation_id, user_id * 1000 + CAST(floor(value / 30) AS BIGINT) AS event_id FROM events),
judged AS (SELECT r.*, o.status, first_value(r.seq) OVER (PARTITION BY r.operation_id ORDER BY r.seq) AS first_seq
  FROM requests r LEFT JOIN operations o ON r.operation_id = o.operation_id)
SELECT operation_id, event_id, seq, CASE WHEN status IS NULL THEN 'INVALID_ARGUMENT' WHEN status = 'completed' THEN 'OPERATION_TERMINAL'
  WHEN seq = first_seq THEN 'cancelled' ELSE 'already_cancelled' END AS answer FROM judged""")
def cancel_answers(spark, folder):
    requests = table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("operation_id"),
        (F.col("user_id") * 1000 + F.floor(F.col("value") / 30)).alias("event_id"),
    )
    states = operations(spark, folder).select("operation_id", F.col("status").alias("state"))
    return L.cancel_states(requests, states)


@register("offered_lines", """
WITH offers AS (
  SELECT 1 AS turn, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_linenumber < 5
  UNION ALL SELECT 2, l_orderkey, l_linenumber, l_partkey, l_quantity + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END FROM lineitem
  UNION ALL SELECT 3, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_linenumber < 5),
kinds AS (SELECT turn, l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_quantity)) AS kinds, min((l_partkey, l_quantity)) AS row FROM offers GROUP BY ALL),
one AS (SELECT *, row AS stored FROM kinds WHERE turn = 1 AND kinds = 1),
two AS (SELECT k.*, o.stored AS was FROM kinds k LEFT JOIN one o USING (l_orderkey, l_linenumber) WHERE k.turn = 2),
after AS (SELECT l_orderkey, l_linenumber, coalesce(was, CASE WHEN kinds = 1 THEN row END) AS stored FROM two)
SELECT CAST(turn AS INT) AS turn, l_orderkey, l_linenumber, CASE WHEN kinds > 1 THEN 'refused' ELSE 'inserted' END AS outcome FROM kinds WHERE turn = 1
UNION ALL SELECT 2, l_orderkey, l_linenumber, CASE WHEN kinds > 1 THEN 'refused' WHEN was IS NULL THEN 'inserted' WHEN was = row THEN 'present' ELSE 'refused' END FROM two
UNION ALL SELECT 3, l_orderkey, l_linenumber, CASE WHEN kinds > 1 THEN 'refused' WHEN stored IS NULL THEN 'inserted' WHEN stored = row THEN 'present' ELSE 'refused' END
  FROM kinds k JOIN after USING (l_orderkey, l_linenumber) WHERE k.turn = 3
UNION ALL SELECT 4, l_orderkey, l_linenumber, 'stored' FROM after WHERE stored IS NOT NULL""")
def offered_lines(spark, folder):
    # some lines, all lines with some changed, the first ones once more; then what the table holds
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    changed = F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    some, path = lines.where("l_linenumber < 5").drop("l_returnflag"), shared_folder(spark)
    out = None
    for turn, offer in enumerate((some, lines.withColumn("l_quantity", changed).drop("l_returnflag"), some), 1):
        judged = insert_only(offer, path, ["l_orderkey", "l_linenumber"]).select(F.lit(turn).alias("turn"), "*")
        out = judged if out is None else out.unionByName(judged)
    held = read_inserted(spark, path).select(F.lit(4).alias("turn"), "l_orderkey", "l_linenumber", F.lit("stored").alias("outcome"))
    return out.unionByName(held)
