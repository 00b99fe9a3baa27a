"""Queries on join, set and order shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N
from quire.operators import ordering as O, relational as R, windows as W
from quire.operators.aggregates import code_point_counts
from quire.operators.ordered import newest, with_row_number
from quire.registry.core import register
from quire.registry.roles import (
    CORPUS_SQL,
    LEDGER_SQL,
    NODES_SQL,
    OP_EVENTS_SQL,
    OPERATIONS_SQL,
    corpus,
    documents,
    ledger,
    nodes,
    op_events,
    operations,
    table,
)
from quire.session import durable


@register("open_conflicts", f"""WITH {OPERATIONS_SQL.strip()}
SELECT o.queue_id, o.project_id, c.c_name AS name, o.error_code FROM operations o
JOIN customer c ON o.document_id = c.c_custkey WHERE o.status = 'conflict' ORDER BY o.project_id, o.queue_id""")
def open_conflicts(spark, folder):
    names = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name")
    )
    conflicts = operations(spark, folder).where("status = 'conflict'")
    return (
        conflicts.join(names, "document_id")
        .select("queue_id", "project_id", "name", "error_code")
        .orderBy("project_id", "queue_id")
    )


@register("orphan_nodes", f"""WITH {NODES_SQL.strip()},
live AS (SELECT *, 1 AS project_id FROM nodes WHERE NOT (kind = 'folder' AND id LIKE 'n1%'))
SELECT c.id, c.parent_id FROM live c LEFT JOIN live p ON c.parent_id = p.id AND c.project_id = p.project_id
WHERE c.parent_id IS NOT NULL AND p.id IS NULL""")
def orphan_nodes(spark, folder):
    deleted = (F.col("kind") == "folder") & F.col("id").startswith("n1")
    tree = nodes(spark, folder).withColumns({"is_deleted": deleted, "project_id": F.lit(1)})
    return R.orphans(tree).select("id", "parent_id")


_LATEST_SQL = f"""WITH {OPERATIONS_SQL.strip()}, {OP_EVENTS_SQL.strip()},
latest AS (SELECT operation_id, event_sequence, event_type FROM op_events
  QUALIFY row_number() OVER (PARTITION BY operation_id
    ORDER BY event_sequence DESC, arrival DESC, event_id DESC, device_id DESC) = 1)"""

# State shown for each newest event type.
EVENT_STATES = {
    "enqueued": "pending",
    "dispatch_started": "inflight",
    "retry_scheduled": "retry_wait",
    "blocked": "blocked",
    "conflict_detected": "conflict",
    "committed": "completed",
    "replayed": "completed",
    "cancel_requested": "cancelled",
    "superseded": "cancelled",
}


def _latest(spark, folder):
    order = ["event_sequence", "arrival", "event_id", "device_id"]
    return newest(op_events(spark, folder), ["operation_id"], order).select(
        "operation_id", "event_sequence", "event_type"
    )


@register("latest_events", _LATEST_SQL + """
SELECT o.operation_id, l.event_sequence, l.event_type FROM operations o LEFT JOIN latest l USING (operation_id)""")
def latest_events(spark, folder):
    ops = operations(spark, folder).select("operation_id")
    return R.latest_event(ops, _latest(spark, folder))


@register("name_clashes", """
WITH parts AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand END AS parent_id, p_name AS name FROM part),
requests AS (SELECT * FROM parts WHERE id IN (SELECT o_custkey FROM orders))
SELECT r.id, r.parent_id, r.name, CASE WHEN r.id < min(p.id) THEN max(p.id) ELSE min(p.id) END AS holder_id FROM requests r
JOIN parts p ON r.name = p.name AND r.parent_id IS NOT DISTINCT FROM p.parent_id AND r.id <> p.id GROUP BY r.id, r.parent_id, r.name""")
def name_clashes(spark, folder):
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("parent_id"),
        F.col("p_name").alias("name"),
    )
    asked = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"))
    return R.name_clashes(parts.join(asked, "id", "left_semi"), parts)


@register("shared_operations", f"""WITH {OPERATIONS_SQL.strip()}, {OP_EVENTS_SQL.strip()}
SELECT operation_id FROM operations JOIN (SELECT DISTINCT operation_id FROM op_events) USING (operation_id)""")
def shared_operations(spark, folder):
    events = op_events(spark, folder).select("operation_id")
    return operations(spark, folder).select("operation_id").join(events, "operation_id", "left_semi")


_RANGES = [
    (0x20, 0x7E, "basic"), (0xA0, 0xFF, "latin1"), (0x100, 0x24F, "latinExtended"), (0x370, 0x3FF, "greek"),
    (0x400, 0x52F, "cyrillic"), (0x2000, 0x206F, "punctuation"), (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7A3, "hangul"), (0x1F300, 0x1FAFF, "pictographs"),
]


@register("codepoint_blocks", f"""
WITH chars AS (SELECT unicode(unnest(string_split(text, ''))) AS cp FROM documents),
counted AS (SELECT CAST(cp AS BIGINT) AS cp, count(*) AS n FROM chars GROUP BY cp),
ranges(a, b, block) AS (VALUES {', '.join(str(r) for r in _RANGES)})
SELECT cp, n, block FROM counted JOIN ranges ON cp BETWEEN a AND b""")
def codepoint_blocks(spark, folder):
    ranges = spark.createDataFrame(_RANGES, "range_start bigint, range_end bigint, block string")
    # counting first leaves one row per code point, whatever the corpus holds
    counted = code_point_counts(documents(spark, folder), "text")
    return R.range_lookup(counted, "cp", ranges).select("cp", "n", "block")


@register("documents_under_folder", f"""WITH {CORPUS_SQL.strip()},
folders AS (SELECT DISTINCT source AS folder_path FROM documents UNION ALL SELECT '휴지통')
SELECT document_id, folder_path FROM corpus JOIN folders ON starts_with(relative_path, folder_path || '/')""")
def documents_under_folder(spark, folder):
    sources = table(spark, folder, "documents").select(F.col("source").alias("folder_path")).distinct()
    trash = spark.range(1).select(F.lit("휴지통").alias("folder_path"))
    files = corpus(spark, folder).select("document_id", "relative_path")
    return R.under_folder(files, sources.unionByName(trash)).select("document_id", "folder_path")


@register("disk_matches", """
WITH entries AS (SELECT p_partkey AS entry_id, lower(p_name) || '/' || p_partkey AS path_key, p_brand AS parent_id,
    CASE WHEN p_size > 45 THEN 'folder' ELSE 'text' END AS kind, p_type || p_size AS content_hash FROM part),
renamed AS (SELECT entry_id AS node_id, CASE WHEN content_hash LIKE 'S%' THEN path_key || 'x' ELSE path_key END AS path_key,
    parent_id, kind, content_hash FROM entries),
exact AS (SELECT e.*, n.node_id FROM entries e LEFT JOIN renamed n USING (path_key, kind)),
le AS (SELECT parent_id, content_hash, min(path_key) AS path_key FROM exact WHERE node_id IS NULL AND kind = 'text'
  GROUP BY 1, 2 HAVING count(*) = 1),
ln AS (SELECT parent_id, content_hash, min(node_id) AS node_id FROM renamed WHERE kind = 'text'
  AND node_id NOT IN (SELECT node_id FROM exact WHERE node_id IS NOT NULL) GROUP BY 1, 2 HAVING count(*) = 1),
moved AS (SELECT path_key, ln.node_id FROM le JOIN ln USING (parent_id, content_hash))
SELECT entry_id, coalesce(e.node_id, m.node_id) AS node_id,
  CASE WHEN e.node_id IS NOT NULL THEN 'path' WHEN m.node_id IS NOT NULL THEN 'hash' ELSE 'new' END AS matched_by
FROM exact e LEFT JOIN moved m USING (path_key)""")
def disk_matches(spark, folder):
    entries = table(spark, folder, "part").select(
        F.col("p_partkey").alias("entry_id"),
        F.concat(F.lower("p_name"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path_key"),
        F.col("p_brand").alias("parent_id"),
        F.when(F.col("p_size") > 45, "folder").otherwise("text").alias("kind"),
        F.concat("p_type", F.col("p_size").cast("string")).alias("content_hash"),
    )
    path = F.col("path_key")
    known = entries.select(
        F.col("entry_id").alias("node_id"),
        F.when(F.col("content_hash").startswith("S"), F.concat(path, F.lit("x"))).otherwise(path).alias("path_key"),
        "parent_id", "kind", "content_hash",
    )
    return R.match_disk_entries(entries, known).select("entry_id", "node_id", "matched_by")


# Fixed values of this query: what a client must declare and may declare.
_REQUIRED = ["ECONOMY"]
_ALLOWED = ["ECONOMY", "PROMO", "STANDARD", "small", "red", "blue", "large", "green", "ring", "widget", "gear", "bolt"]


@register("capability_audit", f"""
WITH declared AS (SELECT p_partkey AS batch_id, list_append(string_split(p_name, ' '), p_type) AS caps FROM part)
SELECT batch_id, CASE WHEN len(list_distinct(caps)) <> len(caps) OR NOT list_has_all(caps, {_REQUIRED})
  OR NOT list_has_all({_ALLOWED}, caps) THEN 'CAPABILITY_MISMATCH' END AS code FROM declared""")
def capability_audit(spark, folder):
    def words(values):
        return F.array(*[F.lit(v) for v in values])

    declared = table(spark, folder, "part").select(
        F.col("p_partkey").alias("batch_id"), F.array_append(F.split("p_name", " "), F.col("p_type")).alias("caps")
    )
    return declared.select(
        "batch_id", R.capability_code(F.col("caps"), words(_REQUIRED), words(_ALLOWED)).alias("code")
    )


@register("tree_references", f"""WITH {NODES_SQL.strip()},
named AS (SELECT 'c' || o_custkey AS id FROM orders UNION ALL SELECT 's' || l_suppkey FROM lineitem),
counts AS (SELECT id, count(*) AS n FROM named GROUP BY id)
SELECT n.id, coalesce(c.n, 0) AS "references" FROM nodes n LEFT JOIN counts c USING (id)
WHERE n.parent_id IS NOT NULL AND coalesce(c.n, 0) <> 1""")
def tree_references(spark, folder):
    def lists(name, prefix, column):
        ref = F.concat(F.lit(prefix), F.col(column).cast("string"))
        return table(spark, folder, name).select(F.array(ref).alias("children"))

    orders = lists("orders", "c", "o_custkey").unionByName(lists("lineitem", "s", "l_suppkey"))
    counted = R.reference_counts(orders, nodes(spark, folder).where("parent_id IS NOT NULL"))
    return counted.where('`references` <> 1').select("id", "references")


@register("superseded_operations", f"""WITH {OPERATIONS_SQL.strip()},
linked AS (SELECT *, CASE WHEN status <> 'completed' THEN operation_id - 1 END AS supersedes_operation_id FROM operations)
SELECT a.operation_id, a.supersedes_operation_id, b.status AS original_status, b.base_revision AS original_base
FROM linked a LEFT JOIN linked b ON a.supersedes_operation_id = b.operation_id
WHERE a.supersedes_operation_id IS NOT NULL""")
def superseded_operations(spark, folder):
    linked = operations(spark, folder).withColumn(
        "supersedes_operation_id", F.when(F.col("status") != "completed", F.col("operation_id") - 1)
    )
    return R.successors(linked).select(
        "operation_id", "supersedes_operation_id", "original_status", "original_base"
    )


@register("remote_comparison", """
WITH remote AS (SELECT c_custkey AS id, c_nationkey AS parent_id, c_mktsegment AS name FROM customer),
local AS (SELECT DISTINCT ON (o_custkey) o_custkey AS id, CAST(o_custkey % 25 AS INTEGER) AS parent_id,
    CASE WHEN o_totalprice > 200000 THEN 'BUILDING' END AS name FROM orders ORDER BY o_custkey, o_orderkey DESC)
SELECT r.id, CASE WHEN l.id IS NULL THEN 'missing' WHEN r.parent_id = l.parent_id AND r.name IS NOT DISTINCT FROM l.name
  THEN 'same' ELSE 'different' END AS comparison
FROM remote r LEFT JOIN local l USING (id)""")
def remote_comparison(spark, folder):
    remote = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent_id"), F.col("c_mktsegment").alias("name")
    )
    local = newest(table(spark, folder, "orders"), ["o_custkey"], ["o_orderkey"]).select(
        F.col("o_custkey").alias("id"),
        (F.col("o_custkey") % 25).cast("int").alias("parent_id"),
        F.when(F.col("o_totalprice") > 200000, "BUILDING").alias("name"),
    )
    return R.compare_by_id(remote, local, "id", ["parent_id", "name"]).select("id", "comparison")


@register("live_entries", f"""WITH {NODES_SQL.strip()}
SELECT id, parent_id, name, kind FROM nodes WHERE kind = 'folder' UNION ALL
SELECT id, parent_id, name, kind FROM nodes WHERE kind = 'text'""")
def live_entries(spark, folder):
    tree = nodes(spark, folder).select("id", "parent_id", "name", "kind")
    return tree.where("kind = 'folder'").unionByName(tree.where("kind = 'text'"))


@register("child_order_diff", """
WITH remote AS (SELECT DISTINCT p_brand AS parent_id, lower(p_name) AS name_key FROM part WHERE p_size <= 30),
local AS (SELECT DISTINCT p_brand AS parent_id, lower(p_name) AS name_key FROM part WHERE p_size >= 20)
SELECT parent_id, name_key, 'vanished' AS change FROM (SELECT * FROM local EXCEPT SELECT * FROM remote)
UNION ALL SELECT parent_id, name_key, 'added' FROM (SELECT * FROM remote EXCEPT SELECT * FROM local)""")
def child_order_diff(spark, folder):
    parts = table(spark, folder, "part")
    keyed = [F.col("p_brand").alias("parent_id"), F.lower("p_name").alias("name_key")]
    remote = parts.where("p_size <= 30").select(*keyed).distinct()
    local = parts.where("p_size >= 20").select(*keyed).distinct()
    return R.order_diff(remote, local)


@register("staged_snapshots", f"""WITH {LEDGER_SQL.strip()}
SELECT document_id, revision, line_id, CAST(CASE WHEN byte_count = 1 THEN 0 WHEN byte_count = 50 THEN 3
  WHEN is_deleted THEN 1 ELSE 2 END AS BIGINT) AS stage FROM ledger""")
def staged_snapshots(spark, folder):
    size = F.col("byte_count")
    kind = F.when(size == 1, "trash_purge").when(size == 50, "tree_order").otherwise("document")
    return R.staged_union(ledger(spark, folder).withColumn("kind", kind)).select(
        "document_id", "revision", "line_id", "stage"
    )


@register("authorized_requests", """
WITH projects AS (SELECT c_custkey AS project_id, c_nationkey AS owner_id, c_acctbal < 0 AS trashed FROM customer),
members AS (SELECT user_id AS project_id, CAST(floor(value) AS INTEGER) % 25 AS user_id,
  max(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END) AS rank FROM events GROUP BY 1, 2),
requests AS (SELECT o_orderkey AS request_id, o_custkey AS project_id, CAST(o_orderkey % 25 AS INTEGER) AS user_id FROM orders)
SELECT request_id, r.project_id, r.user_id FROM requests r JOIN projects p ON r.project_id = p.project_id AND NOT trashed
LEFT JOIN members m ON m.project_id = r.project_id AND m.user_id = r.user_id
WHERE owner_id = r.user_id OR coalesce(rank, 0) >= 2""")
def authorized_requests(spark, folder):
    trashed = F.when(F.col("c_acctbal") < 0, F.lit(1))
    projects = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("owner_id"), trashed.alias("trashed_at")
    )
    kind = F.col("event_type")
    members = table(spark, folder, "events").select(
        F.col("user_id").alias("project_id"),
        (F.floor("value").cast("int") % 25).alias("user_id"),
        F.when(kind == "click", "owner").when(kind == "view", "editor").otherwise("viewer").alias("role"),
    )
    requests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("project_id"),
        (F.col("o_orderkey") % 25).cast("int").alias("user_id"),
    )
    return R.authorized(requests, projects, members, "editor").select("request_id", "project_id", "user_id")


@register("write_decisions", f"""
WITH matrix(mode, protocol_version, allowed, code) AS (VALUES {', '.join(
    f"('{m}', {p}, {str(a).lower()}, {'NULL' if c is None else repr(c)})" for m, p, a, c in R.WRITE_MATRIX)}),
requests AS (SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'F' THEN 'LEGACY' WHEN 'O' THEN 'MIGRATING'
    ELSE 'ID_BASED' END AS mode, CAST(left(o_orderpriority, 1) AS INTEGER) AS protocol_version FROM orders)
SELECT request_id, coalesce(allowed, false) AS allowed,
  CASE WHEN allowed IS NULL THEN 'INVALID_ARGUMENT' ELSE code END AS code
FROM requests LEFT JOIN matrix USING (mode, protocol_version)""")
def write_decisions(spark, folder):
    status = F.col("o_orderstatus")
    requests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(status == "F", "LEGACY").when(status == "O", "MIGRATING").otherwise("ID_BASED").alias("mode"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("protocol_version"),
    )
    return R.write_allowed(requests).select("request_id", "allowed", "code")


@register("misplaced_texts", f"""WITH {NODES_SQL.strip()},
moved AS (SELECT id, CASE WHEN kind = 'text' AND parent_id = 'n3' THEN 'r0' ELSE parent_id END AS parent_id, name, kind FROM nodes)
SELECT id FROM moved WHERE kind = 'text' AND parent_id IN
  (SELECT id FROM moved WHERE parent_id IS NULL AND name = 'AFRICA')""")
def misplaced_texts(spark, folder):
    moved = F.when((F.col("kind") == "text") & (F.col("parent_id") == "n3"), "r0").otherwise(F.col("parent_id"))
    tree = nodes(spark, folder).withColumn("parent_id", moved)
    return R.placement_violations(tree, "AFRICA").select("id")


@register("operation_states", _LATEST_SQL + f"""
SELECT o.operation_id, CASE l.event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATES.items())}
  ELSE 'pending' END AS state, l.event_sequence FROM operations o LEFT JOIN latest l USING (operation_id)""")
def operation_states(spark, folder):
    state = F.lit("pending")
    for event, shown in EVENT_STATES.items():
        state = F.when(F.col("event_type") == event, shown).otherwise(state)
    ops = operations(spark, folder).select("operation_id")
    return R.latest_event(ops, _latest(spark, folder)).select(
        "operation_id", state.alias("state"), "event_sequence"
    )


@register("missing_remote_candidates", f"""WITH {OPERATIONS_SQL.strip()}
known AS (SELECT c_custkey AS document_id FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) FROM customer) FROM supplier)
SELECT document_id FROM known k WHERE NOT EXISTS (
  SELECT 1 FROM operations o WHERE o.document_id = k.document_id AND status NOT IN ('completed', 'cancelled'))""".replace("known AS", ", known AS", 1))
def missing_remote_candidates(spark, folder):
    # the suppliers' documents have no operations, most customers' have
    custs = table(spark, folder, "customer")
    after = custs.agg(F.max("c_custkey")).scalar()
    known = custs.where("c_acctbal >= 0").select(F.col("c_custkey").alias("document_id")).unionByName(table(spark, folder, "supplier").select((F.col("s_suppkey") + after).alias("document_id")))
    busy = W.unfinished(operations(spark, folder)).select("document_id")
    return known.join(busy, "document_id", "left_anti")


@register("natural_order", """
WITH named AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN p_size || '권' WHEN p_size > 20
    THEN lpad(CAST(p_size AS VARCHAR), 3, '0') || '화.txt' ELSE p_name END AS name FROM part),
numbered AS (SELECT *, CASE WHEN name LIKE '%권' OR name LIKE '%화.txt'
    THEN CAST(regexp_extract(name, '^[0-9]+') AS BIGINT) END AS number FROM named)
SELECT id, name, number FROM numbered ORDER BY number NULLS LAST, name""")
def natural_order(spark, folder):
    size = F.col("p_size")
    text = size.cast("string")
    name = (
        F.when(size > 40, F.concat(text, F.lit("권")))
        .when(size > 20, F.concat(F.lpad(text, 3, "0"), F.lit("화.txt")))
        .otherwise(F.col("p_name"))
    )
    named = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    number = F.coalesce(N.volume_number(F.col("name")), N.chapter_number(F.col("name")))
    return O.natural_order(named, "name").select("id", "name", number.alias("number"))


@register("binder_order", """
WITH items AS (SELECT p_partkey AS id, lpad(CAST(p_partkey * 7919 % 1000003 AS VARCHAR), 7, '0') AS display_name,
    CASE p_brand WHEN 'Brand#1' THEN 'manuscript' WHEN 'Brand#2' THEN 'trash' WHEN 'Brand#3' THEN 'settings' WHEN 'Brand#4' THEN 'plot' END AS category,
    CASE WHEN p_size > 40 THEN 1000000 + p_size ELSE p_size END AS user_order FROM part),
banded AS (SELECT *, CAST(CASE WHEN category = 'manuscript' THEN 0 WHEN category = 'trash' THEN 4 WHEN user_order >= 1000000 THEN 1
  WHEN category IS NOT NULL THEN 2 ELSE 3 END AS BIGINT) AS band FROM items)
SELECT id, band, row_number() OVER (ORDER BY band, CASE WHEN band = 2 THEN CASE category WHEN 'settings' THEN 2 ELSE 1 END ELSE user_order END, display_name) AS place FROM banded""")
def binder_order(spark, folder):
    brand, size = F.col("p_brand"), F.col("p_size")
    items = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.lpad((F.col("p_partkey") * 7919 % 1000003).cast("string"), 7, "0").alias("display_name"),
        F.when(brand == "Brand#1", "manuscript").when(brand == "Brand#2", "trash").when(brand == "Brand#3", "settings").when(brand == "Brand#4", "plot").alias("category"),
        F.when(size > 40, size + 1_000_000).otherwise(size).alias("user_order"),
        F.when(brand == "Brand#3", 2).otherwise(1).alias("fixed_order"),
    )
    # the place of each row in the order it comes out
    ordered = O.binder_order(items).select("id", "band", F.monotonically_increasing_id().alias("_out"), F.lit(1).alias("_all"))
    return with_row_number(durable(ordered), ["_all"], ["_out"], "place").select("id", "band", "place")


@register("trashed_projects", """
SELECT c_custkey AS project_id, c_name AS name, CAST(floor(-c_acctbal) AS BIGINT) AS trashed_at FROM customer
WHERE c_acctbal < 0 ORDER BY trashed_at DESC, name, project_id""")
def trashed_projects(spark, folder):
    projects = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, F.floor(-F.col("c_acctbal")).cast("bigint")).alias("trashed_at"),
    )
    return O.trashed_projects(projects)
