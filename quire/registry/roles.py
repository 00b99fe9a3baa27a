"""The shared tables in the roles the jobs work on, as DataFrame and as SQL.

Every role covers its whole table; roles only rename and derive columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, ready for costly text work."""
    return spread(table(spark, folder, "documents"), "doc_id")


# --- corpus: documents as text files below a folder tree -----------------------------

CORPUS_SQL = """
corpus AS (
  SELECT d.doc_id AS document_id, d.lang AS project_id, d.text, d.n_chars,
         CASE WHEN l.toxic = 1 THEN '휴지통/' ELSE '' END || d.source || '/' || d.doc_id || '.txt'
           AS relative_path,
         CASE WHEN l.quality = 0 THEN true ELSE false END AS is_deleted
  FROM documents d LEFT JOIN (
    SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id
  ) l ON d.doc_id = l.doc_id)
"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    labels = (
        table(spark, folder, "labels")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    )
    return (
        documents(spark, folder)
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("document_id"),
            F.col("lang").alias("project_id"),
            "text",
            "n_chars",
            F.concat(
                F.when(F.col("toxic") == 1, "휴지통/").otherwise(""),
                "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"),
            ).alias("relative_path"),
            F.coalesce(F.col("quality") == 0, F.lit(False)).alias("is_deleted"),
        )
    )


# --- chapters: conversation turns as numbered chapters of a manuscript ---------------

CHAPTERS_SQL = """
chapters AS (
  SELECT conv_id AS project_id, turn + 1 AS number, conv_id * 1000 + turn AS document_id, text,
         '메인/원고/1권/' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0') || '화'
           || CASE WHEN role = 'user' THEN '' ELSE ' ' || role END || '.txt' AS relative_path
  FROM conversations)
"""


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    number = (F.col("turn") + 1).cast("string")
    title = F.when(F.col("role") == "user", "").otherwise(F.concat(F.lit(" "), "role"))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("project_id"),
        (F.col("turn") + 1).alias("number"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"),
        "text",
        F.concat(F.lit("메인/원고/1권/"), F.lpad(number, 3, "0"), F.lit("화"), title, F.lit(".txt")).alias(
            "relative_path"
        ),
    )


# --- ledger: order lines as document versions ----------------------------------------

LEDGER_SQL = """
ledger AS (
  SELECT l_orderkey AS document_id, l_suppkey AS project_id, CAST(l_linenumber AS BIGINT) AS revision,
         CAST(l_linenumber AS BIGINT) - 1 AS base_revision, l_partkey AS line_id,
         l_orderkey || '-' || l_linenumber AS operation_id,
         'part/' || l_partkey AS relative_path, CAST(l_quantity AS BIGINT) AS byte_count,
         sha256(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS content_hash,
         l_returnflag = 'R' AS is_deleted, l_linestatus AS device_id, l_shipdate AS created_at,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS arrival
  FROM lineitem)
"""


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("bigint")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_suppkey").alias("project_id"),
        F.col("l_linenumber").cast("bigint").alias("revision"),
        (F.col("l_linenumber").cast("bigint") - 1).alias("base_revision"),
        F.col("l_partkey").alias("line_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(
            "operation_id"
        ),
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("relative_path"),
        quantity.alias("byte_count"),
        (F.col("l_returnflag") == "R").alias("is_deleted"),
        F.col("l_linestatus").alias("device_id"),
        F.col("l_shipdate").alias("created_at"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("arrival"),
    )
    return with_digest(rows)


def with_digest(rows: DataFrame) -> DataFrame:
    """Versions of the ledger with the digest of their content, which is their size in digits."""
    return rows.withColumn("content_hash", F.sha2(F.col("byte_count").cast("string").cast("binary"), 256))


#: A total order on the versions of one document.
LEDGER_ORDER = ["revision", "created_at", "arrival", "line_id", "project_id", "byte_count"]
LEDGER_ORDER_SQL = "revision, created_at, arrival, line_id, project_id, byte_count"


# --- snapshots: events as backups of the document a user works on ---------------------

SNAPSHOTS_SQL = """
snapshots AS (
  SELECT event_id AS backup_id, user_id AS document_id, ts AS created_at,
         CASE event_type WHEN 'click' THEN 'automaticSave' WHEN 'view' THEN 'editingInterval'
           WHEN 'signup' THEN 'documentClose' WHEN 'purchase' THEN 'manual' ELSE 'conflict' END AS reason,
         event_type = 'purchase' AND value > 20 AS is_pinned, props AS content_hash,
         CAST(floor(value * 100000) AS BIGINT) AS byte_count
  FROM events)
"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots_of(table(spark, folder, "events"))


def snapshots_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    reason = (
        F.when(kind == "click", "automaticSave")
        .when(kind == "view", "editingInterval")
        .when(kind == "signup", "documentClose")
        .when(kind == "purchase", "manual")
        .otherwise("conflict")
    )
    return events.select(
        F.col("event_id").alias("backup_id"),
        F.col("user_id").alias("document_id"),
        F.col("ts").alias("created_at"),
        reason.alias("reason"),
        ((kind == "purchase") & (F.col("value") > 20)).alias("is_pinned"),
        F.col("props").alias("content_hash"),
        F.floor(F.col("value") * 100000).cast("bigint").alias("byte_count"),
    )


# --- operations: orders as queued operations; their lines as recorded events ----------

OPERATIONS_SQL = """
operations AS (
  SELECT o_orderkey AS queue_id, o_orderkey AS operation_id, o_custkey AS document_id,
         c_nationkey AS project_id, c_mktsegment AS batch_id, o_orderdate AS created_at,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'create' WHEN '2-HIGH' THEN 'update'
           WHEN '3-MEDIUM' THEN 'move' WHEN '4-NOT SPECIFIED' THEN 'treeOrder' ELSE 'delete' END
           AS operation_kind,
         CASE WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderstatus = 'P' THEN 'retry_wait'
              WHEN o_totalprice < 50000 THEN 'conflict'
              WHEN o_totalprice < 100000 THEN 'blocked'
              WHEN o_totalprice < 150000 THEN 'inflight'
              ELSE 'pending' END AS status,
         CASE WHEN o_totalprice < 150000 THEN
           CASE WHEN o_orderstatus = 'P' THEN 'NETWORK' ELSE 'REVISION_CONFLICT' END END AS error_code,
         CAST(floor(o_totalprice) AS BIGINT) AS base_revision
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
"""


def operations(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("queue_id"),
        F.col("o_orderkey").alias("operation_id"),
        F.col("o_custkey").alias("document_id"),
        F.col("c_nationkey").alias("project_id"),
        F.col("c_mktsegment").alias("batch_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(priority == "1-URGENT", "create")
        .when(priority == "2-HIGH", "update")
        .when(priority == "3-MEDIUM", "move")
        .when(priority == "4-NOT SPECIFIED", "treeOrder")
        .otherwise("delete")
        .alias("operation_kind"),
        F.when(status == "F", "completed")
        .when(status == "P", "retry_wait")
        .when(price < 50000, "conflict")
        .when(price < 100000, "blocked")
        .when(price < 150000, "inflight")
        .otherwise("pending")
        .alias("status"),
        F.when(price < 150000, F.when(status == "P", "NETWORK").otherwise("REVISION_CONFLICT")).alias(
            "error_code"
        ),
        F.floor(price).cast("bigint").alias("base_revision"),
    )


# --- operation events: order lines as the event history of their order ----------------

OP_EVENTS_SQL = """
op_events AS (
  SELECT l_orderkey AS operation_id, CAST(l_linenumber AS BIGINT) AS event_sequence,
         l_orderkey * 10 + l_linenumber AS event_id,
         CASE WHEN l_returnflag = 'R' THEN 'retry_scheduled'
              WHEN l_returnflag = 'A' AND l_quantity > 45 THEN 'committed'
              WHEN l_returnflag = 'A' AND l_quantity < 4 THEN 'cancel_requested'
              WHEN l_returnflag = 'A' THEN 'blocked'
              WHEN l_linestatus = 'F' THEN 'conflict_detected'
              WHEN l_quantity < 10 THEN 'enqueued'
              ELSE 'dispatch_started' END AS event_type,
         l_shipdate AS recorded_at, l_suppkey AS device_id,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS arrival
  FROM lineitem)
"""


def op_events(spark: SparkSession, folder: str) -> DataFrame:
    flag, line, qty = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("operation_id"),
        F.col("l_linenumber").cast("bigint").alias("event_sequence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.when(flag == "R", "retry_scheduled")
        .when((flag == "A") & (qty > 45), "committed")
        .when((flag == "A") & (qty < 4), "cancel_requested")
        .when(flag == "A", "blocked")
        .when(line == "F", "conflict_detected")
        .when(qty < 10, "enqueued")
        .otherwise("dispatch_started")
        .alias("event_type"),
        F.col("l_shipdate").alias("recorded_at"),
        F.col("l_suppkey").alias("device_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("arrival"),
    )


# --- hierarchy: region > nation > customer and supplier as a folder tree --------------

NODES_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, 'folder' AS kind,
         CAST(r_regionkey AS BIGINT) AS user_order FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'folder', CAST(n_nationkey AS BIGINT)
  FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 'text', c_custkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 'folder', s_suppkey FROM supplier)
"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    def part(name, prefix, key, parent_prefix, parent, label, kind):
        up = F.lit(None).cast("string") if parent is None else F.concat(F.lit(parent_prefix), F.col(parent).cast("string"))
        return table(spark, folder, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"),
            up.alias("parent_id"),
            F.col(label).alias("name"),
            F.lit(kind).alias("kind"),
            F.col(key).cast("bigint").alias("user_order"),
        )

    return (
        part("region", "r", "r_regionkey", None, None, "r_name", "folder")
        .unionByName(part("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name", "folder"))
        .unionByName(part("customer", "c", "c_custkey", "n", "c_nationkey", "c_name", "text"))
        .unionByName(part("supplier", "s", "s_suppkey", "n", "s_nationkey", "s_name", "folder"))
    )


NODE_PATHS_SQL = NODES_SQL.strip() + """,
node_paths AS (
  SELECT n.*, CASE WHEN p2.id IS NOT NULL THEN p2.name || '/' || p1.name || '/' || n.name
                   WHEN p1.id IS NOT NULL THEN p1.name || '/' || n.name ELSE n.name END AS path,
         CAST(1 + (p1.id IS NOT NULL)::INT + (p2.id IS NOT NULL)::INT AS BIGINT) AS depth
  FROM nodes n LEFT JOIN nodes p1 ON n.parent_id = p1.id LEFT JOIN nodes p2 ON p1.parent_id = p2.id)
"""


# --- leases: events on the document a user works on, held by the kind of event --------

LEASES_SQL = """
offered AS (
  SELECT event_id AS lease_event_id, user_id AS document_id, event_type || '/d' AS holder, value > 60 AS gives_up, epoch_us(ts) AS moment,
         1000000 * greatest(30, least(CAST(floor(value) AS BIGINT), 120)) AS ttl,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events),
walk AS (
  SELECT DISTINCT document_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS lease_event_id, CAST(NULL AS VARCHAR) AS who,
         CAST(NULL AS BIGINT) AS moment, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS BIGINT) AS until
  FROM offered
  UNION ALL
  SELECT document_id, n, lease_event_id, holder, moment,
         CASE WHEN gives_up THEN CASE WHEN h = holder THEN 'released' ELSE 'notHeld' END
              WHEN h <> holder THEN 'LEASE_CONFLICT' WHEN h = holder THEN 'renewed' ELSE 'acquired' END,
         CASE WHEN gives_up THEN CASE WHEN h = holder THEN NULL ELSE h END WHEN h <> holder THEN h ELSE holder END,
         CASE WHEN gives_up THEN CASE WHEN h = holder THEN NULL ELSE u END WHEN h <> holder THEN u ELSE moment + ttl END
  FROM (SELECT o.*, CASE WHEN w.until > o.moment THEN w.held END AS h, CASE WHEN w.until > o.moment THEN w.until END AS u
        FROM walk w JOIN offered o ON o.document_id = w.document_id AND o.n = w.n + 1))
"""


def lease_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("lease_event_id"),
        F.col("user_id").alias("document_id"),
        F.concat("event_type", F.lit("/d")).alias("holder"),
        F.col("event_type").alias("user_id"),
        F.lit("d").alias("device_id"),
        F.when(F.col("value") > 60, "release").otherwise("acquire").alias("action"),
        "ts",
        F.floor("value").cast("int").alias("ttl_seconds"),
    )
