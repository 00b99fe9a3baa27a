"""Queries on snapshots, envelopes, invariants, renames and restores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.windows import current_rows
from quire.plans import contracts as C, hierarchy as H, ledger as L
from quire.registry.core import register
from quire.registry.roles import LEDGER_ORDER, LEDGER_SQL, documents, ledger, table
from quire.sources.snapshots import decode_trash_purge, snapshot_faults


@register("snapshot_faults", """
WITH s AS (SELECT doc_id // 2 AS document_id, CASE WHEN lang = 'de' THEN source || '//x' ELSE source || '/' || doc_id END AS path, n_chars - 300 AS revision,
  lang = 'fr' AS gone, lang = 'fr' AND n_chars > 1000 AS timed FROM documents)
SELECT document_id, 'duplicateId' AS fault FROM s GROUP BY document_id HAVING count(*) > 1
UNION ALL SELECT document_id, CASE WHEN revision <= 0 THEN 'revision' WHEN contains(path, '//') THEN 'path' ELSE 'deletionPair' END FROM s
WHERE revision <= 0 OR contains(path, '//') OR gone <> timed""")
def snapshot_faults_query(spark, folder):
    key = F.col("doc_id").cast("string")
    gone = F.col("lang") == "fr"
    rows = table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 2).alias("document_id"),
        F.when(F.col("lang") == "de", F.concat("source", F.lit("//x"))).otherwise(F.concat_ws("/", "source", key)).alias("relative_path"),
        F.col("text").alias("content"),
        (F.col("n_chars") - 300).alias("revision"),
        gone.alias("is_deleted"),
        F.when(gone & (F.col("n_chars") > 1000), F.lit("2026-01-01")).alias("deleted_at"),
    )
    return snapshot_faults(rows)


_ENVELOPE_SQL = """'{"version": ' || CASE event_type WHEN 'error' THEN '2' ELSE '1' END || ', "purged_revisions": {"' ||
  CASE event_type WHEN 'signup' THEN 'X' ELSE '' END || '0000000' || right(CAST(event_id AS STRING), 1) || '-0000-4000-8000-000000000000": ' ||
  CASE event_type WHEN 'view' THEN '1.5' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END || '}, "empty_generation": ""}'"""


@register("decoded_purges", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'invalidVersion' WHEN 'signup' THEN 'invalidRevision' WHEN 'view' THEN 'invalidEnvelope' END AS fault,
  CASE WHEN event_type NOT IN ('error', 'signup', 'view') THEN CAST(floor(value) AS BIGINT) END AS revision FROM events""")
def decoded_purges(spark, folder):
    envelopes = table(spark, folder, "events").select("event_id", F.expr(_ENVELOPE_SQL).alias("content"))
    decoded = decode_trash_purge(envelopes)
    return decoded.select("event_id", "fault", F.get(F.map_values("revisions"), F.lit(0)).alias("revision"))


_CURRENT_SQL = """current AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY revision DESC,
  created_at DESC, arrival DESC, line_id DESC, project_id DESC, byte_count DESC) = 1)"""


@register("invariant_counts", f"""WITH {LEDGER_SQL.strip()}, {_CURRENT_SQL},
gaps AS (SELECT revision - coalesce(lag(revision) OVER (PARTITION BY document_id ORDER BY revision), 0) AS d FROM ledger),
folders AS (SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN 'n' || (n_nationkey + 1) % 3 ELSE 'r' || n_regionkey END AS parent_id, 'Name' || n_nationkey % 4 AS name, n_regionkey AS project_id FROM nation
  UNION ALL SELECT 'r' || r_regionkey, NULL, r_name, r_regionkey FROM region),
named AS (SELECT 's' || l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
event_gaps AS (SELECT revision - coalesce(lag(revision) OVER (PARTITION BY operation_id ORDER BY revision), 0) AS d FROM ledger),
found AS (
  SELECT 'INV-001' AS invariant FROM gaps WHERE d <> 1
  UNION ALL SELECT 'INV-002' FROM (SELECT operation_id FROM ledger GROUP BY 1 HAVING count(DISTINCT content_hash) > 1)
  UNION ALL SELECT 'INV-003' FROM (SELECT project_id, relative_path FROM current WHERE NOT is_deleted GROUP BY 1, 2 HAVING count(DISTINCT document_id) > 1)
  UNION ALL SELECT 'INV-005' FROM named n LEFT JOIN supplier s ON n.id = 's' || s.s_suppkey WHERE s.s_suppkey IS NULL OR s.s_acctbal < 0 OR n.n > 1
  UNION ALL SELECT 'INV-006' FROM current WHERE is_deleted <> (byte_count > 25)
  UNION ALL SELECT 'INV-009' FROM ledger WHERE device_id = 'F' AND byte_count < 5
  UNION ALL SELECT 'INV-010' FROM folders WHERE id IN ('n0', 'n1', 'n2')
  UNION ALL SELECT 'INV-010' FROM folders c JOIN folders p ON c.parent_id = p.id WHERE c.project_id <> p.project_id
  UNION ALL SELECT 'INV-011' FROM event_gaps WHERE d <> 1
  UNION ALL SELECT 'INV-012' FROM (SELECT project_id, parent_id, lower(name) FROM folders GROUP BY 1, 2, 3 HAVING count(*) > 1)
  UNION ALL SELECT 'INV-013' FROM current WHERE byte_count = 13)
SELECT invariant, count(*) AS violations FROM found GROUP BY invariant""")
def invariant_counts(spark, folder):
    versions = ledger(spark, folder)
    size = F.col("byte_count")
    current = current_rows(versions, "document_id", LEDGER_ORDER).withColumns(
        {"deleted_at": F.when(size > 25, F.lit(1)), "structure_changed": size == 13}
    )
    requests = versions.select(
        "operation_id",
        F.col("content_hash").alias("payload_digest"),
        F.when(F.col("device_id") == "F", "CONTRACT_BATCH").otherwise("LEGACY_EPOCH_0").alias("provenance"),
        F.when(size >= 5, F.lit("b")).alias("batch_id"),
    )
    key = F.col("n_nationkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    folders = table(spark, folder, "nation").select(
        text("n", key).alias("id"),
        F.when(key < 3, text("n", (key + 1) % 3)).otherwise(text("r", F.col("n_regionkey"))).alias("parent_id"),
        text("Name", key % 4).alias("name"),
        F.col("n_regionkey").alias("project_id"),
        F.lit(False).alias("is_deleted"),
    ).unionByName(
        table(spark, folder, "region").select(
            text("r", F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"),
            F.col("r_name").alias("name"), F.col("r_regionkey").alias("project_id"), F.lit(False).alias("is_deleted"),
        )
    )
    orders = table(spark, folder, "lineitem").select(F.array(text("s", F.col("l_suppkey"))).alias("children"))
    entities = table(spark, folder, "supplier").select(text("s", F.col("s_suppkey")).alias("id"), (F.col("s_acctbal") < 0).alias("is_deleted"))
    events = versions.select("operation_id", F.col("revision").alias("event_sequence"))
    found = C.invariant_audit(versions, current, requests, folders, orders, entities, events)
    return found.groupBy("invariant").agg(F.count("*").alias("violations"))


@register("inferred_renames", """
WITH local AS (SELECT n_nationkey AS k, r_name AS parent, n_name AS name, n_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
changed AS (SELECT *, CASE WHEN k IN (3, 8, 11, 19) THEN 'NEW_' || k ELSE name END AS remote_name FROM local),
single AS (SELECT parent FROM changed WHERE name <> remote_name GROUP BY parent HAVING count(*) = 1)
SELECT 'n' || k AS id, parent || '/' || name AS from_path, remote_name AS new_name FROM changed JOIN single USING (parent) WHERE name <> remote_name""")
def inferred_renames(spark, folder):
    key = F.col("n_nationkey")
    local = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = local.select(F.concat(F.lit("n"), key.cast("string")).alias("id"), F.lit("folder").alias("kind"), F.concat_ws("/", "r_name", "n_name").alias("relative_path"))
    name = F.when(key.isin(3, 8, 11, 19), F.concat(F.lit("NEW_"), key.cast("string"))).otherwise(F.col("n_name"))
    remote = local.select(F.col("r_name").alias("parent_path"), name.alias("name"))
    texts = table(spark, folder, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative_path"))
    return H.infer_renames(remote, nodes, texts)


@register("trash_plan", """
WITH ranked AS (SELECT p_partkey, p_brand || '/' || p_name AS root_path, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS turn,
  row_number() OVER (ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey AS id, root_path, '휴지통/' || p_name || CASE WHEN turn > 1 THEN '_' || turn ELSE '' END AS new_path, (SELECT least(max(s_suppkey), 99) FROM supplier) + n AS new_order FROM ranked""")
def trash_plan(spark, folder):
    roots = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_name").alias("relative_path"))
    inside = table(spark, folder, "supplier").select(
        F.lit("trash").alias("parent_id"), F.concat(F.lit("휴지통/"), "s_name").alias("relative_path"),
        F.least(F.col("s_suppkey"), F.lit(99)).alias("user_order"),
    )
    return H.trash_plan(roots, inside, "trash", "휴지통").select("id", "root_path", "new_path", "new_order")


@register("restore_rows", """
WITH fit AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang NOT IN ('fr', 'de'))
SELECT doc_id AS backup_id, 'beforeRestore' AS row_kind, h AS row_hash, CAST(4 AS BIGINT) AS row_generation FROM fit
UNION ALL SELECT doc_id, 'restored', h, 5 FROM fit""")
def restore_rows(spark, folder):
    texts = documents(spark, folder)
    lang = F.col("lang")
    snapshots = texts.select(
        F.col("doc_id").alias("backup_id"), F.when(lang == "de", "other").otherwise("p").alias("project_id"), F.col("doc_id").alias("document_id"),
        F.when(lang == "fr", "0").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"),
    )
    contents = texts.select(F.col("doc_id").alias("backup_id"), "text")
    current = texts.select(F.col("doc_id").alias("document_id"), F.lit("p").alias("project_id"), "text", F.lit(4).cast("bigint").alias("generation"))
    return L.restore_candidates(snapshots, contents, current).select("backup_id", "row_kind", "row_hash", "row_generation")


@register("canonical_order_keys", """
WITH lists AS (SELECT p_brand AS project_id, p_partkey AS k, CASE WHEN p_size < 10 THEN '<root>' WHEN p_size < 30 THEN '메인/플롯/' || p_partkey ELSE '메인/🔍 복선/' || p_size END AS parent_key FROM part),
mapped AS (SELECT project_id, k, CASE WHEN parent_key LIKE '메인/플롯/%' THEN '메인/스토리 플롯/' || k WHEN parent_key LIKE '메인/🔍 복선/%' THEN replace(parent_key, '🔍 복선', '복선') ELSE parent_key END AS parent_key FROM lists),
bad AS (SELECT project_id, max(n) = 1 AS valid FROM (SELECT project_id, parent_key, count(*) AS n FROM mapped GROUP BY 1, 2) GROUP BY 1)
SELECT project_id, parent_key, CASE WHEN parent_key = '<root>' THEN '스토리 플롯' ELSE '플롯' END AS first_child, valid FROM mapped JOIN bad USING (project_id)""")
def canonical_order_keys(spark, folder):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    parent = F.when(size < 10, "<root>").when(size < 30, F.concat(F.lit("메인/플롯/"), key)).otherwise(F.concat(F.lit("메인/🔍 복선/"), size.cast("string")))
    lists = table(spark, folder, "part").select(F.col("p_brand").alias("project_id"), parent.alias("parent_key"), F.array(F.lit("플롯")).alias("children"))
    out = H.canonical_order_keys(lists)
    return out.select("project_id", "parent_key", F.get("children", F.lit(0)).alias("first_child"), "valid")
