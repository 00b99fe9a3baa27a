"""Readers and writers: the shared tables written in their formats and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quire.functions.names import MANUSCRIPT, TOP
from quire.operators.ordering import plan_order
from quire.plans import hierarchy as H
from quire.registry.core import register
from quire.registry.names import NAMESPACE, uuid5_sql
from quire.registry.roles import table
from quire.session import shared_folder, writing_tasks
from quire.sources import files as S, snapshots as P

_LINES_SQL = """lines AS (SELECT source, 'source=' || source || '/block=' || doc_id // 100 AS folder, doc_id,
  doc_id || ' ' || md5(coalesce(text, '')) || chr(10) AS line FROM documents),
entries AS (
  SELECT 'file' AS kind, folder AS place, CAST(sum(strlen(line)) AS BIGINT) AS bytes, sha256(string_agg(line, '' ORDER BY doc_id, line)) AS content_hash
  FROM lines GROUP BY folder
  UNION ALL SELECT DISTINCT 'folder', folder, CAST(NULL AS BIGINT), NULL FROM lines
  UNION ALL SELECT DISTINCT 'folder', 'source=' || source, CAST(NULL AS BIGINT), NULL FROM lines)"""


def _text_tree(spark, folder) -> str:
    """The documents as text files of a hundred, below a folder per source."""
    path = shared_folder(spark)
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    lines = table(spark, folder, "documents").select("source", F.expr("doc_id div 100").alias("block"), "doc_id", line.alias("value"))
    # few bytes, but a file for each block
    dealt = lines.repartition(writing_tasks(spark), "source", "block").sortWithinPartitions("source", "block", "doc_id", "value")
    dealt.drop("doc_id").write.partitionBy("source", "block").text(path)
    return path


def _place() -> F.Column:
    path = F.col("relative_path")
    return F.when(F.col("kind") == "file", F.regexp_replace(path, "/[^/]*$", "")).otherwise(path).alias("place")


@register("scanned_corpus", f"WITH {_LINES_SQL} SELECT * FROM entries")
def scanned_corpus(spark, folder):
    return S.scan_corpus(spark, _text_tree(spark, folder)).select("kind", _place(), "bytes", "content_hash")


@register("scanned_import", f"WITH {_LINES_SQL} SELECT 'p' AS project_id, true AS valid_utf8, * FROM entries")
def scanned_import(spark, folder):
    entries = S.scan_import_tree(spark, _text_tree(spark, folder), "p")
    return entries.select("project_id", "valid_utf8", "kind", _place(), "bytes", "content_hash")


@register("project_nodes", """
SELECT 'p' || c_nationkey AS project_id, c_mktsegment AS parent_id, c_custkey AS id FROM customer WHERE c_nationkey % 2 = 0 OR c_mktsegment = 'BUILDING'""")
def project_nodes(spark, folder):
    path = shared_folder(spark)
    nodes = table(spark, folder, "customer").select(
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("project_id"), F.col("c_mktsegment").alias("parent_id"), F.col("c_custkey").alias("id")
    )
    nodes.write.partitionBy("project_id").parquet(path)
    nations = [r["n_nationkey"] for r in table(spark, folder, "nation").select("n_nationkey").collect()]
    parts = [P.read_nodes(spark, path, f"p{n}", "BUILDING" if n % 2 else None).select("project_id", "parent_id", "id") for n in nations]
    return reduce(DataFrame.unionByName, parts)


@register("remote_documents", """
SELECT doc_id AS document_id, lang AS project_id, n_chars AS revision, lang = 'fr' AS is_deleted,
  CASE WHEN doc_id % 3 <> 1 THEN 1767225600000000 + doc_id % 60 * 1000000 + CASE WHEN doc_id % 3 = 0 THEN 250000 ELSE 0 END END AS updated_us
FROM documents WHERE lang IS NOT NULL""")
def remote_documents(spark, folder):
    path = shared_folder(spark)
    stamp = F.concat(F.lit("2026-01-01T00:00:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"))
    docs = table(spark, folder, "documents").where("lang IS NOT NULL").select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("project_id"), F.lit("p").alias("relative_path"), F.lit("").alias("content"),
        F.col("n_chars").alias("revision"), (F.col("lang") == "fr").alias("is_deleted"), F.lit(None).cast("string").alias("deleted_at"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(stamp, F.lit(".250Z"))).when(F.col("doc_id") % 3 == 1, "soon").otherwise(F.concat(stamp, F.lit("Z"))).alias("updated_at"),
    )
    docs.write.partitionBy("project_id").parquet(path)
    projects = sorted(r["project_id"] for r in docs.select("project_id").distinct().collect())
    read = reduce(DataFrame.unionByName, [P.read_snapshot(spark, path, p) for p in projects])
    return read.select("document_id", "project_id", "revision", "is_deleted", F.unix_micros("updated_at").alias("updated_us"))


_UUID_SQL = "regexp_replace(md5('{0}' || {1}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5')"


def _uuid(prefix: str, value: F.Column) -> F.Column:
    digest = F.md5(F.concat(F.lit(prefix), value.cast("string")).cast("binary"))
    return F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


@register("server_snapshots", f"""
WITH c AS (SELECT *, c_custkey // 50 AS project FROM customer),
named AS (SELECT *, {_UUID_SQL.format('p', 'project')} AS server_project_id, CASE project % 5 WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN NULL ELSE 'LEGACY' END AS mode FROM c)
SELECT 'document' AS part, server_project_id, CAST(c_custkey AS VARCHAR) AS name, CAST(floor(c_acctbal) AS BIGINT) AS revision FROM named WHERE mode = 'LEGACY'
UNION ALL SELECT 'folder', server_project_id, c_mktsegment, count(*) FROM named WHERE mode = 'LEGACY' GROUP BY server_project_id, c_mktsegment
UNION ALL SELECT 'entry', server_project_id, c_mktsegment, count(*) FROM named WHERE mode = 'LEGACY' GROUP BY server_project_id, c_mktsegment
UNION ALL SELECT 'reject', NULL, 'files', count(DISTINCT project) FROM named WHERE mode IS DISTINCT FROM 'LEGACY'""")
def server_snapshots(spark, folder):
    # one JSON file a project, some with a mode that is unknown or missing
    path = shared_folder(spark)
    custs = table(spark, folder, "customer").withColumn("project", F.expr("c_custkey div 50"))
    per = custs.groupBy("project", "c_mktsegment").agg(F.count("*").alias("n"), F.collect_list(F.col("c_custkey").cast("string")).alias("names"))
    folders = per.groupBy("project").agg(
        F.collect_list(F.struct(F.col("c_mktsegment").alias("name"), F.col("n").alias("revision"))).alias("folders"),
        F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "names"))).alias("entries"),
    )
    documents = custs.groupBy("project").agg(
        F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("document_id"), F.floor("c_acctbal").alias("revision"))).alias("documents")
    )
    mode = F.when(F.col("project") % 5 == 3, "UNKNOWN").when(F.col("project") % 5 == 4, F.lit(None)).otherwise("LEGACY")
    whole = folders.join(documents, "project").select(
        "project", F.lit("1").alias("snapshot_version"), _uuid("p", F.col("project")).alias("server_project_id"), F.lit("name").alias("project_name"),
        mode.alias("project_sync_mode"), F.lit(1).alias("migration_epoch"), "folders", "documents",
        F.struct(F.lit("names").alias("representation"), "entries").alias("tree_order"),
    )
    whole.write.partitionBy("project").json(path)
    read = P.read_server_snapshot(spark, f"{path}/*")
    count = lambda kind, project, name, revision: (F.lit(kind).alias("part"), project, name, revision)
    key = F.col("server_project_id")
    parts = [
        read["documents"].select(*count("document", key, F.col("document_id").alias("name"), F.col("revision"))),
        read["folders"].select(*count("folder", key, F.col("name"), F.col("revision"))),
        read["tree_order"].select(*count("entry", key, F.col("parent_key").alias("name"), F.size("children").cast("long").alias("revision"))),
        read["rejects"].agg(F.count("*").alias("revision")).select(*count("reject", F.lit(None).cast("string").alias("server_project_id"), F.lit("files").alias("name"), F.col("revision"))),
    ]
    return reduce(DataFrame.unionByName, parts)


@register("ordered_plan", """
WITH actions AS (SELECT c_custkey AS folder_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'move' WHEN 'MACHINERY' THEN 'create' WHEN 'FURNITURE' THEN 'delete' ELSE 'conflict' END AS action,
  CASE WHEN c_acctbal > 0 THEN repeat('a/', CAST(floor(c_acctbal / 1000) AS INT)) || 'b' END AS path FROM customer),
ranked AS (SELECT folder_id, CAST(CASE action WHEN 'move' THEN 0 WHEN 'create' THEN 1 WHEN 'delete' THEN 2 ELSE 3 END AS BIGINT) AS rank,
  coalesce(len(string_split(path, '/')), 0) AS depth FROM actions)
SELECT folder_id, rank, CAST(CASE rank WHEN 2 THEN -depth WHEN 3 THEN 0 ELSE depth END AS BIGINT) AS sort_depth FROM ranked""")
def ordered_plan(spark, folder):
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    actions = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("folder_id"),
        F.when(segment == "BUILDING", "move").when(segment == "MACHINERY", "create").when(segment == "FURNITURE", "delete").otherwise("conflict").alias("action"),
        F.when(balance > 0, F.concat(F.repeat(F.lit("a/"), F.floor(balance / 1000).cast("int")), F.lit("b"))).alias("path"),
    )
    return plan_order(actions).select("folder_id", "rank", F.col("sort_depth").cast("long").alias("sort_depth"))


_TREE_SQL = """tree AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, 'folder' AS kind, r_name AS path FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'folder', r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'text', r_name || '/' || n_name || '/' || c_name || '.txt'
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _tree(spark, folder):
    own = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    region, nation, customer = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    regions = region.select(own("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("folder").alias("kind"), F.col("r_name").alias("path"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    places = nations.select(own("n", "n_nationkey").alias("id"), own("r", "n_regionkey").alias("parent_id"), F.lit("folder").alias("kind"), F.concat_ws("/", "r_name", "n_name").alias("path"))
    texts = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        own("c", "c_custkey").alias("id"), own("n", "c_nationkey").alias("parent_id"), F.lit("text").alias("kind"),
        F.concat(F.concat_ws("/", "r_name", "n_name", "c_name"), F.lit(".txt")).alias("path"),
    )
    return regions.unionByName(places).unionByName(texts)


@register("derived_folder_ids", f"""WITH {_TREE_SQL},
ids AS (SELECT id, CASE WHEN id LIKE 'n%5' THEN 'server-' || id ELSE {uuid5_sql("'folder/' || path")} END AS new_id FROM tree WHERE kind = 'folder')
SELECT t.id AS old_id, coalesce(i.new_id, t.id) AS new_id, t.parent_id AS old_parent_id, coalesce(p.new_id, t.parent_id) AS new_parent_id, path AS relative_path
FROM tree t LEFT JOIN ids i ON i.id = t.id LEFT JOIN ids p ON p.id = t.parent_id WHERE i.id IS NOT NULL OR p.id IS NOT NULL""")
def derived_folder_ids(spark, folder):
    nodes = _tree(spark, folder).withColumnsRenamed({"id": "document_id", "path": "relative_path"})
    server = nodes.where("document_id LIKE 'n%5'").select("relative_path", F.concat(F.lit("server-"), "document_id").alias("folder_id"))
    return H.derive_folder_ids(nodes, NAMESPACE, "folder/", server)


@register("restored_nodes", f"""
WITH places AS (SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 'n' || n_nationkey END AS id,
  CASE WHEN n_nationkey < 3 THEN '{TOP}/{MANUSCRIPT}/' ELSE '{TOP}/' END || n_name AS path FROM nation),
trashed AS (SELECT c_custkey, c_acctbal, path, id AS held, CASE WHEN c_custkey % 2 = 0 THEN 'text' ELSE 'folder' END AS kind,
  'doc' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.txt' ELSE '' END AS name, id IS NOT NULL AND c_custkey % 11 = 0 AS clash,
  starts_with(path, '{TOP}/{MANUSCRIPT}/') AS fixed FROM customer JOIN places ON c_nationkey = n_nationkey),
sizes AS (SELECT held, count(*) FILTER (clash) AS n FROM trashed WHERE held IS NOT NULL GROUP BY held)
SELECT c_custkey AS id, coalesce(t.held, 'top') AS parent_id,
  CASE WHEN t.held IS NULL THEN '{TOP}' ELSE path END || '/' || CASE WHEN fixed OR NOT clash THEN name WHEN kind = 'text' THEN 'doc' || c_custkey || '_2.txt' ELSE name || '_2' END AS new_path,
  least(greatest(CAST(floor(c_acctbal / 1000) AS BIGINT), 0), CASE WHEN t.held IS NULL THEN (SELECT count(*) FROM places WHERE id IS NOT NULL) ELSE coalesce(n, 0) END) AS new_order,
  CASE WHEN t.held IS NULL AND kind = 'text' THEN 'textCannotRestoreToTop' WHEN fixed AND clash THEN 'duplicateNormalizedName' END AS problem
FROM trashed t LEFT JOIN sizes s ON s.held = t.held""")
def restored_nodes(spark, folder):
    key, nation = F.col("c_custkey"), F.col("n_nationkey")
    base = F.when(nation < 3, F.lit(f"{TOP}/{MANUSCRIPT}/")).otherwise(F.lit(f"{TOP}/"))
    places = table(spark, folder, "nation").select("n_nationkey", F.concat(F.lit("n"), nation.cast("string")).alias("place_id"), F.concat(base, "n_name").alias("place"))
    text = key % 2 == 0
    name = F.concat(F.lit("doc"), key.cast("string"), F.when(text, ".txt").otherwise(""))
    found = table(spark, folder, "customer").join(places, F.col("c_nationkey") == nation).withColumn("path", F.concat_ws("/", "place", name))
    kind = F.when(text, "text").otherwise("folder").alias("kind")
    trashed = found.select(
        key.alias("id"), kind, F.col("path").alias("original_path"), F.col("place_id").alias("original_parent_id"),
        F.floor(F.col("c_acctbal") / 1000).alias("original_order"),
    )
    live = places.where("n_nationkey < 20").select(F.col("place_id").alias("id"), F.lit("folder").alias("kind"), F.lit("top").alias("parent_id"), F.col("place").alias("relative_path"))
    clashing = found.where("n_nationkey < 20 AND c_custkey % 11 = 0").select(
        F.concat(F.lit("live"), key.cast("string")).alias("id"), F.lit("text").alias("kind"), F.col("place_id").alias("parent_id"), F.col("path").alias("relative_path")
    )
    top = spark.createDataFrame([("top", "folder", None, TOP)], "id string, kind string, parent_id string, relative_path string")
    nodes = top.unionByName(live).unionByName(clashing).withColumn("user_order", F.lit(0))
    return H.restore_plan(trashed, nodes)
