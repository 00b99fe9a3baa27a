"""Queries on the region > nation > customer/supplier tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.names import parent_path
from quire.operators.ordered import with_row_number
from quire.plans import hierarchy as H
from quire.registry.core import register
from quire.registry.roles import CORPUS_SQL, NODE_PATHS_SQL, NODES_SQL, corpus, nodes, table


@register("folder_paths", f"WITH {NODE_PATHS_SQL} SELECT id, path, depth, 'resolved' AS outcome FROM node_paths")
def folder_paths(spark, folder):
    return H.folder_paths(nodes(spark, folder))


def _with_paths(spark, folder):
    tree = nodes(spark, folder)
    return tree.join(H.folder_paths(tree).select("id", F.col("path").alias("relative_path")), "id")


@register("unreachable_folders", f"""WITH RECURSIVE {NODES_SQL.strip()},
bent AS (SELECT id, CASE id WHEN 'r0' THEN 'n0' WHEN 'r1' THEN 'x9' ELSE parent_id END AS parent_id, id = 'n7' AS is_deleted FROM nodes),
walk AS (SELECT id, parent_id AS up, is_deleted AS gone, 0 AS steps FROM bent
  UNION ALL SELECT w.id, b.parent_id, w.gone OR b.is_deleted, w.steps + 1 FROM walk w JOIN bent b ON w.up = b.id WHERE w.steps < 8),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY steps DESC) = 1)
SELECT id, CASE WHEN steps = 8 THEN 'parentCycle' ELSE 'unknownParent' END AS outcome FROM last
WHERE steps = 8 OR up IS NOT NULL OR gone""")
def unreachable_folders(spark, folder):
    # one region hangs below its own nation, one below an unknown parent, one nation is deleted
    up = F.when(F.col("id") == "r0", "n0").when(F.col("id") == "r1", "x9").otherwise(F.col("parent_id"))
    bent = nodes(spark, folder).withColumns({"parent_id": up, "is_deleted": F.col("id") == "n7"})
    return H.cycles(bent)


@register("cyclic_moves", f"""WITH {NODES_SQL.strip()},
moves AS (SELECT 'r' || (s_suppkey % 5) AS id, 's' || s_suppkey AS new_parent_id FROM supplier)
SELECT m.id, m.new_parent_id FROM moves m JOIN nodes s ON m.new_parent_id = s.id JOIN nodes n ON s.parent_id = n.id
WHERE m.id IN (s.id, n.id, n.parent_id)""")
def cyclic_moves(spark, folder):
    moves = table(spark, folder, "supplier").select(
        F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")).alias("id"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("new_parent_id"),
    )
    return H.moves_into_cycle(moves, nodes(spark, folder)).select("id", "new_parent_id")


@register("ancestor_folders", f"""WITH {CORPUS_SQL.strip()},
up AS (SELECT DISTINCT regexp_replace(relative_path, '/[^/]*$', '') AS p FROM corpus)
SELECT p AS folder_path FROM up UNION SELECT split_part(p, '/', 1) FROM up WHERE contains(p, '/')""")
def ancestor_folders(spark, folder):
    return H.ancestors(corpus(spark, folder).select("relative_path"))


@register("subtree", f"WITH {NODE_PATHS_SQL} SELECT id, path AS relative_path FROM node_paths WHERE path = 'ASIA' OR starts_with(path, 'ASIA/')")
def subtree(spark, folder):
    return H.subtree(_with_paths(spark, folder), "asia").select("id", "relative_path")


@register("relocated_subtrees", f"""WITH {NODE_PATHS_SQL},
moves AS (SELECT path AS root_path, 'EUROPE/moved_' || name AS new_path FROM node_paths
  WHERE depth = 2 OR path = 'AFRICA' OR (depth = 3 AND user_order % 2 = 1))
SELECT n.id, m.new_path || substr(n.path, length(m.root_path) + 1) AS relative_path,
  CASE WHEN n.path = m.root_path THEN 'r3' ELSE n.parent_id END AS parent_id, n.path AS original_path, 'trashed' AS status
FROM node_paths n JOIN moves m ON n.path = m.root_path OR starts_with(n.path, m.root_path || '/')
QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY length(m.root_path) DESC) = 1""")
def relocated_subtrees(spark, folder):
    # roots inside each other: a region, all nations, every other leaf
    tree = _with_paths(spark, folder)
    depth = F.size(F.split("relative_path", "/"))
    chosen = (depth == 2) | (F.col("relative_path") == "AFRICA") | ((depth == 3) & (F.col("user_order") % 2 == 1))
    moves = tree.where(chosen).select(
        F.col("relative_path").alias("root_path"),
        F.concat(F.lit("EUROPE/moved_"), "name").alias("new_path"),
        F.lit("r3").alias("new_parent_id"),
    )
    return H.relocate(tree, moves, trashed=True).select("id", "relative_path", "parent_id", "original_path", "status")


@register("applied_child_order", f"""WITH {NODE_PATHS_SQL},
listed AS (SELECT regexp_replace(path, '/[^/]*$', '') AS parent_path, lower(name) AS k,
  row_number() OVER (PARTITION BY parent_id ORDER BY name DESC) - 1 AS place FROM node_paths WHERE kind = 'folder' AND depth = 3),
children AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS parent_path FROM node_paths WHERE depth = 3)
SELECT c.id, row_number() OVER (PARTITION BY c.parent_path ORDER BY l.place IS NULL, l.place, c.user_order, c.path) - 1 AS user_order
FROM children c LEFT JOIN listed l ON c.parent_path = l.parent_path AND lower(c.name) = l.k
WHERE c.parent_path IN (SELECT parent_path FROM listed)""")
def applied_child_order(spark, folder):
    tree = _with_paths(spark, folder)
    suppliers = tree.where((F.col("kind") == "folder") & (F.size(F.split("relative_path", "/")) == 3))
    entries = suppliers.select(parent_path(F.col("relative_path")).alias("parent_path"), "name")
    order = with_row_number(entries, ["parent_path"], ["-name"], "position")
    return H.apply_child_order(order, tree).select("id", "user_order")


@register("tree_reference_audit", f"""WITH {NODES_SQL.strip()},
named AS (SELECT 's' || l_suppkey AS id FROM lineitem UNION ALL SELECT 'c' || (o_custkey + 100) FROM orders),
counts AS (SELECT id, count(*) AS n FROM named GROUP BY id)
SELECT c.id, c.n AS "references", CASE WHEN n.id IS NULL THEN 'missing' WHEN n.user_order < 50 THEN 'deleted' ELSE 'duplicated' END AS problem
FROM counts c LEFT JOIN nodes n USING (id) WHERE n.id IS NULL OR n.user_order < 50 OR c.n > 1""")
def tree_reference_audit(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"))
    orders = table(spark, folder, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") + 100).cast("string")).alias("id"))
    lists = lines.unionByName(orders).select(F.array("id").alias("children"))
    tree = nodes(spark, folder).withColumn("is_deleted", F.col("user_order") < 50)
    return H.tree_reference_audit(lists, tree)


@register("blocked_deletes", f"""WITH {NODE_PATHS_SQL},
deletes AS (SELECT path AS folder_path FROM node_paths WHERE kind = 'folder'),
ops AS (SELECT n.path FROM orders o JOIN node_paths n ON n.id = 'c' || o.o_custkey WHERE o_orderstatus = 'P')
SELECT folder_path, 'PENDING_CHILD_OPERATION' AS reason FROM deletes WHERE EXISTS (SELECT 1 FROM ops WHERE starts_with(path, folder_path || '/'))
UNION ALL SELECT folder_path, 'FOLDER_NOT_EMPTY' FROM deletes WHERE EXISTS (SELECT 1 FROM node_paths WHERE starts_with(path, folder_path || '/'))""")
def blocked_deletes(spark, folder):
    tree = _with_paths(spark, folder)
    folders = tree.where("kind = 'folder'")
    waiting = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")
    )
    ops = tree.join(waiting, "id", "left_semi")
    deletes = folders.select(F.col("relative_path").alias("folder_path"))
    return H.delete_blocked(deletes, folders, ops, tree.where("kind = 'text'"))


@register("applied_node_changes", f"""WITH {NODE_PATHS_SQL},
gone AS (SELECT path FROM node_paths WHERE id IN ('n1', 'n2')),
stay AS (SELECT id, parent_id, path FROM node_paths n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE n.path = g.path OR starts_with(n.path, g.path || '/'))),
ups AS (SELECT 'c' || c_custkey AS id, 'n' || CAST(floor(abs(c_acctbal) / 500) AS BIGINT) AS parent_id,
  'upserted/' || c_custkey // 4 AS path FROM customer WHERE c_acctbal < 0),
judged AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN 'duplicatePath' WHEN parent_id NOT IN (SELECT id FROM stay) THEN 'missingParent' END AS code FROM ups),
ok AS (SELECT * EXCLUDE (code) FROM judged WHERE code IS NULL)
SELECT *, NULL AS code FROM ok UNION ALL SELECT *, NULL FROM stay WHERE id NOT IN (SELECT id FROM ok)
UNION ALL SELECT id, NULL, NULL, code FROM judged WHERE code IS NOT NULL""")
def applied_node_changes(spark, folder):
    tree = _with_paths(spark, folder).withColumn("project_id", F.lit(1)).select(
        "id", "project_id", "kind", "parent_id", "relative_path"
    )
    key = F.col("c_custkey").cast("string")
    upserts = table(spark, folder, "customer").where("c_acctbal < 0").select(
        F.concat(F.lit("c"), key).alias("id"),
        F.lit(1).alias("project_id"),
        F.lit("text").alias("kind"),
        F.concat(F.lit("n"), F.floor(F.abs("c_acctbal") / 500).cast("string")).alias("parent_id"),
        F.concat(F.lit("upserted/"), F.expr("c_custkey div 4").cast("string")).alias("relative_path"),
    )
    removed = tree.where(F.col("id").isin("n1", "n2")).select("id")
    after, rejected = H.apply_node_changes(tree, upserts, removed)
    return after.select("id", "parent_id", F.col("relative_path").alias("path")).unionByName(rejected, allowMissingColumns=True)


@register("tree_order_document", f"""WITH {NODE_PATHS_SQL}
SELECT CASE WHEN depth = 2 AND path LIKE 'ASIA/%' THEN '<root>' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent_key,
  row_number() OVER (PARTITION BY parent_id ORDER BY user_order, path) - 1 AS position, name
FROM node_paths WHERE depth > 1 AND path <> 'ASIA/CHINA' AND NOT starts_with(path, 'ASIA/CHINA/')""")
def tree_order_document(spark, folder):
    from quire.sources.sinks import tree_order_entries

    # one region as the top container, one of its nations as the trash
    return tree_order_entries(_with_paths(spark, folder), "ASIA", "ASIA/CHINA")
