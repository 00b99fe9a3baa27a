"""Join and set shapes shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.names import ancestor_paths


def orphans(nodes: DataFrame) -> DataFrame:
    """Live nodes whose parent is missing or deleted."""
    live = nodes.where(~F.col("is_deleted"))
    parents = live.select(F.col("id").alias("_id"), F.col("project_id").alias("_project"))
    child = live.where(F.col("parent_id").isNotNull())
    same = (F.col("parent_id") == F.col("_id")) & (F.col("project_id") == F.col("_project"))
    return child.join(parents, same, "left_anti")


def latest_event(ops: DataFrame, latest: DataFrame) -> DataFrame:
    """Operations with their newest event; those without one keep nulls."""
    return ops.join(latest, "operation_id", "left")


def name_clashes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests whose name is held by another node under the same parent.

    One row a request, with one other holder: the smallest id, or the largest
    where the request itself is the smallest. Holders are aggregated per name
    first, so that a name held many times makes no pairs. Root nodes have a
    null parent, which counts as equal to another null.
    """
    held = nodes.groupBy(F.col("parent_id").alias("_parent"), F.col("name").alias("_name")).agg(
        F.min("id").alias("_low"), F.max("id").alias("_high")
    )
    # name is part of the key, so a parent with very many children still spreads
    same = (F.col("name") == F.col("_name")) & F.col("parent_id").eqNullSafe(F.col("_parent"))
    other = F.when(F.col("_low") != F.col("id"), F.col("_low")).when(F.col("_high") != F.col("id"), F.col("_high"))
    found = requests.join(held, same).withColumn("holder_id", other)
    return found.where("holder_id IS NOT NULL").drop("_parent", "_name", "_low", "_high")


def range_lookup(points: DataFrame, point: str, ranges: DataFrame, bits: int = 8) -> DataFrame:
    """Points with the range that holds them, as an equi-join on buckets.

    A range is repeated once per bucket of ``2**bits`` points it touches, so
    each point meets the few ranges of its own bucket and no others.
    """
    cut = ranges.withColumn(
        "_bucket",
        F.explode(F.sequence(F.shiftright("range_start", bits), F.shiftright("range_end", bits))),
    )
    keyed = points.withColumn("_bucket", F.shiftright(point, bits))
    inside = (F.col(point) >= F.col("range_start")) & (F.col(point) <= F.col("range_end"))
    return keyed.join(cut, "_bucket").where(inside).drop("_bucket")


def under_folder(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents below each folder path, by exploding their ancestors."""
    spread = documents.withColumn("folder_path", F.explode(ancestor_paths(F.col("relative_path"))))
    return spread.join(folders.select("folder_path"), "folder_path")


def capability_code(declared: Column, required: Column, allowed: Column) -> Column:
    """Null if required ⊆ declared ⊆ allowed without duplicates."""
    repeated = F.size(F.array_distinct(declared)) != F.size(declared)
    return (
        F.when(declared.isNull() | repeated, "CAPABILITY_MISMATCH")
        .when(F.size(F.array_except(required, declared)) > 0, "CAPABILITY_MISMATCH")
        .when(F.size(F.array_except(declared, allowed)) > 0, "CAPABILITY_MISMATCH")
    )


def reference_counts(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    """How often each live node is named by the child lists."""
    named = orders.select(F.explode("children").alias("id")).groupBy("id").agg(
        F.count("*").alias("references")
    )
    return nodes.join(named, "id", "left").withColumn(
        "references", F.coalesce(F.col("references"), F.lit(0))
    )


def successors(ops: DataFrame) -> DataFrame:
    """Each superseding operation beside the one it replaces."""
    original = ops.select(
        F.col("operation_id").alias("supersedes_operation_id"),
        F.col("status").alias("original_status"),
        F.col("base_revision").alias("original_base"),
    )
    return ops.where(F.col("supersedes_operation_id").isNotNull()).join(
        original, "supersedes_operation_id", "left"
    )


def compare_by_id(remote: DataFrame, local: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Remote rows with the state of their local twin; local-only rows stay out."""
    renamed = local.select(key, *[F.col(c).alias(f"local_{c}") for c in columns], F.lit(True).alias("_here"))
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(c).eqNullSafe(F.col(f"local_{c}"))
    return (
        remote.join(renamed, key, "left")
        .withColumn(
            "comparison",
            F.when(F.col("_here").isNull(), "missing").when(equal, "same").otherwise("different"),
        )
        .drop("_here")
    )


def match_disk_entries(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Disk entries with the node they continue.

    First by path and kind. What is left over pairs by content hash, where
    one remaining text and one remaining node carry the hash under the same
    parent; counting both sides makes the result free of row order.
    """
    paths = nodes.select("node_id", "path_key", "kind")
    exact = entries.join(paths, ["path_key", "kind"], "left")
    found = exact.where(F.col("node_id").isNotNull()).withColumn("matched_by", F.lit("path"))
    left_entries = exact.where(F.col("node_id").isNull()).drop("node_id")
    left_nodes = nodes.join(found.select("node_id"), "node_id", "left_anti").where(
        (F.col("kind") == "text") & F.col("content_hash").isNotNull()
    )
    # a hash held by very many rows folds to one row before it meets the other side
    key = ["parent_id", "content_hash"]
    lone_entry = (
        left_entries.where(F.col("kind") == "text")
        .groupBy(*key)
        .agg(F.count("*").alias("n"), F.min("path_key").alias("path_key"))
        .where("n = 1")
        .drop("n")
    )
    lone_node = (
        left_nodes.groupBy(*key)
        .agg(F.count("*").alias("n"), F.min("node_id").alias("node_id"))
        .where("n = 1")
        .drop("n")
    )
    moved = lone_entry.join(lone_node, key).select("path_key", "node_id")
    rest = left_entries.join(moved, "path_key", "left").withColumn(
        "matched_by", F.when(F.col("node_id").isNotNull(), "hash").otherwise("new")
    )
    return found.unionByName(rest)



def order_diff(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Names that vanished or were added under each parent, by collision key."""
    keys = ["parent_id", "name_key"]
    gone = local.join(remote.select(*keys), keys, "left_anti").withColumn("change", F.lit("vanished"))
    added = remote.join(local.select(*keys), keys, "left_anti").withColumn("change", F.lit("added"))
    return gone.select(*keys, "change").unionByName(added.select(*keys, "change"))


def staged_union(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the stage they apply in: purge, tombstone, live, order."""
    stage = (
        F.when(F.col("kind") == "trash_purge", 0)
        .when(F.col("kind") == "tree_order", 3)
        .when(F.col("is_deleted"), 1)
        .otherwise(2)
    )
    return snapshots.withColumn("stage", stage.cast("long")).orderBy("stage", "document_id")


def project_state(projects: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Active, trashed or purged, for every known project id."""
    gone = tombstones.select("project_id", F.lit(True).alias("_purged"))
    joined = projects.withColumn("_here", F.lit(True)).join(gone, "project_id", "full_outer")
    state = (
        F.when(F.col("_here") & F.col("trashed_at").isNull(), "active")
        .when(F.col("_here"), "trashed")
        .otherwise("purged")
    )
    return joined.withColumn("state", state).drop("_here", "_purged")


# Roles by rank.
ROLE_RANK = {"viewer": 1, "editor": 2, "owner": 3}


def authorized(requests: DataFrame, projects: DataFrame, members: DataFrame, minimum: str) -> DataFrame:
    """Requests by the project's owner or by a member of sufficient rank."""
    rank = F.lit(0)
    for role, value in ROLE_RANK.items():
        rank = F.when(F.col("role") == role, value).otherwise(rank)
    open_projects = projects.where(F.col("trashed_at").isNull()).select("project_id", "owner_id")
    best = (
        members.withColumn("_rank", rank)
        .groupBy("project_id", "user_id")
        .agg(F.max("_rank").alias("_rank"))
    )
    joined = requests.join(open_projects, "project_id").join(best, ["project_id", "user_id"], "left")
    allowed = (F.col("owner_id") == F.col("user_id")) | (
        F.coalesce(F.col("_rank"), F.lit(0)) >= ROLE_RANK[minimum]
    )
    return joined.where(allowed).drop("_rank", "owner_id")


# Which project mode takes writes of which protocol version.
WRITE_MATRIX = [
    ("LEGACY", 1, True, None),
    ("LEGACY", 2, True, None),
    ("LEGACY", 3, True, None),
    ("MIGRATING", 3, True, None),
    ("ID_BASED", 3, True, None),
    ("MIGRATING", 1, False, "PROTOCOL_TOO_OLD"),
    ("MIGRATING", 2, False, "PROTOCOL_TOO_OLD"),
    ("ID_BASED", 1, False, "PROTOCOL_TOO_OLD"),
    ("ID_BASED", 2, False, "PROTOCOL_TOO_OLD"),
]


def write_allowed(requests: DataFrame) -> DataFrame:
    """Whether (mode, protocol) may write, and the code if not."""
    matrix = requests.sparkSession.createDataFrame(
        WRITE_MATRIX, "mode string, protocol_version int, allowed boolean, code string"
    )
    joined = requests.join(F.broadcast(matrix), ["mode", "protocol_version"], "left")
    return joined.withColumns(
        {
            "code": F.when(F.col("allowed").isNull(), "INVALID_ARGUMENT").otherwise(F.col("code")),
            "allowed": F.coalesce("allowed", F.lit(False)),
        }
    )


def placement_violations(nodes: DataFrame, top: str) -> DataFrame:
    """Texts lying directly under the top container."""
    tops = nodes.where((F.col("name") == top) & F.col("parent_id").isNull()).select(
        F.col("id").alias("parent_id")
    )
    return nodes.where(F.col("kind") == "text").join(tops, "parent_id", "left_semi")
