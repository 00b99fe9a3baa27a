"""Folder trees: paths, cycles, subtrees, moves, reconciliation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.digests import uuid5
from quire.functions.names import (
    CUSTOM_ORDER_OFFSET,
    MANUSCRIPT,
    TOP,
    TRASH,
    ancestor_paths,
    parent_path,
    path_depth,
    stored_name,
)
from quire.functions.unicode import collision_key, nfc
from quire.operators.ordered import with_row_number, with_running
from quire.operators.relational import order_diff
from quire.session import durable


def folder_paths(folders: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Path, depth and outcome of every folder, by its chain of parents.

    ``folders`` has ``id, parent_id, name`` and optionally ``is_deleted``.
    ``outcome`` is ``resolved``, ``parentCycle`` or ``unknownParent``; a
    deleted folder on the chain leaves it ``unknownParent``. Parents missing
    from ``folders`` may be found by path in ``local`` (``id, path``).

    Chains are followed by ids alone; names join only where the chain ends,
    so that no path is longer than the one it becomes part of.
    """
    judged = durable(folder_outcomes(folders, local))
    resolved = judged.where("outcome = 'resolved'")
    top = F.lit(None).cast(folders.schema["parent_id"].dataType)
    parts = resolved.select("id", "depth").join(folders.select("id", "name", "parent_id"), "id")
    parts = parts.select("id", F.col("name").alias("path"), F.col("parent_id").alias("up"))
    if local is not None:
        parts = parts.unionByName(_local_roots(folders, local).select("id", "path", top.alias("up")))
    parts = durable(parts)
    # in round k every folder gets the path from its ancestor 2**k levels up
    for _ in range(_doublings(resolved)):
        above = parts.select(F.col("id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        joined = parts.join(above, "up", "left")
        parts = durable(joined.select("id", F.concat_ws("/", "_path", "path").alias("path"), F.col("_up").alias("up")))
    return judged.join(parts.select("id", "path"), "id", "left").select("id", "path", "depth", "outcome")


def _doublings(resolved: DataFrame) -> int:
    """Rounds of doubling that reach the end of the longest chain."""
    deepest = resolved.agg(F.max("links")).first()[0] or 1
    return (deepest - 1).bit_length()


def _local_roots(folders: DataFrame, local: DataFrame) -> DataFrame:
    return local.join(folders.select("id"), "id", "left_anti").select("id", "path", path_depth(F.col("path")).alias("depth"))


def folder_outcomes(folders: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Depth and outcome of every folder, as :func:`folder_paths`, without paths.

    ``links`` counts the folders of the chain. Each round lets every folder
    jump as far as its parent already got, so a chain of n folders takes
    log2(n) joins of ids. Finished folders leave the join.
    """
    deleted = F.col("is_deleted") if "is_deleted" in folders.columns else F.lit(False)
    state = folders.select(
        "id",
        F.col("parent_id").alias("up"),
        deleted.alias("gone"),
        F.lit(1).cast("long").alias("depth"),
        F.lit(1).cast("long").alias("links"),
        F.when(F.col("parent_id").isNull(), "resolved").alias("outcome"),
        F.lit(True).alias("own"),
    )
    if local is not None:
        top = F.lit(None).cast(folders.schema["parent_id"].dataType)
        state = state.unionByName(_local_roots(folders, local).select(
            "id", top.alias("up"), F.lit(False).alias("gone"), "depth", F.lit(1).cast("long").alias("links"),
            F.lit("resolved").alias("outcome"), F.lit(False).alias("own"),
        ))
    state = durable(state)
    waiting = None
    while True:
        pending = state.where("outcome IS NULL")
        # a chain that ends has a folder finishing in every round until its last,
        # so a round that finishes none has only cycles left
        before, waiting = waiting, pending.count()
        if waiting in (0, before):
            break
        above = state.select(
            F.col("id").alias("up"),
            F.lit(True).alias("_found"),
            *[F.col(c).alias(f"_{c}") for c in ("gone", "depth", "links", "outcome")],
            F.col("up").alias("_up"),
        )
        joined = pending.join(above, "up", "left")
        moved = joined.select(
            "id",
            F.col("_up").alias("up"),
            (F.col("gone") | F.coalesce("_gone", F.lit(False))).alias("gone"),
            *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("depth", "links")],
            F.when(F.col("_found").isNull(), "unknownParent").otherwise(F.col("_outcome")).alias("outcome"),
            "own",
        )
        state = durable(state.where("outcome IS NOT NULL").unionByName(moved))
    outcome = (
        F.when(F.col("outcome").isNull(), "parentCycle")
        .when(F.col("gone"), "unknownParent")
        .otherwise(F.col("outcome"))
    )
    judged = state.where("own").select("id", outcome.alias("outcome"), "depth", "links")
    resolved = F.col("outcome") == "resolved"
    return judged.select("id", *[F.when(resolved, F.col(c)).alias(c) for c in ("depth", "links")], "outcome")


def cycles(folders: DataFrame) -> DataFrame:
    """Folders without a path, and whether a cycle or a missing parent is why."""
    return folder_outcomes(folders).where("outcome <> 'resolved'").select("id", "outcome")


def moves_into_cycle(moves: DataFrame, folders: DataFrame) -> DataFrame:
    """Moves that put a folder below itself."""
    chains = folder_paths(folders.withColumn("name", F.col("id").cast("string"))).select(
        F.col("id").alias("new_parent_id"), F.col("path").alias("_chain")
    )
    inside = F.array_contains(F.split("_chain", "/", -1), F.col("id").cast("string"))
    return moves.join(chains, "new_parent_id").where(inside).drop("_chain")


def ancestors(paths: DataFrame) -> DataFrame:
    """Every folder above every path, once."""
    return paths.select(F.explode(ancestor_paths(F.col("relative_path"))).alias("folder_path")).distinct()


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """The node at ``root`` and all below it, by collision key."""
    key = collision_key(F.col("relative_path"))
    wanted = collision_key(F.lit(root))
    return nodes.where((key == wanted) | key.startswith(F.concat(wanted, F.lit("/"))))


def subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with each root above them (or equal), for many roots at once.

    Further columns of ``roots`` come along.
    """
    path = F.col("relative_path")
    chain = F.array_append(ancestor_paths(path), path)
    spread = nodes.withColumn("root_path", F.explode(chain))
    return spread.join(roots, "root_path")


def relocate(nodes: DataFrame, moves: DataFrame, trashed: bool | None = None) -> DataFrame:
    """Rewrite the paths of whole subtrees.

    ``moves`` has ``root_path, new_path`` and optionally ``new_parent_id`` and
    ``new_order``, which the root of the subtree takes. Where roots lie inside
    each other, a node goes with the deepest one above it. With ``trashed``
    the nodes are marked (and keep their original path) or unmarked.
    """
    extra = [c for c in ("new_parent_id", "new_order") if c in moves.columns]
    move = ["root_path", "new_path", *extra]
    above = subtrees(nodes.select("relative_path").distinct(), moves.select(*move))
    deepest = above.groupBy("relative_path").agg(F.max_by(F.struct(*move), F.length("root_path")).alias("_move"))
    joined = nodes.join(deepest, "relative_path").select(*nodes.columns, "_move.*")
    old = F.col("relative_path")
    tail = F.expr("substring(relative_path, length(root_path) + 1)")
    is_root = old == F.col("root_path")
    out = joined.withColumn("_new", F.concat("new_path", tail))
    if "new_parent_id" in extra:
        out = out.withColumn("parent_id", F.when(is_root, F.col("new_parent_id")).otherwise(F.col("parent_id")))
    if "new_order" in extra:
        out = out.withColumn("user_order", F.when(is_root, F.col("new_order")).otherwise(F.col("user_order")))
    if trashed is not None:
        out = out.withColumns(
            {
                "status": F.lit("trashed" if trashed else "active"),
                "original_path": old if trashed else F.lit(None).cast("string"),
            }
        )
    return out.withColumn("relative_path", F.col("_new")).drop("_new", "new_path", "root_path", *extra)


def plan_folders(remote: DataFrame, local: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """What to do with each remote folder: move, create, delete or conflict.

    ``remote``: ``folder_id, parent_folder_id, name, is_deleted``. ``local``:
    ``document_id, kind, relative_path``. A folder the server does not mention
    is left alone; only a tombstone deletes.
    """
    here = local.select(
        F.col("document_id").alias("folder_id"),
        F.col("relative_path").alias("local_path"),
        nfc(F.col("relative_path")).alias("_local_key"),
    )
    as_parents = local.where("kind = 'folder'").select(
        F.col("document_id").alias("id"), F.col("relative_path").alias("path")
    )
    tree = remote.select(
        F.col("folder_id").alias("id"), F.col("parent_folder_id").alias("parent_id"), "name", "is_deleted"
    )
    resolved = folder_paths(tree, as_parents).select(F.col("id").alias("folder_id"), "path", "outcome")
    wanted = (
        remote.join(resolved, "folder_id")
        .withColumn("_key", nfc(F.col("path")))
        .join(here, "folder_id", "left")
    )
    if blocked is not None:
        wanted = wanted.join(
            blocked.select("folder_id", F.lit(True).alias("_blocked")), "folder_id", "left"
        )
    else:
        wanted = wanted.withColumn("_blocked", F.lit(None).cast("boolean"))
    wanted = durable(wanted)

    live = wanted.where("outcome = 'resolved'")
    crowded = live.groupBy("_key").agg((F.count("*") > 1).alias("_crowded"))
    vacated = (
        live.where("_local_key IS NOT NULL AND _local_key <> _key")
        .select(F.col("_local_key").alias("_key"))
        .distinct()
    )
    # one holder is enough to occupy a place; keep two to tell "another" from "itself"
    holders = (
        here.groupBy(F.col("_local_key").alias("_key"))
        .agg(F.min("folder_id").alias("_low"), F.max("folder_id").alias("_high"))
        .join(vacated, "_key", "left_anti")
    )
    judged = wanted.join(crowded, "_key", "left").join(holders, "_key", "left")
    taken = F.col("_low").isNotNull() & (
        (F.col("_low") != F.col("folder_id")) | (F.col("_high") != F.col("folder_id"))
    )
    present = F.col("local_path").isNotNull()
    action = (
        F.when(F.coalesce("_blocked", F.lit(False)), "conflict")
        .when(F.col("is_deleted"), F.when(present, "delete").otherwise("none"))
        .when(F.col("outcome") != "resolved", "conflict")
        .when(present & (F.col("_local_key") == F.col("_key")), "none")
        .when(F.col("_crowded") | taken, "conflict")
        .when(present, "move")
        .otherwise("create")
    )
    reason = (
        F.when(F.coalesce("_blocked", F.lit(False)), "pendingLocalOperation")
        .when(~F.col("is_deleted") & (F.col("outcome") != "resolved"), F.col("outcome"))
        .otherwise("destinationOccupied")
    )
    shown = F.when(
        (F.col("action").isin("move", "create"))
        | ((F.col("action") == "conflict") & (F.col("reason") == "destinationOccupied")),
        F.col("path"),
    ).otherwise(F.col("local_path"))
    return (
        judged.withColumn("action", action)
        .where("action <> 'none'")
        .withColumn("reason", F.when(F.col("action") == "conflict", reason))
        .select(
            "folder_id",
            "action",
            "reason",
            F.when(F.col("action") == "move", F.col("local_path")).alias("from_path"),
            shown.alias("path"),
        )
    )


def derive_folder_ids(nodes: DataFrame, project_id: str, prefix: str, server: DataFrame | None = None) -> DataFrame:
    """Stable folder ids from project and path; documents keep theirs.

    Returns changed rows: ``old_id, new_id, old_parent_id, new_parent_id,
    relative_path``, parents first. A path the server knows takes the server's
    id. If two folders would get one id, nothing is changed.
    """
    canonical = nfc(F.array_join(F.filter(F.split("relative_path", "/", -1), lambda c: c != ""), "/"))
    folders = nodes.where("kind = 'folder'").select("document_id", canonical.alias("_path"))
    derived = uuid5(project_id, F.concat(F.lit(prefix), F.col("_path")))
    if server is not None:
        known = server.groupBy(nfc(F.col("relative_path")).alias("_path")).agg(
            F.min("folder_id").alias("_server")
        )
        named = folders.join(known, "_path", "left").withColumn("new_id", F.coalesce("_server", derived))
    else:
        named = folders.withColumn("new_id", derived)
    changed = named.where(F.col("new_id") != F.col("document_id")).select("document_id", "new_id")
    changed = durable(changed)
    twice = changed.groupBy("new_id").count().where("count > 1").limit(1)
    if not twice.isEmpty():
        changed = changed.limit(0)
    parents = changed.select(F.col("document_id").alias("parent_id"), F.col("new_id").alias("_new_parent"))
    return (
        nodes.join(changed, "document_id", "left")
        .join(parents, "parent_id", "left")
        .where(F.col("new_id").isNotNull() | F.col("_new_parent").isNotNull())
        .select(
            F.col("document_id").alias("old_id"),
            F.coalesce("new_id", "document_id").alias("new_id"),
            F.col("parent_id").alias("old_parent_id"),
            F.coalesce("_new_parent", "parent_id").alias("new_parent_id"),
            "relative_path",
            path_depth(F.col("relative_path")).alias("_depth"),
        )
        .orderBy("_depth", "relative_path")
        .drop("_depth")
    )


def infer_renames(remote: DataFrame, nodes: DataFrame, remote_documents: DataFrame) -> DataFrame:
    """Empty folders that vanished while one new name came up beside them.

    ``remote``: ``parent_path, name``; ``nodes``: live ``id, kind,
    relative_path``. Only one vanished folder and one added name under a
    parent count as a rename; more would be a guess.
    """
    lists = remote.select(
        collision_key(F.col("parent_path")).alias("parent_id"),
        collision_key(F.col("name")).alias("name_key"),
        "name",
    )
    path = F.col("relative_path")
    local = nodes.where(parent_path(path).isNotNull()).select(
        "id",
        "kind",
        "relative_path",
        collision_key(parent_path(path)).alias("parent_id"),
        collision_key(stored_name(path)).alias("name_key"),
    )
    listed = local.join(lists.select("parent_id").distinct(), "parent_id", "left_semi")
    diff = order_diff(lists, listed)
    filled = local.select("parent_id").distinct()
    vanished = (
        diff.where("change = 'vanished'")
        .join(listed.where("kind = 'folder'"), ["parent_id", "name_key"])
        .withColumn("_key", F.concat_ws("/", "parent_id", "name_key"))
        .join(filled.withColumnRenamed("parent_id", "_key"), "_key", "left_anti")
    )
    on_server = remote_documents.select(collision_key(F.col("relative_path")).alias("_key")).distinct()
    added = (
        diff.where("change = 'added'")
        .join(lists, ["parent_id", "name_key"])
        .withColumn("_key", F.concat_ws("/", "parent_id", "name_key"))
        .join(on_server, "_key", "left_anti")
    )
    one_gone = (
        vanished.groupBy("parent_id")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("relative_path").alias("from_path"))
        .where("n = 1")
    )
    one_new = added.groupBy("parent_id").agg(F.count("*").alias("m"), F.min("name").alias("name")).where("m = 1")
    return one_gone.join(one_new, "parent_id").select("id", "from_path", F.col("name").alias("new_name"))


def apply_child_order(order: DataFrame, nodes: DataFrame) -> DataFrame:
    """New ``user_order`` of the children of every listed parent.

    ``order``: ``parent_path, children array<string>``, or ``parent_path,
    position, name`` where lists are long; ``nodes``: live ``id,
    relative_path, user_order``. Listed names come first, the others by
    their order and path. Below the top container numbering starts at the
    custom offset and leaves out manuscript and trash.
    """
    if "children" in order.columns:
        order = order.select("parent_path", F.posexplode("children").alias("position", "name"))
    listed = order.select("parent_path", F.col("position").alias("_place"), collision_key(F.col("name")).alias("_key"))
    listed = listed.groupBy("parent_path", "_key").agg(F.min("_place").alias("_place"))
    path = F.col("relative_path")
    children = nodes.withColumn("parent_path", parent_path(path)).join(
        order.select("parent_path").distinct(), "parent_path", "left_semi"
    )
    placed = children.withColumn("_key", collision_key(stored_name(path))).join(
        listed, ["parent_path", "_key"], "left"
    )
    fixed = path.isin(f"{TOP}/{MANUSCRIPT}", f"{TOP}/{TRASH}")
    placed = placed.where(~((F.col("parent_path") == TOP) & fixed)).withColumn(
        "_unlisted", F.col("_place").isNull()
    )
    numbered = with_row_number(
        placed, ["parent_path"], ["_unlisted", "_place", "user_order", "relative_path"], "_n"
    )
    offset = F.when(F.col("parent_path") == TOP, CUSTOM_ORDER_OFFSET).otherwise(0)
    return numbered.select(
        "id", "relative_path", F.col("user_order").alias("old_order"), (offset + F.col("_n") - 1).alias("user_order")
    )


def tree_reference_audit(orders: DataFrame, nodes: DataFrame) -> DataFrame:
    """References that are missing, deleted or repeated."""
    named = orders.select(F.explode("children").alias("id")).groupBy("id").agg(
        F.count("*").alias("references")
    )
    known = nodes.select("id", "is_deleted")
    problem = (
        F.when(F.col("is_deleted").isNull(), "missing")
        .when(F.col("is_deleted"), "deleted")
        .when(F.col("references") > 1, "duplicated")
    )
    return named.join(known, "id", "left").withColumn("problem", problem).where("problem IS NOT NULL").select(
        "id", "references", "problem"
    )


def delete_blocked(deletes: DataFrame, folders: DataFrame, ops: DataFrame, documents: DataFrame) -> DataFrame:
    """Folder deletes that must wait, with the reason.

    ``deletes``: ``folder_path``; ``folders``/``documents``: live rows with
    ``relative_path``; ``ops``: unfinished operations with ``relative_path``.
    """

    def below(rows: DataFrame, code: str) -> DataFrame:
        hit = rows.select(F.explode(ancestor_paths(F.col("relative_path"))).alias("folder_path")).distinct()
        return deletes.join(hit, "folder_path", "left_semi").select("folder_path", F.lit(code).alias("reason"))

    waiting = below(ops, "PENDING_CHILD_OPERATION")
    filled = below(folders.select("relative_path").unionByName(documents.select("relative_path")), "FOLDER_NOT_EMPTY")
    return waiting.unionByName(filled)


# Older names of root folders and what they are called now.
ROOT_ALIASES = [
    ("📚 원고", "원고"),
    ("👤 캐릭터", "캐릭터"),
    ("📖 설정집", "설정집"),
    ("📝 메모장", "메모장"),
    ("🗺️ 메인 스토리 틀", "스토리 플롯"),
    ("🌊 흐름 정리", "흐름정리"),
    ("🔍 복선", "복선"),
    ("📌 장소", "장소"),
    ("🗑️ 휴지통", "휴지통"),
    ("메인 스토리 틀", "스토리 플롯"),
    ("플롯", "스토리 플롯"),
]


def canonical_root_name(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(part) for pair in ROOT_ALIASES for part in pair])
    return F.coalesce(F.element_at(pairs, name), name)


def canonical_order_keys(order: DataFrame, root_key: str = "<root>") -> DataFrame:
    """Child lists under current root names; ``valid`` is false on a clash.

    ``order``: ``project_id, parent_key, children``.
    """
    key = F.col("parent_key")
    parts = F.split(key, "/", -1)
    renamed = F.array_join(
        F.transform(parts, lambda c, i: F.when(i == 1, canonical_root_name(c)).otherwise(c)), "/"
    )
    deep = (F.size(parts) >= 2) & (F.get(parts, F.lit(0)) == TOP)
    canonical = F.when(key == root_key, key).when(deep, renamed).otherwise(key)
    names = F.when(key == root_key, F.transform("children", canonical_root_name)).otherwise(F.col("children"))
    mapped = order.select("project_id", canonical.alias("parent_key"), names.alias("children"))
    clashes = mapped.groupBy("project_id", "parent_key").agg(F.count("*").alias("n"))
    bad = clashes.groupBy("project_id").agg((F.max("n") == 1).alias("valid"))
    return mapped.join(bad, "project_id")


def safe_names(requests: DataFrame, existing: DataFrame, separator: str = " ") -> DataFrame:
    """A free name for each request, numbered before its extension if taken.

    ``requests``: ``request_id, parent_id, name``; ``existing``: ``parent_id,
    name``. Requests are served in id order; numbers run from 2 without
    an upper bound.
    """
    name = F.col("name")
    extension = F.when(F.lower(name).endswith(".txt"), F.right(name, F.lit(4))).otherwise("")
    base = F.expr("left(name, length(name) - length(_extension))")
    asked = (
        requests.withColumn("_extension", extension)
        .withColumn("_base", base)
        .withColumn("_key", collision_key(F.col("name")))
    )
    asked = with_row_number(asked, ["parent_id", "_key"], ["request_id"], "_turn")
    held = existing.select("parent_id", collision_key(name).alias("_key")).distinct()
    # a name asked for and free goes to its first asker and counts as held for the rest
    firsts = asked.where("_turn = 1").select("parent_id", "_key")
    used = held.unionByName(firsts).distinct()
    mark = held.withColumn("_held", F.lit(True))
    asked = asked.join(mark, ["parent_id", "_key"], "left")
    pattern = f"^(.*){separator}([2-9]|[1-9][0-9]{{1,17}})(\\.txt)?$"
    numbers = used.where(F.col("_key").rlike(pattern)).select(
        "parent_id",
        F.concat(F.regexp_extract("_key", pattern, 1), F.regexp_extract("_key", pattern, 3)).alias("_key"),
        F.regexp_extract("_key", pattern, 2).cast("long").alias("_n"),
    )
    # before a number in use there are n - 2 less the numbers in use below it free ones;
    # the i-th free number is 2 + i and the numbers in use that have at most i free before them
    numbers = with_row_number(numbers.distinct(), ["parent_id", "_key"], ["_n"], "_rank")
    numbers = numbers.select("parent_id", "_key", (F.col("_n") - 1 - F.col("_rank")).alias("_free"), F.lit(1).alias("_used"), F.lit(0).alias("_asked"))
    turn = F.col("_turn") - F.when(F.col("_held").isNull(), 2).otherwise(1)
    both = asked.withColumns({"_free": turn.cast("long"), "_used": F.lit(0), "_asked": F.lit(1)}).unionByName(numbers, allowMissingColumns=True)
    both = with_running(both, ["parent_id", "_key"], ["_free", "_asked", "request_id"], {"_passed": ("sum", "_used")})
    joined = both.where("_used = 0")
    untouched = F.col("_held").isNull() & (F.col("_turn") == 1)
    number = F.col("_free") + 2 + F.col("_passed")
    safe = F.when(untouched, name).otherwise(
        F.concat("_base", F.lit(separator), number.cast("string"), "_extension")
    )
    return joined.select("request_id", "parent_id", "name", safe.alias("safe_name"))


def restore_plan(trashed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where each trashed root goes back to.

    ``trashed``: ``id, kind, original_path, original_parent_id,
    original_order``; ``nodes``: live ``id, kind, parent_id, relative_path,
    user_order``. A folder whose parent is gone goes to the top container; a
    text may not. Outside the manuscript a clashing name gets ``_n``.
    """
    live_folders = nodes.where(
        (F.col("kind") == "folder") & ~F.array_contains(F.split("relative_path", "/"), TRASH)
    )
    parents = live_folders.select(
        F.col("id").alias("original_parent_id"), F.col("relative_path").alias("_parent_path")
    )
    top = live_folders.where(F.col("relative_path") == TOP).agg(F.min("id"))
    sizes = nodes.groupBy(F.col("parent_id").alias("_target")).agg(F.count("*").alias("_siblings"))
    found = trashed.join(parents, "original_parent_id", "left")
    target = F.when(F.col("_parent_path").isNotNull(), F.col("original_parent_id")).otherwise(top.scalar())
    found = found.withColumns(
        {"_target": target, "_folder": F.coalesce("_parent_path", F.lit(TOP)), "_stored": stored_name(F.col("original_path"))}
    ).join(sizes, "_target", "left")
    names = nodes.where("parent_id IS NOT NULL").select("parent_id", stored_name(F.col("relative_path")).alias("name"))
    asked = found.select(F.col("id").alias("request_id"), F.col("_target").alias("parent_id"), F.col("_stored").alias("name"))
    free = safe_names(asked, names, "_").select(F.col("request_id").alias("id"), "safe_name")
    in_manuscript = F.col("original_path").startswith(f"{TOP}/{MANUSCRIPT}/")
    final = F.when(in_manuscript, F.col("_stored")).otherwise(F.col("safe_name"))
    problem = (
        F.when(F.col("_target").isNull(), "missingParent")
        .when((F.col("_folder") == TOP) & (F.col("kind") == "text"), "textCannotRestoreToTop")
        .when(in_manuscript & F.col("_clash"), "duplicateNormalizedName")
    )
    held = names.select(F.col("parent_id").alias("_target"), collision_key(F.col("name")).alias("_key")).distinct()
    return (
        found.join(free, "id")
        .withColumn("_key", collision_key(F.col("_stored")))
        .join(held.withColumn("_clash", F.lit(True)), ["_target", "_key"], "left")
        .withColumn("_clash", F.coalesce("_clash", F.lit(False)))
        .select(
            "id",
            F.col("_target").alias("parent_id"),
            F.concat_ws("/", "_folder", final).alias("new_path"),
            F.least(F.greatest("original_order", F.lit(0)), F.coalesce("_siblings", F.lit(0))).alias("new_order"),
            problem.alias("problem"),
        )
    )


def trash_plan(roots: DataFrame, nodes: DataFrame, trash_id: str, trash_path: str) -> DataFrame:
    """New place in the trash for each root: ``root_path, new_path,
    new_parent_id, new_order``, ready for :func:`relocate`."""
    inside = nodes.where(F.col("parent_id") == trash_id)
    asked = roots.select(
        F.col("id").alias("request_id"), F.lit(trash_id).alias("parent_id"), stored_name(F.col("relative_path")).alias("name")
    )
    names = inside.select("parent_id", stored_name(F.col("relative_path")).alias("name"))
    free = safe_names(asked, names, "_").select(F.col("request_id").alias("id"), "safe_name")
    last = inside.agg(F.coalesce(F.max("user_order"), F.lit(-1)))
    placed = roots.select("id", F.col("relative_path").alias("root_path")).join(free, "id")
    placed = with_row_number(placed.withColumn("_all", F.lit(1)), ["_all"], ["id"], "_n")
    return placed.select(
        "id",
        "root_path",
        F.concat(F.lit(f"{trash_path}/"), "safe_name").alias("new_path"),
        F.lit(trash_id).alias("new_parent_id"),
        (last.scalar() + F.col("_n")).alias("new_order"),
    )


def purge_candidates(nodes: DataFrame, trash_id: str) -> DataFrame:
    """Children of the trash with everything below them."""
    roots = nodes.where(F.col("parent_id") == trash_id).select(F.col("relative_path").alias("root_path"))
    return subtrees(nodes, roots)


def apply_node_changes(nodes: DataFrame, upserts: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next node table, and the upserts it rejects with a code.

    ``removed`` holds ids whose subtrees go. Rows need ``id, project_id, kind,
    parent_id, relative_path``. Writing the result is the caller's, as a new
    table version.
    """
    key = collision_key(F.col("relative_path"))
    roots = nodes.join(removed.select("id"), "id", "left_semi").select(
        F.col("relative_path").alias("root_path")
    )
    gone = subtrees(nodes, roots).select("id").distinct()
    replaced = upserts.select("id", F.lit(True).alias("_replaced"))
    # read once for everything below: what stays, its key, and what is replaced
    stay = durable(
        nodes.join(gone, "id", "left_anti").join(replaced, "id", "left").withColumn("_key", key)
    )
    before = nodes.select("id", F.col("project_id").alias("_old_project"))
    kept = stay.where("_replaced IS NULL")
    incoming = upserts.withColumn("_key", key)
    known = ["id", "project_id", "kind"]
    parents = (
        upserts.select(*known)
        .unionByName(kept.select(*known))
        .select(
            F.col("id").alias("parent_id"),
            F.col("project_id").alias("_parent_project"),
            F.col("kind").alias("_parent_kind"),
        )
    )
    claims = kept.select("project_id", "_key").unionByName(incoming.select("project_id", "_key"))
    shared = claims.groupBy("project_id", "_key").agg(F.count("*").alias("_claims"))
    judged = (
        incoming.join(before, "id", "left")
        .join(parents, "parent_id", "left")
        .join(shared, ["project_id", "_key"], "left")
    )
    has_parent = F.col("parent_id").isNotNull()
    code = (
        F.when(F.col("_old_project") != F.col("project_id"), "projectCannotChange")
        .when(F.col("_claims") > 1, "duplicatePath")
        .when(has_parent & (F.col("parent_id") == F.col("id")), "missingParent")
        .when(
            has_parent
            & (
                F.col("_parent_kind").isNull()
                | (F.col("_parent_kind") != "folder")
                | (F.col("_parent_project") != F.col("project_id"))
            ),
            "missingParent",
        )
    )
    judged = durable(judged.withColumn("code", code))
    columns = nodes.columns
    accepted = judged.where("code IS NULL").select(*columns)
    rejected = judged.where("code IS NOT NULL").select("id", "code")
    untouched = stay.join(accepted.select("id"), "id", "left_anti").select(*columns)
    return untouched.unionByName(accepted), rejected
