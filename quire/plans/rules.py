"""Decisions on requested structure changes, as a batch over their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.names import (
    chapter_number,
    chapter_prefix,
    chapter_title,
    location,
    name_violation,
    parent_path,
    stored_name,
    volume_number,
)
from quire.functions.unicode import collision_key, nfc


def rule_decisions(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """``allowed`` or the reason against it, for each request.

    ``requests``: ``request_id, project_id, action`` (create, rename, move,
    trash, reorder), ``kind, source_path, target_path`` (the folder gone to),
    ``name, position``. ``nodes``: live ``project_id, relative_path``. Names
    and chapters already there are counted per key first, so a crowded folder
    meets each request as one row.
    """
    action, kind = F.col("action"), F.col("kind")
    source = F.col("source_path")
    shaped = requests.withColumns(
        {
            "_old_name": stored_name(source),
            "_old_parent": parent_path(source),
            "_name": F.coalesce("name", stored_name(source)),
        }
    )
    folder = F.when(action == "rename", F.col("_old_parent")).otherwise(F.col("target_path"))
    shaped = shaped.withColumns(
        {
            "_folder": folder,
            "_from": location(source),
            "_to": location(F.col("target_path")),
            "_key": collision_key(F.col("_name")),
            "_old_key": collision_key(F.col("_old_name")),
            "_nfc": nfc(F.col("_name")),
            "_number": F.when(action == "create", chapter_number(F.col("_name"))).otherwise(chapter_number(F.col("_old_name"))),
        }
    )
    path = F.col("relative_path")
    held = nodes.groupBy(
        "project_id", parent_path(path).alias("_folder"), collision_key(stored_name(path)).alias("_key")
    ).agg(F.count("*").alias("_holders"))
    chapters = (
        nodes.where(location(path)["place"] == "chapter")
        .groupBy("project_id", chapter_number(stored_name(path)).alias("_number"))
        .agg(F.count("*").alias("_chapters"))
    )
    joined = shaped.join(held, ["project_id", "_folder", "_key"], "left").join(
        chapters, ["project_id", "_number"], "left"
    )

    # the item itself does not stand in its own way
    same_place = (action == "rename") | ((action == "move") & F.col("_old_parent").eqNullSafe(F.col("target_path")))
    own_name = F.when(same_place & (F.col("_old_key") == F.col("_key")), 1).otherwise(0)
    own_chapter = F.when((action == "move") & (F.col("_from.place") == "chapter"), 1).otherwise(0)
    duplicate_chapter = F.coalesce(F.col("_chapters"), F.lit(0)) - own_chapter > 0
    bad_name = name_violation(F.col("_nfc")).isNotNull()
    name_denial = F.when(bad_name, "invalidName").when(
        F.coalesce(F.col("_holders"), F.lit(0)) - own_name > 0, "duplicateName"
    )
    place, goal = F.col("_from.place"), F.col("_to.place")
    name = F.col("_name")

    create = (
        F.when(name_denial.isNotNull(), name_denial)
        .when(goal == "outside", "allowed")
        .when(goal == "root", F.when(kind != "folder", "manuscriptAcceptsVolumesOnly").when(volume_number(name).isNull(), "invalidVolumeName").otherwise("allowed"))
        .when(
            goal == "volume",
            F.when(kind != "text", "volumeAcceptsChaptersOnly")
            .when(chapter_number(name).isNull() | (chapter_title(name) != ""), "invalidChapterName")
            .when(duplicate_chapter, "duplicateChapterNumber")
            .otherwise("allowed"),
        )
        .otherwise("invalidManuscriptDestination")
    )
    free = F.coalesce(name_denial, F.lit("allowed"))
    rename = (
        F.when(F.col("_old_name") == name, free)
        .when(place == "root", "manuscriptRootLocked")
        .when(place == "volume", "volumeNameLocked")
        .when(bad_name, "invalidName")
        .when(place == "outside", free)
        .when(
            place == "chapter",
            F.when((kind != "text") | chapter_number(name).isNull(), "invalidChapterName")
            .when(chapter_prefix(name) != chapter_prefix(F.col("_old_name")), "chapterPrefixLocked")
            .otherwise(free),
        )
        .otherwise("invalidManuscriptDestination")
    )
    inside_from, inside_to = place != "outside", goal != "outside"
    move = (
        F.when(place == "root", "manuscriptRootLocked")
        .when(inside_from & ~inside_to, "manuscriptCannotLeave")
        .when(~inside_from & inside_to, "externalItemCannotEnter")
        .when(name_denial.isNotNull(), name_denial)
        .when(~inside_from, "allowed")
        .when((place == "volume") & (goal == "root"), F.when(kind == "folder", "allowed").otherwise("invalidManuscriptDestination"))
        .when(
            (place == "chapter") & (goal == "volume"),
            F.when(kind != "text", "invalidManuscriptDestination")
            .when(duplicate_chapter, "duplicateChapterNumber")
            .otherwise("allowed"),
        )
        .otherwise("invalidManuscriptDestination")
    )
    trash = (
        F.when(place == "root", "manuscriptRootLocked")
        .when(place.isin("volume", "chapter"), "manuscriptDeletionLocked")
        .when(place == "invalid", "invalidManuscriptDestination")
        .otherwise(free)
    )
    reorder = (
        F.when(place == "outside", "allowed")
        .when(place == "root", F.when(F.col("position") == 0, "allowed").otherwise("manuscriptRootLocked"))
        .otherwise("manuscriptUsesNaturalOrder")
    )
    decision: Column = (
        F.when(action == "create", create)
        .when(action == "rename", rename)
        .when(action == "move", move)
        .when(action == "trash", trash)
        .when(action == "reorder", reorder)
        .otherwise("unknownAction")
    )
    return joined.select("request_id", decision.alias("decision"))
