"""Storage-name collision keys and the audits built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.tables import (
    EXCLUDED,
    HALFWIDTH_MARKS,
    assigned_ranges,
    char_class,
    combining_ranges,
    common_class,
)
from quire.functions.unicode import collision_key, fold_nfkc
from quire.operators.aggregates import duplicate_groups
from quire.operators.relational import orphans

# Base names no storage key may have.
RESERVED = [
    "con", "prn", "aux", "nul",
    "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
]


def with_storage_key(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``storage_key`` and ``storage_code``; one of the two is null.

    The frozen sets become regular-expression classes, so that every check
    runs on the JVM; only normalization of non-ASCII names leaves it.
    """
    raw = F.col(name)
    unassigned = char_class(assigned_ranges(), negated=True)
    adjacency = "[\\x{10000}-\\x{10FFFF}]" + char_class(combining_ranges() + HALFWIDTH_MARKS)
    beyond_ascii = F.octet_length(raw) > F.length(raw)
    folded = df.withColumn("_folded", fold_nfkc(raw))

    def holds_unassigned(text):
        rare = F.regexp_replace(text, common_class() + "+", "")
        return (rare != "") & rare.rlike(unassigned)

    key = F.col("_folded")
    stripped = F.regexp_replace(key, "[ .]+$", "")
    before = (
        F.when(raw.isNull(), "STORAGE_NAME_INVALID")
        .when(beyond_ascii & holds_unassigned(raw), "STORAGE_NAME_UNASSIGNED")
        .when(beyond_ascii & raw.rlike(char_class(EXCLUDED)), "STORAGE_NAME_UNSUPPORTED_SCALAR")
        .when(beyond_ascii & raw.rlike(adjacency), "STORAGE_NAME_INVALID")
    )
    after = (
        F.when(key.rlike(r"[/\\\x00-\x1F\x7F]"), "STORAGE_NAME_INVALID")
        .when(beyond_ascii & holds_unassigned(key), "STORAGE_NAME_UNASSIGNED")
        .when(stripped.isin("", ".", ".."), "STORAGE_NAME_INVALID")
        .when(F.split_part(stripped, F.lit("."), F.lit(1)).isin(RESERVED), "STORAGE_NAME_RESERVED")
    )
    return (
        folded.withColumn("storage_code", F.coalesce(before, after))
        .withColumn("storage_key", F.when(F.col("storage_code").isNull(), stripped))
        .drop("_folded")
    )


def storage_key_audit(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of valid names that share a storage key under equal ``keys``."""
    keyed = with_storage_key(entries).where("storage_key IS NOT NULL")
    return duplicate_groups(keyed, [*keys, "storage_key"])


def name_collision_audit(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of names that clash under NFC and ignored case."""
    keyed = entries.withColumn("name_key", collision_key(F.col("name")))
    return duplicate_groups(keyed, [*keys, "name_key"])


def migration_validation(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Issue counts per project: invalid names, lost parents, sibling clashes.

    Both sides: ``id, project_id, parent_id, name, is_deleted``. Every group
    of clashing siblings is counted.
    """
    live = folders.where("NOT is_deleted").unionByName(documents.where("NOT is_deleted"))
    keyed = with_storage_key(live)
    invalid = keyed.where("storage_code IS NOT NULL").groupBy("project_id").agg(F.count("*").alias("issues"))
    lost = orphans(folders).groupBy("project_id").agg(F.count("*").alias("issues"))
    clashes = (
        duplicate_groups(keyed.where("storage_key IS NOT NULL"), ["project_id", "parent_id", "storage_key"])
        .groupBy("project_id")
        .agg(F.count("*").alias("issues"))
    )

    def coded(df: DataFrame, code: str) -> DataFrame:
        return df.select("project_id", F.lit(code).alias("code"), "issues")

    return (
        coded(invalid, "STORAGE_NAME_INVALID")
        .unionByName(coded(lost, "FOLDER_NOT_FOUND"))
        .unionByName(coded(clashes, "PATH_CONFLICT"))
    )


