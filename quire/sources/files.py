"""Text trees on a file system as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.names import ancestor_paths, stored_name
from quire.functions.unicode import collision_key
from quire.operators.aggregates import duplicate_groups
from quire.session import folder_listing


def _relative(root: str) -> Column:
    """Path below the root, whatever the scheme in front of it."""
    base = root.split("://", 1)[-1].rstrip("/")
    return F.expr(f"substring(path, instr(path, {_literal(base)}) + {len(base) + 1})")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below the root: path, size, time, digest, text if UTF-8.

    Files are read in parallel by Spark's binary source; a file that is not
    UTF-8 has ``valid_utf8`` false and no text.
    """
    with folder_listing(spark):
        raw = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .load(root)
        )
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select(
        _relative(root).alias("relative_path"),
        F.lit("file").alias("kind"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.sha2("content", 256).alias("content_hash"),
        text.isNotNull().alias("valid_utf8"),
        text.alias("text"),
    )


def scan_folders(files: DataFrame) -> DataFrame:
    """The folders that hold the files, once each."""
    paths = files.select(F.explode(ancestor_paths(F.col("relative_path"))).alias("relative_path")).distinct()
    return paths.select("relative_path", F.lit("folder").alias("kind"))


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Folders and ``.txt`` files of a corpus: name, path, kind, bytes, time, hash, text."""
    files = scan_files(spark, root, "*.txt")
    both = files.unionByName(scan_folders(files), allowMissingColumns=True)
    return both.withColumn("name", stored_name(F.col("relative_path")))


def scan_import_tree(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """Every entry below an import root, as the import audits expect it."""
    files = scan_files(spark, root).drop("text")
    both = files.unionByName(scan_folders(files), allowMissingColumns=True)
    return both.withColumns(
        {"project_id": F.lit(project_id), "valid_utf8": F.coalesce("valid_utf8", F.lit(True))}
    )


def scan_errors(entries: DataFrame) -> DataFrame:
    """Entries a scan must refuse: not UTF-8, or clashing names."""
    broken = entries.where("kind = 'file' AND NOT valid_utf8").select(
        "relative_path", F.lit("invalidUTF8").alias("code")
    )
    keyed = entries.select(collision_key(F.col("relative_path")).alias("relative_path"))
    clashing = duplicate_groups(keyed, ["relative_path"]).select(
        "relative_path", F.lit("nameCollision").alias("code")
    )
    return broken.unionByName(clashing)
