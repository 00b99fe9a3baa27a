"""Writers: manuscripts, tree order, the append-only ledger."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.names import ROOT_KEY, TOP, TRASH, parent_path, stored_name
from quire.operators.ordered import with_row_number
from quire.session import durable, folder_listing, writing_tasks


def tree_order_entries(nodes: DataFrame, top: str = TOP, trash: str = f"{TOP}/{TRASH}") -> DataFrame:
    """``parent_key, position, name`` of every child, by (order, path) from 0.

    Children of the top container have the key ``<root>``, those of other
    folders their folder's path. Nodes without a parent, trashed nodes (where
    there is a ``status``) and the trash with all in it are not listed.
    """
    path, above = F.col("relative_path"), parent_path(F.col("relative_path"))
    live = above.isNotNull() & (path != trash) & ~path.startswith(f"{trash}/")
    if "status" in nodes.columns:
        live = live & (F.col("status") == "active")
    children = nodes.where(live).select(
        F.when(above == top, ROOT_KEY).otherwise(above).alias("parent_key"),
        "user_order",
        "relative_path",
        stored_name(path).alias("name"),
    )
    placed = with_row_number(children, ["parent_key"], ["user_order", "relative_path"], "_place")
    return placed.select("parent_key", (F.col("_place") - 1).cast("long").alias("position"), "name")


def write_tree_order(nodes: DataFrame, path: str) -> None:
    """JSON lines ``{"tree_order": {"<parent>": [names]}, "version": 1}``, one object per parent."""
    lists = tree_order_entries(nodes).groupBy("parent_key").agg(
        F.array_sort(F.collect_list(F.struct("position", "name"))).alias("_children")
    )
    order = F.create_map("parent_key", F.col("_children.name"))
    lines = lists.select(F.to_json(F.struct(order.alias("tree_order"), F.lit(1).alias("version"))).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_manuscript(manuscripts: DataFrame, path: str) -> None:
    """One folder of text per manuscript, named by ``file_name``.

    Spark's commit protocol makes each write appear whole or not at all. The
    text writer ends each file with a newline.
    """
    manuscripts.select("file_name", F.col("content").alias("value")).write.mode("overwrite").partitionBy(
        "file_name"
    ).text(path)


def write_manuscript_parts(parts: DataFrame, path: str) -> None:
    """The same folders from ``file_name, number, part``, a row per chapter.

    Rows are dealt by range and sorted, so that a manuscript of any size is
    written by several tasks, each file a run of its chapters; file names
    sort as the runs do. One commit makes all of it appear. As each row ends
    with a newline, a part begins with what its separator has beyond that. The
    cost is in the folders, so that few bytes do not make it one task.
    """
    tasks = writing_tasks(parts.sparkSession)
    ranged = parts.repartitionByRange(tasks, "file_name", "number").sortWithinPartitions("file_name", "number")
    ranged.select("file_name", F.col("part").alias("value")).write.mode("overwrite").partitionBy("file_name").text(path)


def read_manuscript_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, file, content`` of each file; a manuscript's files follow one another by ``file``."""
    with folder_listing(spark):
        files = spark.read.text(path, wholetext=True)
    return files.select("file_name", F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def append_ledger(rows: DataFrame, path: str, partition: str = "project_id") -> None:
    """Add rows to the ledger. Existing files are never rewritten."""
    rows.write.mode("append").partitionBy(partition).parquet(path)


# --- insert-only tables ---------------------------------------------------------------

#: Characters of a row as JSON up to which offers compare it, not its digest.
SHORT = 128


def insert_only(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Offer rows to an insert-only table: ``keys, outcome``, a row per key offered.

    A key that is new is ``inserted``; one that is there with equal columns is
    ``present``; one that is there with others, or comes with different ones
    in the same offer, is ``refused``. Rows are staged as files of their own,
    then one entry in the manifest makes them part of the table, so that an
    offer that fails adds nothing and may be made again. Entries are numbered;
    who finds the next number taken judges its offer anew.
    """
    spark = rows.sparkSession
    columns = sorted(c for c in rows.columns if c not in keys)
    whole = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    digest = F.sha2(whole.cast("binary"), 256)
    # what is short is told apart by itself, which takes less room in an exchange than a digest
    payload = F.when(F.length(whole) <= SHORT, whole).otherwise(digest).alias("_payload")
    named = [F.col(k) for k in keys]
    offered = rows.select(*named, payload, F.struct(*[F.col(c) for c in columns]).alias("_row"), F.lit(None).cast("string").alias("_stored"))
    while True:
        version = _last_version(spark, path)
        both = offered
        if version:
            known = _committed(spark, path, version, rows.schema).select(*named, payload.alias("_stored"))
            both = offered.unionByName(known, allowMissingColumns=True)
        # offer and table meet once, by key
        met = both.groupBy(*keys).agg(
            F.min("_payload").alias("_payload"), F.max("_payload").alias("_high"), F.max("_stored").alias("_stored"), F.any_value("_row", F.lit(True)).alias("_row")
        )
        outcome = (
            F.when(F.col("_payload") != F.col("_high"), "refused")
            .when(F.col("_stored").isNull(), "inserted")
            .when(F.col("_stored") == F.col("_payload"), "present")
            .otherwise("refused")
        )
        answers = met.where("_payload IS NOT NULL").withColumn("outcome", outcome)
        judged = durable(answers.select(*keys, "outcome", F.when(F.col("outcome") == "inserted", F.col("_row")).alias("_row")))
        answer, added = judged.select(*keys, "outcome"), judged.where("outcome = 'inserted'")
        if added.isEmpty():
            return answer
        batch = uuid.uuid4().hex
        own = added.select(*named, "_row.*").select(*rows.columns, digest.alias("_payload"))
        own.write.parquet(f"{path}/rows/batch={batch}")
        try:
            entry = spark.createDataFrame([(batch,)], "batch string").coalesce(1)
            entry.write.mode("error").parquet(f"{path}/manifest/version={version + 1}")
            return answer
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """``batch, version`` of the manifest; none where there is no table yet."""
    try:
        return spark.read.schema("batch string, version bigint").parquet(f"{path}/manifest")
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "batch string, version bigint")


def _last_version(spark: SparkSession, path: str) -> int:
    return _entries(spark, path).agg(F.max("version")).first()[0] or 0


def _committed(spark: SparkSession, path: str, version: int, schema: StructType) -> DataFrame:
    batches = _entries(spark, path).where(F.col("version") <= version).select("batch")
    # staged files that no entry names are not part of the table
    own = StructType([*schema.fields, StructField("batch", StringType())])
    staged = spark.read.schema(own).parquet(f"{path}/rows")
    return staged.join(batches, "batch", "left_semi").drop("batch")


def read_inserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an insert-only table."""
    entries = _entries(spark, path)
    return spark.read.parquet(f"{path}/rows").join(entries.select("batch"), "batch", "left_semi").drop("batch", "_payload")
