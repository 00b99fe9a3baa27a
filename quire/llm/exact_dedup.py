"""Exact duplicates by a stream with keyed state on disk.

A table of documents is read as a file stream. The state, in RocksDB, has a
key for each digest of a normalised text and never expires; it retains the
identifier and the content locator (file and row) of the document that stays
and the number of documents seen. Spark adds rows up before they meet by
digest, so a text that a third of all rows share sends one row a task.

Digests only nominate. The full bytes of every digest that was hit more than
once are compared: the smallest and the largest text of a digest are found,
again added up in each task first, and are equal only if all its texts are.
Digests for which they differ are grouped again by the texts themselves.

With a folder of its own the state outlives the run: a later run reads only
the files that came since.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bitmap, hits
from quire.session import disk_state, durable, shared_folder

Digest = Callable[[Column], Column]

#: Largest groups, joined by broadcast; no other key has more than a share of 1 / LARGEST of the rows.
LARGEST = 1000


def normalised(text: Column) -> Column:
    """A-Z in lower case and nothing else; null as empty."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), letters, letters.lower())


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _located(rows: DataFrame, digest: Digest) -> DataFrame:
    """doc_id, normalised text, digest and content locator of each row of a table's files."""
    source = rows.metadataColumn("_metadata")
    named = rows.select(
        "doc_id", normalised(F.col("text")).alias("norm"), source.getField("file_path").alias("file"), source.getField("row_index").alias("place")
    )
    return named.withColumn("digest", digest(F.col("norm")))


def _schema(spark: SparkSession, path: str) -> str:
    return f"doc_id {spark.read.parquet(path).schema['doc_id'].dataType.simpleString()}, text string"


def _table(spark: SparkSession, path: str, digest: Digest) -> DataFrame:
    return _located(spark.read.schema(_schema(spark, path)).parquet(path), digest)


def _row() -> Column:
    """What of a row is retained; the largest stays."""
    return F.struct("doc_id", "file", "place")


def index(spark: SparkSession, path: str, folder: str | None = None, digest: Digest = sha256) -> DataFrame:
    """(digest, keep: doc_id, file and place, size) of all digests seen.

    ``folder`` holds state, progress and the changed groups of each
    micro-batch; with the folder of an earlier run only new files are read.
    """
    folder, path = folder or shared_folder(spark), path.rstrip("/")
    # a pattern, as a stream takes a folder or a pattern but not one file
    stream = spark.readStream.schema(_schema(spark, path)).parquet(f"{path[:-1]}[{path[-1]}]")
    state = _located(stream, digest).groupBy("digest").agg(F.max(_row()).alias("keep"), F.count("*").alias("size"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch}")

    with disk_state(spark):
        query = (
            state.writeStream.outputMode("update").foreachBatch(put).trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/state").start()
        )
        query.awaitTermination()
    groups = spark.read.parquet(f"{folder}/groups")
    last = groups.groupBy("digest").agg(F.max_by(F.struct("keep", "size"), "batch").alias("last"))
    return durable(last.select("digest", "last.keep", "last.size"))


def _collided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests, of those hit, that stand for texts with different bytes."""
    hit = groups.where("size > 1").select(F.xxhash64("digest").alias("hash"))
    cells = rows.sparkSession.sparkContext.broadcast(bitmap(hit, "hash"))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(hits(cells.value, hashes.to_numpy()))

    texts = rows.where(maybe(F.xxhash64("digest"))).groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return durable(texts.where("low <> high").select("digest"))


def deduplicate(spark: SparkSession, path: str, folder: str | None = None, digest: Digest = sha256) -> DataFrame:
    """One row per row of the table at ``path``, those dropped too.

    (doc_id, keep_id, group_size, kept, text_sha256, file, place). Of equal
    texts the largest doc_id stays; of its repeated rows the one with the
    largest locator. Null ids come before all others, so that a group of
    nulls has keep_id null and keeps one row. Null texts equal empty ones. An
    empty table gives no rows; further columns are not read.
    """
    groups = index(spark, path, folder, digest)
    rows = _table(spark, path, digest)
    collided = _collided(rows, groups)
    facts = durable(rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)).drop("norm"))
    many = groups.where("size > 1")
    largest = F.broadcast(durable(many.orderBy(F.desc("size"), "digest").limit(LARGEST)))
    rest = many.join(largest.select("digest"), "digest", "left_anti")
    others = facts.join(largest.select("digest"), "digest", "left_anti").join(rest, "digest", "left")
    found = facts.join(largest, "digest").unionByName(others)
    if not collided.isEmpty():
        mixed = rows.join(collided, "digest", "left_semi")
        split = mixed.groupBy("digest", "norm").agg(F.max(_row()).alias("keep"), F.count("*").alias("size"))
        again = mixed.join(split, ["digest", "norm"]).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        found = found.join(collided, "digest", "left_anti").unionByName(again.drop("norm"))
    keep, size = F.coalesce("keep", _row()), F.coalesce("size", F.lit(1))
    return found.withColumn("keep", keep).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), size.cast("long").alias("group_size"),
        ((F.col("keep.file") == F.col("file")) & (F.col("keep.place") == F.col("place"))).alias("kept"), "text_sha256", "file", "place",
    )


def distinct_documents(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """The rows that stay, in their own columns."""
    kept = durable(deduplicate(spark, path, folder).where("kept").select("file", "place"))
    docs = spark.read.parquet(path)
    source = docs.metadataColumn("_metadata")
    here = (source.getField("file_path") == kept["file"]) & (source.getField("row_index") == kept["place"])
    return docs.join(kept, here, "left_semi")
