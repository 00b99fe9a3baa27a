"""Aggregates over operations, issues and whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.operators.ordered import with_running
from quire.operators.windows import DONE, lane_heads, unfinished
from quire.session import durable


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every group of equal keys with more than one member."""
    return df.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1")


#: Code points there are, and how many of a text are counted at once.
_CODE_POINTS, _AT_ONCE = 0x110000, 1 << 20


def code_point_counts(texts: DataFrame, column: str) -> DataFrame:
    """``cp, n``: how often each code point occurs in a column of texts.

    Each task counts its texts in one array, so that a row per code point
    leaves it, whatever the texts hold.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODE_POINTS, dtype=np.int64)

        def add(text: str) -> None:
            for begin in range(0, len(text), _AT_ONCE):
                here = np.bincount(np.frombuffer(text[begin : begin + _AT_ONCE].encode("utf-32-le"), dtype="<u4"))
                total[: len(here)] += here

        for batch in batches:
            waiting, size = [], 0
            for value in batch.column(0):
                if value.is_valid:
                    waiting.append(value.as_py().decode(errors="replace"))
                    size += len(waiting[-1])
                if size >= _AT_ONCE:
                    add("".join(waiting))
                    waiting, size = [], 0
            add("".join(waiting))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["cp", "n"])

    counted = texts.select(F.col(column).cast("binary")).mapInArrow(count, "cp bigint, n bigint")
    return counted.groupBy("cp").agg(F.sum("n").alias("n"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count("*").alias("issues"))


def ready_projects(ops: DataFrame, now: Column) -> DataFrame:
    """Projects with a lane head that may run, oldest work first."""
    heads = lane_heads(ops, ["document_id"], ["created_at", "queue_id"])
    due = (F.col("status") == "pending") | (
        (F.col("status") == "retry_wait") & (F.col("created_at") <= now)
    )
    return (
        heads.where(due)
        .groupBy("project_id")
        .agg(F.min("queue_id").alias("first_queue_id"))
        .orderBy("first_queue_id")
    )


def next_retry(ops: DataFrame) -> DataFrame:
    """Earliest retry time among the lane heads of each project."""
    heads = lane_heads(ops, ["document_id"], ["created_at", "queue_id"])
    return (
        heads.where(F.col("status") == "retry_wait")
        .groupBy("project_id")
        .agg(F.min("created_at").alias("next_attempt_at"))
    )


def merge_purges(purges: DataFrame) -> DataFrame:
    """Highest revision per document and its newest known generation."""
    known = F.col("generation").isNotNull()
    return purges.groupBy("document_id").agg(
        F.max("revision").alias("revision"),
        F.max_by("generation", F.when(known, F.struct("recorded_at", "purge_id"))).alias("generation"),
    )


def materialize_purge(documents: DataFrame, ops: DataFrame) -> DataFrame:
    """Revision each purge may name; null while the document has open work."""
    per_document = ops.groupBy("document_id").agg(
        F.bool_or(~F.col("status").isin(DONE)).alias("_busy"),
        F.max(
            F.when(
                (F.col("status") == "completed") & (F.col("operation_kind") == "delete"),
                F.col("base_revision") + 1,
            )
        ).alias("_done"),
    )
    joined = documents.join(per_document, "document_id", "left")
    server = F.when(F.col("is_deleted"), F.col("server_revision")).otherwise(0)
    best = F.greatest(F.coalesce(F.col("_done"), F.lit(0)), server)
    usable = ~F.coalesce(F.col("_busy"), F.lit(False)) & (best > 0)
    return joined.select("document_id", F.when(usable, best).alias("purge_revision"))


def batch_status(ops: DataFrame) -> DataFrame:
    """State of each batch and its first error in queue order."""
    status = F.col("status")
    failed = F.col("error_code").isNotNull()
    return ops.groupBy("batch_id").agg(
        F.when(F.bool_or(status.isin("conflict", "blocked")), "attention")
        .when(F.bool_or(~status.isin(DONE)), "ready")
        .otherwise("completed")
        .alias("status"),
        F.min_by("error_code", F.when(failed, F.col("queue_id"))).alias("first_error"),
    )


def document_flags(ops: DataFrame) -> DataFrame:
    """What is known of each document's operations, in one aggregate."""
    status, error = F.col("status"), F.col("error_code")
    return ops.groupBy("document_id").agg(
        F.bool_or(~status.isin(DONE)).alias("has_unfinished"),
        F.bool_or(status == "conflict").alias("has_conflict"),
        F.min_by(
            "error_code", F.when(status == "blocked", F.struct("created_at", "queue_id"))
        ).alias("blocked_code"),
        F.coalesce(F.bool_or((status == "conflict") & (error == "PATH_CONFLICT")), F.lit(False)).alias(
            "has_path_conflict"
        ),
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: row count and two sums of row hashes.

    The sums combine on the map side, so a table of any size folds to one
    row without being sorted or brought together. Equal tables agree; the
    value differs from a digest of the sorted text.
    """
    row = F.md5(F.to_json(F.struct(*df.columns)))
    low = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(row, 18, 15), 16, 10).cast("decimal(38,0)")
    return df.select(low.alias("a"), high.alias("b")).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum("a"), F.lit(0)).cast("string").alias("low_sum"),
        F.coalesce(F.sum("b"), F.lit(0)).cast("string").alias("high_sum"),
    )


def scoped_fingerprint(tables: dict[str, DataFrame], keep: Column) -> DataFrame:
    """Fingerprints of several tables restricted to (or outside) a project."""
    parts = [
        table_fingerprint(df.where(keep)).select(F.lit(name).alias("table_name"), "*")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def corpus_fingerprint(files: DataFrame, width: int = 64) -> DataFrame:
    """SHA-256 tree over (kind, path, bytes, hash), independent of row order.

    Rows fall into buckets by the first digits of their own digest, as many
    digits as bring the mean bucket to at most ``width`` rows; equal rows are
    one entry with their number. A bucket's digest covers its entries in
    order, and each level above covers the sixteen buckets that share one
    digit less, up to the root. So no list grows with the corpus.
    """
    zero = F.lit("\0")
    row = F.sha2(
        F.concat("kind", zero, "relative_path", zero, F.col("bytes").cast("string"), zero, "content_hash"),
        256,
    )
    entries = durable(files.select(row.alias("entry")).groupBy("entry").agg(F.count("*").alias("n")))
    distinct, total = entries.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    digits = digest_digits(distinct, width)
    counted = F.concat("entry", F.lit(":"), F.col("n").cast("string"))
    level = _digests(entries.select(F.left("entry", F.lit(digits)).alias("bucket"), counted.alias("part")))
    for size in range(digits - 1, -1, -1):
        level = _digests(level.select(F.left("bucket", F.lit(size)).alias("bucket"), F.concat("bucket", "digest").alias("part")))
    # an empty corpus has the digest of nothing
    root = level.agg(F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("fingerprint"))
    return root.select(F.lit(total).cast("long").alias("files"), "fingerprint")


def digest_digits(rows: int, width: int = 64) -> int:
    """Hexadecimal digits after which a bucket holds at most ``width`` rows on average."""
    return len(f"{(rows - 1) // width:x}") if rows > width else 0


def _digests(parts: DataFrame) -> DataFrame:
    listed = F.array_join(F.array_sort(F.collect_list("part")), "\n")
    return parts.groupBy("bucket").agg(F.sha2(listed.cast("binary"), 256).alias("digest"))


def latency_summary(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank median and p95 per group, exact at any size.

    Values are first counted, which shrinks repeated ones on the map side;
    running counts then show which value holds each rank.
    """
    counted = samples.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("samples"))
    running = with_running(counted, keys, [value], {"_upto": ("sum", "_c")})
    ranked = running.join(totals, keys)

    def at(share: float) -> Column:
        rank = F.ceil(F.col("samples") * share)
        return F.min(F.when(F.col("_upto") >= rank, F.col(value)))

    return ranked.groupBy(*keys).agg(
        F.first("samples").alias("samples"), at(0.5).alias("median"), at(0.95).alias("p95")
    )


def pull_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome", "reason").agg(F.count("*").alias("documents"))


def import_summary(entries: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return entries.agg(
        F.count_if(kind == "folder").alias("folders"),
        F.count_if(kind != "folder").alias("files"),
        F.count_if((kind != "folder") & F.lower("relative_path").endswith(".txt")).alias("texts"),
        F.coalesce(F.sum(F.when(kind != "folder", F.col("bytes"))), F.lit(0)).alias("total_bytes"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()
