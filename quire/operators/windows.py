"""Per-document ordered rules: retention, coalescing, gaps, lanes, change kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.operators.ordered import (
    newest,
    top_rows,
    with_previous,
    with_row_number,
    with_running,
)

# Reasons whose snapshots may be dropped as duplicates.
AUTOMATIC_REASONS = ["automaticSave", "editingInterval", "documentTransition", "documentClose"]
DONE = ["completed", "cancelled"]


def newest_first(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.col("created_at").desc(), F.col("backup_id").asc())


def distinct_backups(snapshots: DataFrame) -> DataFrame:
    """One row per backup id: a pinned one wins, then the newest."""
    return top_rows(snapshots, ["backup_id"], ["-is_pinned", "-created_at"], 1)


def retention_policy(recent: int, days: int) -> tuple[int, int]:
    """Limits in range, else the default of 30 snapshots and 30 days."""
    return (recent if 1 <= recent <= 500 else 30, days if 1 <= days <= 3650 else 30)


def retention_deletions(
    snapshots: DataFrame, now: Column, recent: int = 30, days: int = 30
) -> DataFrame:
    """Snapshots the policy removes.

    Of a document's unpinned snapshots: in the last 24 hours all but the
    newest ``recent``; before that all but the newest of each UTC day; beyond
    ``days`` every one. Future snapshots stay.
    """
    recent, days = retention_policy(recent, days)
    made = F.col("created_at")
    # a whole number of hours keeps this independent of the session's calendar
    day_ago = now - F.make_dt_interval(hours=F.lit(24))
    expiry = now - F.make_dt_interval(hours=F.lit(24 * days))
    banded = (
        distinct_backups(snapshots)
        .where(~F.col("is_pinned") & (made <= now))
        .withColumn("_day", F.when(made < day_ago, F.to_date(made)))
    )
    ranked = with_row_number(
        banded, ["document_id", "_day"], ["-created_at", "backup_id"], "_position"
    )
    allowed = F.when(F.col("_day").isNull(), recent).otherwise(1)
    return ranked.where((F.col("_position") > allowed) | (made < expiry)).drop("_day", "_position")


def coalesce_duplicates(snapshots: DataFrame) -> DataFrame:
    """Drop automatic snapshots equal in content to the one before them.

    A dropped snapshot has the hash of its predecessor, so comparing with the
    preceding row of the input keeps the same rows as comparing with the
    preceding kept row.
    """
    marked = with_previous(
        snapshots, ["document_id"], ["created_at", "backup_id"], {"_before": "content_hash"}
    )
    repeated = F.col("reason").isin(AUTOMATIC_REASONS) & F.coalesce(
        F.col("_before") == F.col("content_hash"), F.lit(False)
    )
    return marked.where(~repeated).drop("_before")


def current_rows(ledger: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest version per document."""
    return newest(ledger, [key], order)


def unfinished(ops: DataFrame) -> DataFrame:
    return ops.where(~F.col("status").isin(DONE))


def lane_heads(ops: DataFrame, lane: list[str], order: list[str]) -> DataFrame:
    """First unfinished operation of each lane."""
    return top_rows(unfinished(ops), lane, order, 1)


def sequence_gaps(df: DataFrame, keys: list[str], sequence: str, order: list[str]) -> DataFrame:
    """Rows whose number is not the preceding one plus one, from 1."""
    marked = with_previous(df, keys, order, {"previous": sequence})
    expected = F.coalesce(F.col("previous"), F.lit(0)) + 1
    return marked.withColumn("expected", expected).where(F.col(sequence) != F.col("expected"))


def promote_base(ops: DataFrame, lane: list[str], order: list[str]) -> DataFrame:
    """A queued operation without a base takes its predecessor's result."""
    marked = with_previous(
        ops, lane, order, {"_revision": "result_revision", "_hash": "content_hash"}
    )
    promoted = F.col("base_revision").isNull() & F.col("_revision").isNotNull()
    return marked.withColumns(
        {
            "promoted": promoted,
            "base_hash": F.when(promoted, F.col("_hash")),
            "base_revision": F.coalesce("base_revision", "_revision"),
        }
    ).drop("_revision", "_hash")


def newest_local(ops: DataFrame) -> DataFrame:
    """Newest local state per document; a known save generation comes first."""
    ranked = unfinished(ops).withColumn("_known", F.col("generation").isNotNull())
    order = ["-_known", "-generation", "-document_sequence", "-queue_id"]
    return top_rows(ranked, ["document_id"], order, 1).drop("_known")


def assign_order(known: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """0-based position for new children, after the last existing one."""
    last = known.groupBy("parent_id").agg(F.max("user_order").alias("_last"))
    numbered = with_row_number(fresh, ["parent_id"], order, "_n")
    joined = numbered.join(
        last.withColumnRenamed("parent_id", "_p"), F.col("parent_id").eqNullSafe(F.col("_p")), "left"
    )
    position = F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_n")
    return joined.withColumn("user_order", position).drop("_p", "_last", "_n")


def until_short(chapters: DataFrame, keys: list[str], limit: int = 300) -> DataFrame:
    """Chapters before the first one shorter than ``limit`` graphemes.

    ``characters`` must hold the length. One small aggregate gives each
    project's stop, so that no window over the texts is needed.
    """
    stops = chapters.where(F.col("characters") < limit).groupBy(*keys).agg(
        F.min("number").alias("first_short")
    )
    return chapters.join(stops, keys, "left").where(
        F.col("first_short").isNull() | (F.col("number") < F.col("first_short"))
    )


def classify_change(ledger: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Kind of each version, by what differs from the version before it."""
    before = {"_gone": "is_deleted", "_path": "relative_path", "_hash": "content_hash"}
    marked = with_previous(ledger, [key], order, before)
    kind = (
        F.when(F.col("_gone").isNull(), "create")
        .when(~F.col("_gone") & F.col("is_deleted"), "delete")
        .when(F.col("_gone") & ~F.col("is_deleted"), "restore")
        .when(
            (F.col("_path") != F.col("relative_path")) & (F.col("_hash") == F.col("content_hash")),
            "move",
        )
        .otherwise("update")
    )
    return marked.withColumn("kind", kind).drop(*before)


def classify_folder_change(ledger: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The folder rule: delete, restore, move, rename, update."""
    before = {"_seen": "revision", "_gone": "is_deleted", "_parent": "parent_id", "_name": "name"}
    marked = with_previous(ledger, [key], order, before)
    kind = (
        F.when(F.col("_seen").isNull(), "create")
        .when(~F.col("_gone") & F.col("is_deleted"), "delete")
        .when(F.col("_gone") & ~F.col("is_deleted"), "restore")
        .when(~F.col("_parent").eqNullSafe(F.col("parent_id")), "move")
        .when(F.col("_name") != F.col("name"), "rename")
        .otherwise("update")
    )
    return marked.withColumn("kind", kind).drop(*before)
