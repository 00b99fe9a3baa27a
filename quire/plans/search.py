"""Corpus search: literal, case-insensitive, with excerpts and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.names import BACKUP, TRASH, has_component
from quire.functions.text import (
    excerpt,
    excerpt_window,
    is_wide,
    literal_pattern,
    match_offsets,
    piece_sizes,
    text_chunks,
    utf16_length,
)


def searchable(nodes: DataFrame, trash: str = TRASH, backup: str = BACKUP) -> DataFrame:
    """Live texts outside the trash and backup folders."""
    keep = ~F.col("is_deleted") & ~has_component(F.col("relative_path"), trash, backup)
    if "kind" in nodes.columns:
        keep = keep & (F.col("kind") == "text")
    return nodes.where(keep)


def overlay(corpus: DataFrame, drafts: DataFrame) -> DataFrame:
    """Unsaved draft text in place of the stored text.

    ``drafts`` holds at most one row per document. Spark decides on the join
    by the real size of that side.
    """
    renamed = drafts.select("document_id", F.col("text").alias("_draft"))
    return (
        corpus.join(renamed, "document_id", "left")
        .withColumn("text", F.coalesce("_draft", "text"))
        .drop("_draft")
    )


def search(corpus: DataFrame, query: str, excerpts: bool = False) -> DataFrame:
    """One row per hit; an empty query has none. Runs in one scan, no shuffle."""
    found = corpus.where(F.col("text").rlike(literal_pattern(query)) if query else F.lit(False))
    columns = [c for c in ("project_id", "document_id", "relative_path") if c in corpus.columns]
    length = len(query)
    needle = query or "\0"
    marked = found.withColumn("_wide", is_wide(F.col("text")))
    sized = marked.withColumn("_sizes", piece_sizes(F.col("text"), needle, F.col("_wide")))
    offsets = match_offsets(F.col("_sizes"), needle)
    extra = []
    if not excerpts:
        hits = sized.select(*columns, F.explode(offsets).alias("at"))
    else:
        chunked = sized.withColumns(
            {"_chunks": text_chunks(F.col("text")), "_total": F.length("text")}
        )
        packed = F.transform(
            offsets,
            lambda at: F.struct(
                at.alias("at"), excerpt_window(F.col("_chunks"), at["cp"], length).alias("near")
            ),
        )
        hits = chunked.select(*columns, "_total", F.explode(packed).alias("h")).select(
            *columns, "_total", F.col("h.at").alias("at"), F.col("h.near").alias("near")
        )
        preview, offset = excerpt(F.col("near"), F.col("at.cp"), F.col("_total"), length)
        extra = [preview.alias("preview"), offset.alias("preview_offset")]
    return hits.select(
        *columns,
        F.col("at.hit").alias("hit"),
        F.col("at.cp").alias("cp_location"),
        F.col("at.u16").alias("utf16_location"),
        utf16_length(F.lit(query)).alias("utf16_length"),
        *extra,
    )


def search_report(corpus: DataFrame, query: str) -> DataFrame:
    """Totals of one search: documents, documents with a readable text, hits."""
    hits = F.size(F.split(F.col("text"), literal_pattern(query), -1)) - 1 if query else F.lit(0)
    readable = F.col("text").isNotNull()
    return corpus.agg(
        F.count("*").alias("total_documents"),
        (F.count_if(readable) if query else F.lit(0).cast("long")).alias("searched_documents"),
        F.coalesce(F.sum(F.when(readable, hits).otherwise(0)), F.lit(0)).cast("long").alias("hits"),
        F.count_if(F.when(readable, hits).otherwise(0) > 0).alias("documents_with_hits"),
        F.count_if(~readable).alias("read_issues"),
    )
