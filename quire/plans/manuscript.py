"""Ordered assembly of chapters, and what is missing from a manuscript."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.names import MANUSCRIPT, TOP, chapter_number, chapter_prefix, volume_number
from quire.functions.text import grapheme_count
from quire.operators.ordered import with_previous
from quire.operators.windows import until_short

# Separator between chapters, chapters per volume, short limit.
SEPARATOR = "\n\n"
CHAPTERS_PER_VOLUME = 25
SHORT_CHAPTER = 300

#: Numbers of a gap that one row stands for before they are written out.
GAP = 65_536


def manuscript_chapters(nodes: DataFrame) -> DataFrame:
    """Texts lying at ``top/manuscript/Nvolume/NNNchapter.txt`` with their number."""
    parts = F.split("relative_path", "/", -1)
    keep = (
        (F.size(parts) == 4)
        & (F.get(parts, F.lit(0)) == TOP)
        & (F.get(parts, F.lit(1)) == MANUSCRIPT)
        & volume_number(F.get(parts, F.lit(2))).isNotNull()
    )
    if "is_deleted" in nodes.columns:
        keep = keep & ~F.col("is_deleted")
    name = F.get(parts, F.lit(3))
    found = nodes.where(keep).withColumns({"number": chapter_number(name), "prefix": chapter_prefix(name)})
    return found.where("number IS NOT NULL")


def duplicate_chapters(chapters: DataFrame) -> DataFrame:
    return (
        chapters.groupBy("project_id", "number").agg(F.count("*").alias("members")).where("members > 1")
    )


def select_chapters(
    chapters: DataFrame,
    first: int | None = None,
    last: int | None = None,
    stop_short: bool = False,
    skip_empty: bool = False,
) -> DataFrame:
    """Chapters that go into the output. The short test comes before the empty one."""
    if (first is None) != (last is None) or (first is not None and not 0 < first <= last):
        raise ValueError("invalid chapter range")
    if first is not None:
        chapters = chapters.where(F.col("number").between(first, last))
    if stop_short:
        sized = chapters.withColumn("characters", grapheme_count(F.col("text")))
        chapters = until_short(sized, ["project_id"], SHORT_CHAPTER).drop("characters")
    else:
        chapters = chapters.withColumn("first_short", F.lit(None).cast("bigint"))
    if skip_empty:
        chapters = chapters.where(F.col("text") != "")
    return chapters


def assemble(chapters: DataFrame, titles: bool = False, **options) -> DataFrame:
    """One manuscript per project: text, range and file name.

    A project's manuscript is one value by definition of the format, so its
    chapters meet in one row; projects spread over the cluster. Projects with
    a repeated chapter number give an error row instead of a text. For
    manuscripts too large for a row use :func:`assemble_parts`.
    """
    clash = duplicate_chapters(chapters).groupBy("project_id").agg(F.min("number").alias("_duplicate"))
    chosen = select_chapters(chapters, **options)
    body = F.concat("prefix", F.lit(SEPARATOR), "text") if titles else F.col("text")
    entry = F.struct("number", body.alias("body"))
    gathered = chosen.groupBy("project_id").agg(
        F.min("number").alias("first_number"),
        F.max("number").alias("last_number"),
        F.count("*").alias("chapters"),
        F.array_sort(F.collect_list(entry)).alias("_entries"),
    )
    joined = gathered.join(clash, "project_id", "left")
    ok = F.col("_duplicate").isNull()
    content = F.array_join(F.col("_entries.body"), SEPARATOR)
    file_name = F.concat(
        F.col("project_id").cast("string"),
        F.lit("("),
        F.col("first_number").cast("string"),
        F.lit("~"),
        F.col("last_number").cast("string"),
        F.lit("화).txt"),
    )
    return joined.select(
        "project_id",
        "first_number",
        "last_number",
        "chapters",
        F.when(ok, content).alias("content"),
        F.when(ok, file_name).alias("file_name"),
        F.when(~ok, "duplicateChapterNumber").alias("problem"),
    )


def assemble_parts(chapters: DataFrame, titles: bool = False, **options) -> DataFrame:
    """The same manuscripts as ordered parts, one row per chapter.

    Nothing is gathered: sorted by (project, number) across the cluster the
    parts concatenate to the text, whatever its size.
    """
    chosen = select_chapters(chapters, **options)
    body = F.concat("prefix", F.lit(SEPARATOR), "text") if titles else F.col("text")
    firsts = chosen.groupBy("project_id").agg(F.min("number").alias("_first"))
    lead = F.when(F.col("number") > F.col("_first"), SEPARATOR).otherwise("")
    return (
        chosen.join(firsts, "project_id")
        .select("project_id", "number", F.concat(lead, body).alias("part"))
        .orderBy("project_id", "number")
    )


def manuscript_rows(chapters: DataFrame, titles: bool = False, **options) -> DataFrame:
    """``file_name, number, part`` of every manuscript without a repeated number, for the writer of parts.

    A written row ends with a newline, so a part after the first begins with
    the rest of the separator.
    """
    clash = duplicate_chapters(chapters).select("project_id").distinct()
    chosen = select_chapters(chapters, **options).join(clash, "project_id", "left_anti")
    body = F.concat("prefix", F.lit(SEPARATOR), "text") if titles else F.col("text")
    ends = chosen.groupBy("project_id").agg(F.min("number").alias("_first"), F.max("number").alias("_last"))
    lead = F.when(F.col("number") > F.col("_first"), SEPARATOR.removeprefix("\n")).otherwise("")
    name = F.format_string("%s(%d~%d화).txt", F.col("project_id").cast("string"), "_first", "_last")
    return chosen.join(ends, "project_id").select(name.alias("file_name"), "number", F.concat(lead, body).alias("part"))


def missing_ranges(chapters: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Gaps as ``project_id, from_number, to_number``: in the range, or between first and last chapter."""
    present = chapters.select("project_id", F.col("number").cast("long").alias("number")).distinct()
    if first is not None:
        inside = present.where(F.col("number").between(first, last))
        bounds = F.explode(F.array(F.lit(first - 1), F.lit(last + 1)).cast("array<bigint>")).alias("number")
        present = inside.unionByName(present.select("project_id").distinct().select("project_id", bounds))
    before = with_previous(present, ["project_id"], ["number"], {"_before": "number"})
    return before.where("number - _before > 1").select(
        "project_id", (F.col("_before") + 1).alias("from_number"), (F.col("number") - 1).alias("to_number")
    )


def missing_chapters(chapters: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Numbers without a chapter in the range, or between first and last.

    A gap of any width is cut into pieces of at most ``GAP`` numbers, which
    are dealt over the cluster before they are written out.
    """
    gaps = missing_ranges(chapters, first, last)
    begin = F.explode(F.sequence("from_number", "to_number", F.lit(GAP).cast("long")))
    pieces = gaps.withColumn("_begin", begin).repartition("project_id", "_begin")
    end = F.least(F.col("_begin") + (GAP - 1), F.col("to_number"))
    return pieces.select("project_id", F.explode(F.sequence(F.col("_begin"), end)).alias("number"))


def chapter_report(chapters: DataFrame) -> DataFrame:
    """Counts per project: chapters, empty ones, first short one."""
    length = grapheme_count(F.col("text"))
    short = F.when(length < SHORT_CHAPTER, F.col("number"))
    return chapters.groupBy("project_id").agg(
        F.count("*").alias("chapters"),
        F.min("number").alias("first_number"),
        F.max("number").alias("last_number"),
        F.count_if(F.col("text") == "").alias("empty_chapters"),
        F.min(short).alias("first_short"),
    )


def volume_coverage(chapters: DataFrame) -> DataFrame:
    """Chapters of the next volume by project, and whether each is taken.

    Volume n owns chapters 25(n-1)+1 to 25n; the next volume is the highest
    existing one plus one. ``chapters`` needs ``project_id, volume, number``.
    """
    next_volume = chapters.groupBy("project_id").agg((F.max("volume") + 1).alias("volume"))
    start = (F.col("volume") - 1) * CHAPTERS_PER_VOLUME + 1
    expected = next_volume.select(
        "project_id",
        F.col("volume").alias("next_volume"),
        F.explode(F.sequence(start, start + (CHAPTERS_PER_VOLUME - 1))).alias("number"),
    )
    present = chapters.select("project_id", "number").distinct().withColumn("_taken", F.lit(True))
    return expected.join(present, ["project_id", "number"], "left").select(
        "project_id", "next_volume", "number", F.coalesce("_taken", F.lit(False)).alias("taken")
    )


def missing_in_volumes(chapters: DataFrame) -> DataFrame:
    """Expected but absent chapters of the volumes that exist."""
    present = chapters.select("project_id", "number").distinct()
    volumes = chapters.select("project_id", "volume").distinct()
    start = (F.col("volume") - 1) * CHAPTERS_PER_VOLUME + 1
    expected = volumes.select(
        "project_id", "volume", F.explode(F.sequence(start, start + (CHAPTERS_PER_VOLUME - 1))).alias("number")
    )
    return expected.join(present, ["project_id", "number"], "left_anti")
