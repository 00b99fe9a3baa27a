"""Audits of an imported tree: issues, node table, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.digests import is_canonical_uuid
from quire.functions.names import (
    BACKUP,
    MANUSCRIPT,
    TOP,
    chapter_number,
    parent_path,
    path_depth,
    stored_name,
    volume_number,
)
from quire.functions.unicode import collision_key
from quire.operators.ordered import with_row_number

# Folders and files a project must or should have.
REQUIRED_FOLDERS = ["메인", "메인/원고", "백업"]
OPTIONAL_PATHS = [
    "메인/캐릭터", "메인/설정집", "메인/메모장", "메인/흐름정리", "메인/복선",
    "메인/장소", "메인/휴지통", "백업/자동저장", "백업/복원전", "백업/충돌", "설정.json",
]
SETTINGS_FILE = "설정.json"
LEGACY_FOLDERS = {
    "메인/플롯": "legacyPlot",
    "메인/메인 스토리 틀": "legacyMainStory",
    "메인 스토리 틀": "legacyMainStory",
    "백업/전환직전": "legacyPreMigrationBackup",
}
KNOWN_ROOTS = [TOP, BACKUP, "메인 스토리 틀"]


def audit_tree(entries: DataFrame) -> DataFrame:
    """Issue rows ``project_id, relative_path, code, severity``.

    ``entries``: ``project_id, relative_path, kind`` (folder, file or link)
    and ``valid_utf8``. One scan gives all rules that look at a single entry;
    only chapter numbers and name clashes need the entries side by side.
    """
    path = F.col("relative_path")
    parts = F.split(path, "/", -1)
    depth = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    folder, file, link = (F.col("kind") == k for k in ("folder", "file", "link"))
    text = F.lower(path).endswith(".txt")
    manuscript = (depth >= 2) & (at(0) == TOP) & (at(1) == MANUSCRIPT)
    volume, chapter = volume_number(at(2)), chapter_number(at(3))
    chapter_ok = (depth == 4) & volume.isNotNull() & chapter.isNotNull()
    at_top = file & (depth == 2) & (at(0) == TOP)
    inspected = file & ~at_top
    hidden = stored_name(path).startswith(".")

    def legacy(code: str):
        return folder & path.isin([p for p, c in LEGACY_FOLDERS.items() if c == code])

    rules = [
        (link, "symbolicLink", "fatal"),
        (hidden & ~link, "hiddenItem", "warning"),
        *[(legacy(code), code, "warning") for code in dict.fromkeys(LEGACY_FOLDERS.values())],
        (folder & (depth == 1) & ~path.isin(KNOWN_ROOTS), "unknownItem", "warning"),
        (folder & manuscript & (depth == 3) & volume.isNull(), "invalidVolumeName", "fatal"),
        (folder & manuscript & (depth > 3), "invalidChapterName", "fatal"),
        (at_top, "documentAtTopLevel", "fatal"),
        (inspected & text & ~F.col("valid_utf8"), "invalidUTF8", "fatal"),
        (inspected & manuscript & ~chapter_ok, "invalidChapterName", "fatal"),
        (inspected & ~manuscript & ~text & (path != SETTINGS_FILE), "unknownItem", "warning"),
    ]
    found = F.array(
        *[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for c, code, s in rules]
    )
    single = entries.select(
        "project_id", "relative_path", F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")
    ).select("project_id", "relative_path", "i.code", "i.severity")

    # the first path of a chapter number is the one kept; a minimum finds it on the map side
    numbered = entries.where(inspected & manuscript & chapter_ok).select(
        "project_id", "relative_path", chapter.alias("_number")
    )
    kept = numbered.groupBy("project_id", "_number").agg(F.min("relative_path").alias("_kept"))
    repeated = numbered.join(kept, ["project_id", "_number"]).where("relative_path <> _kept")

    keyed = entries.select("project_id", "relative_path", collision_key(path).alias("_key"))
    first = keyed.groupBy("project_id", "_key").agg(F.min("relative_path").alias("_kept"))
    clashing = keyed.join(first, ["project_id", "_key"]).where("relative_path <> _kept")

    def issues(rows: DataFrame, code: str) -> DataFrame:
        return rows.select("project_id", "relative_path", F.lit(code).alias("code"), F.lit("fatal").alias("severity"))

    return single.unionByName(issues(repeated, "duplicateChapterNumber")).unionByName(
        issues(clashing, "nameCollision")
    )


def missing_paths(entries: DataFrame) -> DataFrame:
    """Required folders (fatal) and optional ones (warning) each project lacks."""
    rows = [(p, "missingRequiredDirectory", "fatal") for p in REQUIRED_FOLDERS]
    rows += [(p, "missingOptionalDirectory", "warning") for p in OPTIONAL_PATHS]
    names = ("relative_path", "code", "severity")
    wanted = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])
    expected = entries.select("project_id").distinct().select("project_id", F.inline(wanted))
    present = entries.where(F.col("relative_path").isin([r[0] for r in rows])).select(
        "project_id", "relative_path"
    )
    return expected.join(present, ["project_id", "relative_path"], "left_anti")


def node_table(entries: DataFrame) -> DataFrame:
    """Nodes of an import: parent by path, order among siblings.

    ``entries``: ``id, project_id, relative_path, kind``. Siblings are ordered
    folders first, then by name; a missing parent leaves ``parent_id`` null.
    """
    path = F.col("relative_path")
    shaped = entries.withColumns(
        {
            "_parent": parent_path(path),
            "_is_file": F.col("kind") != "folder",
            "name": stored_name(path),
            "depth": path_depth(path),
        }
    )
    parents = entries.where("kind = 'folder'").select(
        F.col("project_id"), F.col("relative_path").alias("_parent"), F.col("id").alias("parent_id")
    )
    joined = shaped.join(parents, ["project_id", "_parent"], "left")
    numbered = with_row_number(
        joined, ["project_id", "_parent"], ["_is_file", "name", "relative_path"], "_n"
    )
    return numbered.select(
        "id", "project_id", "relative_path", "kind", "parent_id", "name", "depth", (F.col("_n") - 1).alias("user_order")
    )


def audit_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Malformed identifiers over several columns, one row per bad value."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    bad = F.filter(pairs, lambda p: p["value"].isNotNull() & ~is_canonical_uuid(p["value"]))
    return df.select(F.explode(bad).alias("b")).select("b.column_name", "b.value")


def audit_references(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Values of a column that name no row of the target table."""
    wanted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    return wanted.join(target.select(F.col(key).alias(column)), column, "left_anti").select(
        F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"), "rows"
    )
