"""Sort orders of lists and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.names import (
    CUSTOM_ORDER_OFFSET,
    chapter_number,
    path_depth,
    volume_number,
)

# The fixed folders below the top container and their shown names, in order.
FIXED_CATEGORIES = [
    ("manuscript", "메인/원고", "원고"),
    ("characters", "메인/캐릭터", "캐릭터"),
    ("settings", "메인/설정집", "설정집"),
    ("notes", "메인/메모장", "메모장"),
    ("storyPlot", "메인/스토리 플롯", "스토리 플롯"),
    ("flow", "메인/흐름정리", "흐름 정리"),
    ("foreshadowing", "메인/복선", "복선"),
    ("places", "메인/장소", "장소"),
    ("trash", "메인/휴지통", "휴지통"),
]


def fixed_categories(spark: SparkSession) -> DataFrame:
    """The nine fixed folders as a lookup table."""
    rows = [(*row, order) for order, row in enumerate(FIXED_CATEGORIES)]
    return spark.createDataFrame(
        rows, "category string, relative_path string, category_label string, fixed_order bigint"
    )


def with_category(nodes: DataFrame) -> DataFrame:
    """Nodes with their fixed category, if their path is one."""
    return nodes.join(F.broadcast(fixed_categories(nodes.sparkSession)), "relative_path", "left")


def natural_key(name: Column) -> Column:
    """Numbered names first by number, then the others by Unicode order."""
    number = F.coalesce(volume_number(name), chapter_number(name))
    return F.struct(number.isNull().alias("unnumbered"), number.alias("number"))


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """Volumes and chapters by number, other names after them.

    Names compare under the ICU root collation. Keys are columns of their own,
    since a sort evaluates an expression at every comparison.
    """
    keyed = df.withColumns({"_natural": natural_key(F.col(name)), "_collated": F.collate(F.col(name), "UNICODE")})
    return keyed.orderBy("_natural", "_collated", name).drop("_natural", "_collated")


def binder_order(df: DataFrame) -> DataFrame:
    """Root items: manuscript, hand-ordered, fixed, others, trash.

    ``category`` is null, ``manuscript``, ``trash`` or another fixed name
    whose place is ``fixed_order``.
    """
    category, order = F.col("category"), F.col("user_order")
    band = (
        F.when(category == "manuscript", 0)
        .when(category == "trash", 4)
        .when(order >= CUSTOM_ORDER_OFFSET, 1)
        .when(category.isNotNull(), 2)
        .otherwise(3)
    )
    inner = F.when(band == 2, F.col("fixed_order")).otherwise(order)
    keyed = df.withColumns(
        {"band": band.cast("long"), "_inner": inner, "_collated": F.collate(F.col("display_name"), "UNICODE")}
    )
    return keyed.orderBy("band", "_inner", "_collated", "display_name").drop("_inner", "_collated")


def plan_order(actions: DataFrame) -> DataFrame:
    """Moves and creates shallow first, deletes deep first, conflicts last."""
    action = F.col("action")
    rank = (
        F.when(action == "move", 0).when(action == "create", 1).when(action == "delete", 2).otherwise(3)
    )
    depth = F.coalesce(path_depth(F.col("path")), F.lit(0))
    signed = F.when(rank == 2, -depth).when(rank == 3, 0).otherwise(depth)
    return actions.withColumns({"rank": rank.cast("long"), "sort_depth": signed}).orderBy(
        "rank", "sort_depth", "folder_id"
    )


def trashed_projects(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("trashed_at").isNotNull()).orderBy(
        F.col("trashed_at").desc(), "name", "project_id"
    )


def issues_first_fatal(issues: DataFrame) -> DataFrame:
    fatal = F.when(F.col("severity") == "fatal", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.withColumn("_rank", fatal).orderBy("_rank", "relative_path", "code").drop("_rank")
