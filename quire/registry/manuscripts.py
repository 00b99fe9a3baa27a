"""Queries on chapters and import trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.aggregates import issue_counts
from quire.operators.ordering import issues_first_fatal
from quire.plans import imports as I, manuscript as M
from quire.registry.core import register
from quire.registry.roles import CHAPTERS_SQL, NODE_PATHS_SQL, chapters, table
from quire.session import shared_folder
from quire.sources.sinks import read_manuscript_files, write_manuscript_parts

_CHAPTERS = f"WITH {CHAPTERS_SQL.strip()}"


def _chapters(spark, folder):
    return M.manuscript_chapters(chapters(spark, folder).drop("number"))


@register("assembled_manuscripts", _CHAPTERS + """,
stops AS (SELECT project_id, min(number) AS s FROM chapters WHERE length_grapheme(text) < 300 GROUP BY project_id),
chosen AS (SELECT c.*, lpad(CAST(number AS VARCHAR), 3, '0') || '화' AS prefix FROM chapters c LEFT JOIN stops USING (project_id)
  WHERE (s IS NULL OR number < s) AND text <> '')
SELECT project_id, min(number) AS first_number, max(number) AS last_number, count(*) AS chapters,
  sha256(string_agg(prefix || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY number)) AS content_hash,
  project_id || '(' || min(number) || '~' || max(number) || '화).txt' AS file_name
FROM chosen GROUP BY project_id""")
def assembled_manuscripts(spark, folder):
    out = M.assemble(_chapters(spark, folder), titles=True, stop_short=True, skip_empty=True)
    return out.select(
        "project_id", "first_number", "last_number", "chapters",
        F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "file_name",
    )


@register("manuscript_parts", _CHAPTERS + """,
firsts AS (SELECT project_id, min(number) AS f FROM chapters GROUP BY project_id)
SELECT project_id, number, sha256(CASE WHEN number > f THEN chr(10) || chr(10) ELSE '' END || text) AS part_hash
FROM chapters JOIN firsts USING (project_id)""")
def manuscript_parts(spark, folder):
    parts = M.assemble_parts(_chapters(spark, folder))
    return parts.select("project_id", "number", F.sha2(F.col("part").cast("binary"), 256).alias("part_hash"))


@register("written_manuscripts", _CHAPTERS + """,
clash AS (SELECT DISTINCT project_id FROM (SELECT project_id FROM chapters GROUP BY project_id, number HAVING count(*) > 1)),
kept AS (SELECT *, lpad(CAST(number AS VARCHAR), 3, '0') || '화' AS prefix FROM chapters WHERE project_id NOT IN (SELECT project_id FROM clash) AND text <> '')
SELECT project_id || '(' || min(number) || '~' || max(number) || '화).txt' AS file_name,
  sha256(string_agg(prefix || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY number) || chr(10)) AS content_hash
FROM kept GROUP BY project_id""")
def written_manuscripts(spark, folder):
    # written by ranges of chapters, read back, each manuscript's files one after the other
    path = shared_folder(spark)
    write_manuscript_parts(M.manuscript_rows(_chapters(spark, folder), titles=True, skip_empty=True), path)
    files = read_manuscript_files(spark, path).groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("file", "content"))).alias("files"))
    whole = F.array_join(F.col("files.content"), "")
    return files.select("file_name", F.sha2(whole.cast("binary"), 256).alias("content_hash"))


@register("missing_chapters", _CHAPTERS + """
SELECT p.project_id, CAST(n AS BIGINT) AS number FROM (SELECT DISTINCT project_id FROM chapters) p, range(1, 11) r(n)
WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.project_id = p.project_id AND c.number = n)""")
def missing_chapters(spark, folder):
    return M.missing_chapters(_chapters(spark, folder), 1, 10)


@register("chapter_report", _CHAPTERS + """
SELECT project_id, count(*) AS chapters, min(number) AS first_number, max(number) AS last_number,
  count(*) FILTER (WHERE text = '') AS empty_chapters, min(number) FILTER (WHERE length_grapheme(text) < 300) AS first_short
FROM chapters GROUP BY project_id""")
def chapter_report(spark, folder):
    return M.chapter_report(_chapters(spark, folder))


_VOLUMES_SQL = """WITH chapters AS (SELECT o_custkey AS project_id, CAST(floor(o_totalprice / 100000) AS BIGINT) + 1 AS volume,
  CAST(floor(o_totalprice / 4000) AS BIGINT) + 1 AS number FROM orders)"""


def _volumes(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("project_id"),
        (F.floor(price / 100000) + 1).alias("volume"),
        (F.floor(price / 4000) + 1).alias("number"),
    )


@register("volume_coverage", _VOLUMES_SQL + """,
nexts AS (SELECT project_id, max(volume) + 1 AS next_volume FROM chapters GROUP BY project_id),
expected AS (SELECT project_id, next_volume, (next_volume - 1) * 25 + i AS number FROM nexts, range(1, 26) r(i)),
present AS (SELECT DISTINCT project_id, number FROM chapters)
SELECT e.project_id, next_volume, e.number, p.number IS NOT NULL AS taken FROM expected e LEFT JOIN present p USING (project_id, number)""")
def volume_coverage(spark, folder):
    return M.volume_coverage(_volumes(spark, folder))


@register("missing_in_volumes", _VOLUMES_SQL + """,
expected AS (SELECT DISTINCT project_id, volume, (volume - 1) * 25 + i AS number FROM chapters, range(1, 26) r(i))
SELECT project_id, volume, number FROM expected e WHERE NOT EXISTS
  (SELECT 1 FROM chapters c WHERE c.project_id = e.project_id AND c.number = e.number)""")
def missing_in_volumes(spark, folder):
    return M.missing_in_volumes(_volumes(spark, folder))


_ENTRIES_SQL = """entries AS (
  SELECT 'p' || c_nationkey AS project_id, c_custkey AS id, c_acctbal < 9000 AS valid_utf8,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'folder' WHEN 'BUILDING' THEN CASE WHEN c_acctbal > 8000 THEN 'link' ELSE 'file' END ELSE 'file' END AS kind,
    CASE c_mktsegment
      WHEN 'AUTOMOBILE' THEN CASE WHEN c_acctbal < 0 THEN '메인/원고/' || c_custkey || CASE WHEN c_acctbal < -500 THEN '권' ELSE 'x' END
        WHEN c_acctbal < 1000 THEN '메인/플롯' WHEN c_acctbal < 2000 THEN 'Folder' || c_custkey WHEN c_acctbal < 3000 THEN '메인/원고/1권/' || c_custkey
        ELSE '백업/' || c_custkey END
      WHEN 'BUILDING' THEN '메인/' || c_custkey || '.txt'
      WHEN 'MACHINERY' THEN '메인/원고/1권/' || lpad(CAST(CAST(floor(abs(c_acctbal) / 20) AS BIGINT) + 1 AS VARCHAR), 3, '0') || '화 ' || c_custkey || '.txt'
      WHEN 'FURNITURE' THEN '메인/설정집/' || CASE WHEN c_acctbal > 5000 THEN '.' ELSE '' END || c_custkey || CASE WHEN c_acctbal < 0 THEN '.png' ELSE '.TXT' END
      ELSE '메인/원고/' || c_custkey || '.txt' END AS relative_path
  FROM customer)"""


def _entries(spark, folder):
    key, balance, segment = F.col("c_custkey").cast("string"), F.col("c_acctbal"), F.col("c_mktsegment")

    def path(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    folders = (
        F.when(balance < 0, path("메인/원고/", key, F.when(balance < -500, "권").otherwise("x")))
        .when(balance < 1000, F.lit("메인/플롯"))
        .when(balance < 2000, path("Folder", key))
        .when(balance < 3000, path("메인/원고/1권/", key))
        .otherwise(path("백업/", key))
    )
    number = F.lpad((F.floor(F.abs(balance) / 20) + 1).cast("string"), 3, "0")
    return table(spark, folder, "customer").select(
        path("p", F.col("c_nationkey").cast("string")).alias("project_id"),
        F.col("c_custkey").alias("id"),
        (balance < 9000).alias("valid_utf8"),
        F.when(segment == "AUTOMOBILE", "folder")
        .when((segment == "BUILDING") & (balance > 8000), "link")
        .otherwise("file")
        .alias("kind"),
        F.when(segment == "AUTOMOBILE", folders)
        .when(segment == "BUILDING", path("메인/", key, ".txt"))
        .when(segment == "MACHINERY", path("메인/원고/1권/", number, "화 ", key, ".txt"))
        .when(
            segment == "FURNITURE",
            path("메인/설정집/", F.when(balance > 5000, ".").otherwise(""), key, F.when(balance < 0, ".png").otherwise(".TXT")),
        )
        .otherwise(path("메인/원고/", key, ".txt"))
        .alias("relative_path"),
    )


_AUDIT_SQL = f"WITH {_ENTRIES_SQL}" + r""",
shaped AS (SELECT *, string_split(relative_path, '/') AS p, len(string_split(relative_path, '/')) AS depth,
  ends_with(lower(relative_path), '.txt') AS is_text FROM entries),
ruled AS (SELECT *, depth >= 2 AND p[1] = '메인' AND p[2] = '원고' AS ms, kind = 'file' AND depth = 2 AND p[1] = '메인' AS at_top,
  coalesce(depth = 4 AND regexp_full_match(p[3], '[1-9][0-9]*권')
    AND regexp_matches(p[4], '^([0-9]{3}|[1-9][0-9]{3,})화.*\.txt$'), false) AS chapter_ok,
  CASE WHEN depth = 4 THEN TRY_CAST(regexp_extract(p[4], '^[0-9]+') AS BIGINT) END AS number FROM shaped),
issues AS (
  SELECT project_id, relative_path, 'symbolicLink' AS code, 'fatal' AS severity FROM ruled WHERE kind = 'link'
  UNION ALL SELECT project_id, relative_path, 'hiddenItem', 'warning' FROM ruled WHERE kind <> 'link' AND starts_with(p[depth], '.')
  UNION ALL SELECT project_id, relative_path, 'legacyPlot', 'warning' FROM ruled WHERE kind = 'folder' AND relative_path = '메인/플롯'
  UNION ALL SELECT project_id, relative_path, 'unknownItem', 'warning' FROM ruled WHERE kind = 'folder' AND depth = 1 AND relative_path NOT IN ('메인', '백업', '메인 스토리 틀')
  UNION ALL SELECT project_id, relative_path, 'invalidVolumeName', 'fatal' FROM ruled WHERE kind = 'folder' AND ms AND depth = 3 AND NOT regexp_full_match(p[3], '[1-9][0-9]*권')
  UNION ALL SELECT project_id, relative_path, 'invalidChapterName', 'fatal' FROM ruled WHERE kind = 'folder' AND ms AND depth > 3
  UNION ALL SELECT project_id, relative_path, 'documentAtTopLevel', 'fatal' FROM ruled WHERE at_top
  UNION ALL SELECT project_id, relative_path, 'invalidUTF8', 'fatal' FROM ruled WHERE kind = 'file' AND NOT at_top AND is_text AND NOT valid_utf8
  UNION ALL SELECT project_id, relative_path, 'invalidChapterName', 'fatal' FROM ruled WHERE kind = 'file' AND NOT at_top AND ms AND NOT chapter_ok
  UNION ALL SELECT project_id, relative_path, 'unknownItem', 'warning' FROM ruled WHERE kind = 'file' AND NOT at_top AND NOT ms AND NOT is_text
  UNION ALL SELECT project_id, relative_path, 'duplicateChapterNumber', 'fatal' FROM (
    SELECT *, min(relative_path) OVER (PARTITION BY project_id, number) AS kept FROM ruled
    WHERE kind = 'file' AND NOT at_top AND ms AND chapter_ok) WHERE relative_path <> kept
  UNION ALL SELECT project_id, relative_path, 'nameCollision', 'fatal' FROM (
    SELECT *, min(relative_path) OVER (PARTITION BY project_id, lower(relative_path)) AS kept FROM ruled) WHERE relative_path <> kept)"""


@register("import_issues", _AUDIT_SQL + " SELECT * FROM issues")
def import_issues(spark, folder):
    return issues_first_fatal(I.audit_tree(_entries(spark, folder)))


@register("import_issue_counts", _AUDIT_SQL + " SELECT code, count(*) AS issues FROM issues GROUP BY code")
def import_issue_counts(spark, folder):
    return issue_counts(I.audit_tree(_entries(spark, folder)))


_MISSING_VALUES = ", ".join(
    [f"('{p}', 'missingRequiredDirectory', 'fatal')" for p in I.REQUIRED_FOLDERS]
    + [f"('{p}', 'missingOptionalDirectory', 'warning')" for p in I.OPTIONAL_PATHS]
)


@register("missing_paths", f"""WITH {_ENTRIES_SQL},
spread AS (SELECT project_id, relative_path FROM entries UNION SELECT project_id, regexp_replace(relative_path, '/[^/]*$', '') FROM entries
  UNION SELECT project_id, split_part(relative_path, '/', 1) FROM entries
  UNION SELECT project_id, array_to_string(string_split(relative_path, '/')[1:2], '/') FROM entries),
wanted(relative_path, code, severity) AS (VALUES {_MISSING_VALUES})
SELECT p.project_id, w.relative_path, w.code, w.severity FROM (SELECT DISTINCT project_id FROM entries) p, wanted w
WHERE NOT EXISTS (SELECT 1 FROM spread s WHERE s.project_id = p.project_id AND s.relative_path = w.relative_path)""")
def missing_paths(spark, folder):
    from quire.functions.names import ancestor_paths

    path = F.col("relative_path")
    spread = _entries(spark, folder).select(
        "project_id", F.explode(F.array_append(ancestor_paths(path), path)).alias("relative_path")
    )
    return I.missing_paths(spread)


@register("import_nodes", f"""WITH {NODE_PATHS_SQL},
shaped AS (SELECT id, path, kind, name, depth, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent FROM node_paths),
folders AS (SELECT id, path FROM shaped WHERE kind = 'folder')
SELECT s.id, f.id AS parent_id, s.depth,
  row_number() OVER (PARTITION BY s.parent ORDER BY s.kind <> 'folder', s.name, s.path) - 1 AS user_order
FROM shaped s LEFT JOIN folders f ON s.parent = f.path""")
def import_nodes(spark, folder):
    from quire.registry.hierarchy import _with_paths

    entries = _with_paths(spark, folder).select("id", F.lit(1).alias("project_id"), "relative_path", "kind")
    return I.node_table(entries).select("id", "parent_id", "depth", "user_order")


@register("malformed_ids", r"""
WITH ids AS (SELECT doc_id, md5(text) AS h FROM documents),
pairs AS (SELECT 'plain_id' AS column_name, h AS value FROM ids
  UNION ALL SELECT 'dashed_id', substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) FROM ids
  UNION ALL SELECT 'upper_id', upper(h) FROM ids)
SELECT column_name, value FROM pairs WHERE NOT regexp_full_match(value, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')""")
def malformed_ids(spark, folder):
    h = F.md5("text")
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    ids = table(spark, folder, "documents").select(h.alias("plain_id"), dashed.alias("dashed_id"), F.upper(h).alias("upper_id"))
    return I.audit_ids(ids, ["plain_id", "dashed_id", "upper_id"])


@register("dangling_references", """
SELECT 'l_partkey' AS column_name, CAST(l_partkey AS VARCHAR) AS value, count(*) AS rows FROM lineitem
WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY l_partkey""")
def dangling_references(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey")
    return I.audit_references(lines, "l_partkey", table(spark, folder, "supplier"), "s_suppkey")
