"""Queries on the naming rules: entry names, paths, locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions.digests import is_canonical_uuid, uuid5
from quire.functions.unicode import nfc
from quire.registry.core import register
from quire.registry.roles import CHAPTERS_SQL, CORPUS_SQL, chapters, corpus, documents, table

_DEVICES = "[" + ", ".join(f"'{d}'" for d in N.DEVICE_NAMES) + "]"


def _urls(spark, folder):
    return table(spark, folder, "pages").select("page_id", "url")


@register("path_validity", r"""
SELECT page_id, url <> '' AND url = trim(url) AND length(url) <= 1024
    AND NOT regexp_matches(url, '(^/|\\|//|(^|/)\.{1,2}(/|$)|/$)') AS whole_url,
  substr(url, strpos(url, '//') + 2) <> '' AND NOT regexp_matches(substr(url, strpos(url, '//') + 2),
    '(^/|\\|//|(^|/)\.{1,2}(/|$)|/$)') AS without_scheme
FROM pages""")
def path_validity(spark, folder):
    bare = F.expr("substr(url, instr(url, '//') + 2)")
    return _urls(spark, folder).select(
        "page_id",
        N.valid_relative_path(F.col("url")).alias("whole_url"),
        N.valid_relative_path(bare).alias("without_scheme"),
    )


_LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS name FROM documents)"


def _lines(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.explode(F.split("text", "\n", -1)).alias("name")
    )


@register("entry_name_validity", f"""WITH {_LINES_SQL},
checked AS (SELECT doc_id, name <> '' AND name = trim(name, ' ') AND length(name) <= 255 AND right(name, 1) <> '.'
    AND NOT regexp_matches(name, '[<>:"/\\\\|?*]') AND NOT regexp_matches(name, '[\\x00-\\x1F\\x7F]')
    AND NOT list_contains({_DEVICES}, upper(split_part(name, '.', 1))) AS ok,
    name <> '' AND length(name) <= 1024 AND NOT regexp_matches(name, '[/\\\\]') AS folder_ok FROM lines)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE ok) AS entry_names, count(*) FILTER (WHERE folder_ok) AS folder_names
FROM checked GROUP BY doc_id""")
def entry_name_validity(spark, folder):
    name = F.col("name")
    checked = _lines(spark, folder).select(
        "doc_id", N.valid_entry_name(name).alias("ok"), N.valid_folder_name(name).alias("folder_ok")
    )
    return checked.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.count_if("ok").alias("entry_names"),
        F.count_if("folder_ok").alias("folder_names"),
    )


@register("name_violations", f"""WITH {_LINES_SQL},
normal AS (SELECT doc_id, nfc_normalize(name) AS n FROM lines),
first_bad AS (SELECT doc_id, n, regexp_extract(n, '([\\p{{Cc}}\\p{{Cf}}<>:"/\\\\|?*])', 1) AS bad FROM normal),
coded AS (SELECT doc_id, CASE WHEN n = '' THEN 'empty' WHEN n IN ('.', '..') THEN 'dotSegment'
    WHEN regexp_matches(bad, '[\\p{{Cc}}\\p{{Cf}}]') THEN 'controlCharacter'
    WHEN bad <> '' THEN 'forbiddenCharacter' WHEN right(n, 1) IN (' ', '.') THEN 'trailingSpaceOrPeriod'
    WHEN list_contains({_DEVICES}, upper(trim(split_part(n, '.', 1), ' .'))) THEN 'reservedName'
    WHEN length(n) + len(regexp_extract_all(n, '[\\x{{10000}}-\\x{{10FFFF}}]')) > 255 THEN 'nameTooLong' END AS code
  FROM first_bad)
SELECT code, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM coded GROUP BY code""")
def name_violations(spark, folder):
    normal = _lines(spark, folder).withColumn("name", nfc(F.col("name")))
    coded = normal.select("doc_id", N.name_violation(F.col("name")).alias("code"))
    # per document first, so that the distinct count shuffles pairs and not lines
    pairs = coded.groupBy("code", "doc_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("code").agg(F.sum("n").alias("lines"), F.count("*").alias("documents"))


@register("path_violations", f"""
WITH paths AS (SELECT page_id, nfc_normalize(replace(url, 'http', '')) AS p FROM pages),
coded AS (SELECT page_id, p, list_filter(list_transform(string_split(p, '/'), lambda c:
    CASE WHEN c = '' THEN 'empty' WHEN c IN ('.', '..') THEN 'dotSegment'
      WHEN regexp_matches(regexp_extract(c, '([\\p{{Cc}}\\p{{Cf}}<>:"/\\\\|?*])', 1), '[\\p{{Cc}}\\p{{Cf}}]') THEN 'controlCharacter'
      WHEN regexp_extract(c, '([\\p{{Cc}}\\p{{Cf}}<>:"/\\\\|?*])', 1) <> '' THEN 'forbiddenCharacter'
      WHEN right(c, 1) IN (' ', '.') THEN 'trailingSpaceOrPeriod'
      WHEN list_contains({_DEVICES}, upper(trim(split_part(c, '.', 1), ' .'))) THEN 'reservedName'
      WHEN length(c) > 255 THEN 'nameTooLong' END), lambda x: x IS NOT NULL) AS codes FROM paths)
SELECT page_id, CASE WHEN p = '' THEN 'empty' WHEN regexp_matches(p, '^(/|~/|\\\\|\\p{{L}}:)') THEN 'absolutePath'
  WHEN length(p) > 1024 THEN 'pathTooLong' ELSE codes[1] END AS code FROM coded""")
def path_violations(spark, folder):
    path = nfc(F.replace(F.col("url"), F.lit("http"), F.lit("")))
    cleaned = _urls(spark, folder).select("page_id", path.alias("path"))
    return cleaned.select("page_id", N.path_violation(F.col("path")).alias("code"))


_VARIED_SQL = f"""WITH {CHAPTERS_SQL.strip()},
varied AS (SELECT document_id, CASE WHEN number = 2 THEN '메인/원고/' || project_id || '권'
  WHEN number = 3 THEN '메인/원고' WHEN number = 4 THEN '메인/설정/' || number
  WHEN number = 5 THEN replace(relative_path, '/0', '/') ELSE relative_path END AS relative_path FROM chapters)"""


def _varied(spark, folder):
    number, path = F.col("number"), F.col("relative_path")
    text = F.concat(F.lit("메인/원고/"), F.col("project_id").cast("string"), F.lit("권"))
    return chapters(spark, folder).select(
        "document_id",
        F.when(number == 2, text)
        .when(number == 3, "메인/원고")
        .when(number == 4, F.concat(F.lit("메인/설정/"), number.cast("string")))
        .when(number == 5, F.replace(path, F.lit("/0"), F.lit("/")))
        .otherwise(path)
        .alias("relative_path"),
    )


@register("locations", _VARIED_SQL + r""",
parts AS (SELECT document_id, string_split(relative_path, '/') AS p FROM varied),
parsed AS (SELECT document_id, len(p) AS depth, p[1] = '메인' AND p[2] = '원고' AS inside,
  CASE WHEN regexp_full_match(p[3], '[1-9][0-9]*권') THEN CAST(regexp_extract(p[3], '^[0-9]+') AS BIGINT) END AS vol,
  CASE WHEN regexp_matches(p[4], '^([0-9]{3}|[1-9][0-9]{3,})화.*\.txt$')
    THEN CAST(regexp_extract(p[4], '^[0-9]+') AS BIGINT) END AS ch FROM parts),
placed AS (SELECT *, CASE WHEN depth < 2 OR NOT inside THEN 'outside' WHEN depth = 2 THEN 'root' WHEN vol IS NULL THEN 'invalid'
  WHEN depth = 3 THEN 'volume' WHEN depth = 4 AND ch > 0 THEN 'chapter' ELSE 'invalid' END AS place FROM parsed)
SELECT document_id, place, CASE WHEN place IN ('volume', 'chapter') THEN vol END AS volume,
  CASE WHEN place = 'chapter' THEN ch END AS chapter FROM placed""")
def locations(spark, folder):
    return _varied(spark, folder).select("document_id", N.location(F.col("relative_path")).alias("at")).select(
        "document_id", "at.place", "at.volume", "at.chapter"
    )


@register("chapter_names", f"""WITH {CHAPTERS_SQL.strip()},
names AS (SELECT document_id, list_last(string_split(relative_path, '/')) AS name FROM chapters)
SELECT document_id, CAST(left(name, 3) AS BIGINT) AS number, left(name, 4) AS prefix, substr(name, 5, length(name) - 8) AS title
FROM names""")
def chapter_names(spark, folder):
    name = N.stored_name(F.col("relative_path"))
    return chapters(spark, folder).select(
        "document_id",
        N.chapter_number(name).alias("number"),
        N.chapter_prefix(name).alias("prefix"),
        N.chapter_title(name).alias("title"),
    )


@register("display_columns", f"""WITH {CORPUS_SQL.strip()}
SELECT document_id, regexp_replace(list_last(string_split(relative_path, '/')), '(?i)\\.txt$', '') AS display_name,
  CASE WHEN strlen(text) = 0 THEN 'empty' ELSE 'written' END AS state FROM corpus""")
def display_columns(spark, folder):
    return corpus(spark, folder).select(
        "document_id",
        N.display_name(N.stored_name(F.col("relative_path"))).alias("display_name"),
        N.content_state(F.lit("text"), F.octet_length("text")).alias("state"),
    )


@register("path_columns", f"""WITH {CORPUS_SQL.strip()}
SELECT document_id, regexp_replace(relative_path, '/[^/]*$', '') AS parent_path,
  list_last(string_split(relative_path, '/')) AS stored_name, len(string_split(relative_path, '/')) AS depth FROM corpus""")
def path_columns(spark, folder):
    path = F.col("relative_path")
    return corpus(spark, folder).select(
        "document_id",
        N.parent_path(path).alias("parent_path"),
        N.stored_name(path).alias("stored_name"),
        N.path_depth(path).alias("depth"),
    )


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def uuid5_sql(name: str) -> str:
    """A version-5 identifier below the namespace, in SQL."""
    d = f"sha1(unhex(replace('{NAMESPACE}', '-', '')) || encode({name}))"
    variant = f"substr('89ab', (instr('0123456789abcdef', substr({d}, 17, 1)) - 1) % 4 + 1, 1)"
    return f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || {variant} || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"


@register("derived_ids", f"SELECT page_id, {uuid5_sql("'folder:' || url")} AS folder_id, true AS canonical FROM pages")
def derived_ids(spark, folder):
    derived = uuid5(NAMESPACE, F.concat(F.lit("folder:"), "url"))
    return _urls(spark, folder).select(
        "page_id", derived.alias("folder_id"), is_canonical_uuid(derived).alias("canonical")
    )
