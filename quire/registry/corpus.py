"""Queries on the text corpus: search, digests, statistics, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N, text as T
from quire.functions.digests import byte_count, content_sha256
from quire.plans import search as S
from quire.registry.core import register
from quire.registry.roles import CORPUS_SQL, corpus, documents, table

_SEARCHABLE_SQL = f"""WITH {CORPUS_SQL.strip()},
live AS (SELECT * FROM corpus WHERE NOT is_deleted
  AND NOT list_has_any(string_split(relative_path, '/'), ['휴지통', '백업']))"""


@register("searchable_documents", _SEARCHABLE_SQL + """
SELECT document_id, project_id, relative_path FROM live""")
def searchable_documents(spark, folder):
    return S.searchable(corpus(spark, folder)).select("document_id", "project_id", "relative_path")


_HITS_SQL = """,
pieces AS (
  SELECT project_id, document_id, relative_path, string_split(lower(text), 'the') AS parts, text FROM live),
hits AS (
  SELECT project_id, document_id, relative_path, text, unnest(range(len(parts) - 1)) AS hit, parts FROM pieces),
located AS (
  SELECT *, CAST(list_sum(list_transform(parts[1:hit + 1], lambda p: length(p))) + 3 * hit AS BIGINT) AS cp
  FROM hits)"""


@register("search_hits", _SEARCHABLE_SQL + _HITS_SQL + """
SELECT project_id, document_id, relative_path, CAST(hit AS BIGINT) AS hit, cp AS cp_location,
  CAST(cp + len(regexp_extract_all(left(text, cp), '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS utf16_location,
  CAST(3 AS BIGINT) AS utf16_length
FROM located""")
def search_hits(spark, folder):
    return S.search(S.searchable(corpus(spark, folder)), "the")


@register("search_excerpts", _SEARCHABLE_SQL + _HITS_SQL + """,
around AS (
  SELECT document_id, CAST(hit AS BIGINT) AS hit, cp, text, length(text) AS n,
    substr(text, CAST(greatest(cp - 80, 0) + 1 AS BIGINT), CAST(least(cp, 80) AS BIGINT)) AS before,
    substr(text, cp + 1, 3) AS body, substr(text, cp + 4, 80) AS after
  FROM located),
cut AS (
  SELECT *, regexp_replace(before, '^.*[.!?\\n\\r。！？]', '', 's') AS pre,
    CASE WHEN regexp_matches(after, '[.!?\\n\\r。！？]')
      THEN regexp_extract(after, '^[^.!?\\n\\r。！？]*[.!?\\n\\r。！？]') ELSE after END AS post
  FROM around)
SELECT document_id, hit,
  CASE WHEN length(pre) < cp THEN '…' ELSE '' END || pre || body || post
    || CASE WHEN cp + 3 + length(post) < n THEN '…' ELSE '' END AS preview,
  CAST(length(pre) + CASE WHEN length(pre) < cp THEN 1 ELSE 0 END AS BIGINT) AS preview_offset
FROM cut""")
def search_excerpts(spark, folder):
    hits = S.search(S.searchable(corpus(spark, folder)), "the", excerpts=True)
    return hits.select("document_id", "hit", "preview", "preview_offset")


@register("search_report", _SEARCHABLE_SQL + """
SELECT count(*) AS total_documents, count(text) AS searched_documents,
  CAST(sum(len(string_split(lower(text), 'the')) - 1) AS BIGINT) AS hits,
  count(*) FILTER (WHERE contains(lower(text), 'the')) AS documents_with_hits, count(*) FILTER (WHERE text IS NULL) AS read_issues
FROM live""")
def search_report(spark, folder):
    return S.search_report(S.searchable(corpus(spark, folder)), "the")


@register("search_overlay", f"""WITH {CORPUS_SQL.strip()},
drafts AS (SELECT item_id AS document_id, text FROM benchmark)
SELECT c.document_id, CAST(len(string_split(lower(coalesce(d.text, c.text)), 'the')) - 1 AS BIGINT) AS hits
FROM corpus c LEFT JOIN drafts d ON c.document_id = d.document_id""")
def search_overlay(spark, folder):
    drafts = table(spark, folder, "benchmark").select(F.col("item_id").alias("document_id"), "text")
    pieces = F.split("text", T.literal_pattern("the"), -1)
    return S.overlay(corpus(spark, folder), drafts).select(
        "document_id", (F.size(pieces) - 1).cast("long").alias("hits")
    )


@register("content_digests", """
SELECT doc_id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS bytes,
  CASE WHEN strlen(text) > 10485760 THEN 'CONTENT_TOO_LARGE'
       WHEN length(text) <> n_chars THEN 'SIZE_MISMATCH' END AS problem
FROM documents""")
def content_digests(spark, folder):
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id",
        content_sha256(text).alias("content_hash"),
        byte_count(text).alias("bytes"),
        N.first_of(
            (byte_count(text) > 10 * 1024 * 1024, "CONTENT_TOO_LARGE"),
            (F.length(text) != F.col("n_chars"), "SIZE_MISMATCH"),
        ).alias("problem"),
    )


@register("character_stats", """
SELECT lang, count(*) AS documents, CAST(sum(length_grapheme(text)) AS BIGINT) AS characters,
  CAST(max(length_grapheme(text)) AS BIGINT) AS longest, count(*) FILTER (WHERE length_grapheme(text) < 300) AS short_documents
FROM documents GROUP BY lang""")
def character_stats(spark, folder):
    sized = documents(spark, folder).select("lang", T.grapheme_count(F.col("text")).alias("n"))
    return sized.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.sum("n").alias("characters"),
        F.max("n").alias("longest"),
        F.count_if(F.col("n") < 300).alias("short_documents"),
    )


@register("typography_rewrite", r"""
WITH t AS (SELECT doc_id, text,
  regexp_replace(replace(replace(replace(text, '...', '⋯'), 'ㄴㄴ', '「」'), 'ㄱㄱ', '『』'),
    '(?m)^\*$', chr(10) || chr(10) || ' * * *' || chr(10) || chr(10), 'g') AS rewritten FROM documents)
SELECT doc_id, sha256(rewritten) AS rewritten_hash,
  CAST(len(regexp_extract_all(text, '\.\.\.')) AS BIGINT) AS ellipses,
  CAST(len(regexp_extract_all(text, 'ㄴㄴ|ㄱㄱ')) AS BIGINT) AS quotes,
  CAST(len(regexp_extract_all(text, '(?m)^\*$')) AS BIGINT) AS scene_breaks,
  CAST((length(text) - length(replace(text, '''', ''))) % 2 + (length(text) - length(replace(text, '"', ''))) % 2
   + (length(replace(text, '[', '')) <> length(replace(text, ']', '')))::INT
   + (length(replace(text, '(', '')) <> length(replace(text, ')', '')))::INT
   + (length(replace(text, '{', '')) <> length(replace(text, '}', '')))::INT
   + (length(replace(text, '「', '')) <> length(replace(text, '」', '')))::INT
   + (length(replace(text, '『', '')) <> length(replace(text, '』', '')))::INT AS BIGINT) AS unmatched
FROM t""")
def typography_rewrite(spark, folder):
    text = F.col("text")
    counts = [c.alias(n) for n, c in T.typography_counts(text).items()]
    return documents(spark, folder).select(
        "doc_id",
        content_sha256(T.rewrite_typography(text)).alias("rewritten_hash"),
        *counts,
        T.unmatched_brackets(text).alias("unmatched"),
    )
