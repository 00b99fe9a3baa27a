"""Queries that fold operations, issues and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import aggregates as A, relational as R
from quire.registry.core import register
from quire.registry.roles import (
    CORPUS_SQL,
    LEDGER_SQL,
    OPERATIONS_SQL,
    corpus,
    ledger,
    operations,
    table,
)


@register("duplicate_names", """
SELECT p_brand AS parent_id, lower(p_name) AS name_key, count(*) AS members FROM part
GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_names(spark, folder):
    parts = table(spark, folder, "part").select(
        F.col("p_brand").alias("parent_id"), F.lower("p_name").alias("name_key")
    )
    return A.duplicate_groups(parts, ["parent_id", "name_key"])


@register("merged_purges", f"""WITH {LEDGER_SQL.strip()}
SELECT document_id, max(revision) AS revision,
  arg_max(CASE WHEN byte_count > 10 THEN byte_count END, (created_at, arrival))
    FILTER (WHERE byte_count > 10) AS generation
FROM ledger GROUP BY document_id""")
def merged_purges(spark, folder):
    purges = ledger(spark, folder).select(
        "document_id",
        "revision",
        F.when(F.col("byte_count") > 10, F.col("byte_count")).alias("generation"),
        F.col("created_at").alias("recorded_at"),
        F.col("arrival").alias("purge_id"),
    )
    return A.merge_purges(purges)


@register("materialized_purges", f"""WITH {OPERATIONS_SQL.strip()},
docs AS (SELECT c_custkey AS document_id, c_acctbal < 0 AS is_deleted, CAST(floor(c_acctbal + 2000) AS BIGINT) AS rev
  FROM customer),
per AS (SELECT document_id, bool_or(status NOT IN ('completed', 'cancelled')) AS busy,
    max(base_revision + 1) FILTER (WHERE status = 'completed' AND operation_kind = 'delete') AS done
  FROM operations GROUP BY document_id),
best AS (SELECT d.document_id, coalesce(busy, false) AS busy,
    greatest(coalesce(done, 0), CASE WHEN is_deleted THEN rev ELSE 0 END) AS best
  FROM docs d LEFT JOIN per USING (document_id))
SELECT document_id, CASE WHEN NOT busy AND best > 0 THEN best END AS purge_revision FROM best""")
def materialized_purges(spark, folder):
    documents = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("document_id"),
        (F.col("c_acctbal") < 0).alias("is_deleted"),
        F.floor(F.col("c_acctbal") + 2000).cast("bigint").alias("server_revision"),
    )
    return A.materialize_purge(documents, operations(spark, folder))


@register("batch_status", f"""WITH {OPERATIONS_SQL.strip()}
SELECT batch_id, CASE WHEN bool_or(status IN ('conflict', 'blocked')) THEN 'attention'
    WHEN bool_or(status NOT IN ('completed', 'cancelled')) THEN 'ready' ELSE 'completed' END AS status,
  arg_min(error_code, queue_id) FILTER (WHERE error_code IS NOT NULL) AS first_error
FROM operations GROUP BY batch_id""")
def batch_status(spark, folder):
    return A.batch_status(operations(spark, folder))


@register("document_flags", f"""WITH {OPERATIONS_SQL.strip()}
SELECT document_id, bool_or(status NOT IN ('completed', 'cancelled')) AS has_unfinished,
  bool_or(status = 'conflict') AS has_conflict,
  arg_min(error_code, (created_at, queue_id)) FILTER (WHERE status = 'blocked') AS blocked_code,
  coalesce(bool_or(status = 'conflict' AND error_code = 'PATH_CONFLICT'), false) AS has_path_conflict
FROM operations GROUP BY document_id""")
def document_flags(spark, folder):
    return A.document_flags(operations(spark, folder))


_FINGERPRINT_SQL = """count(*) AS row_count,
  CAST(coalesce(sum(('0x' || substr(h, 1, 15))::BIGINT), 0) AS VARCHAR) AS low_sum,
  CAST(coalesce(sum(('0x' || substr(h, 18, 15))::BIGINT), 0) AS VARCHAR) AS high_sum"""


@register("table_fingerprint", f"""
WITH rows AS (SELECT md5(CAST(to_json({{'o_orderkey': o_orderkey, 'o_custkey': o_custkey,
  'o_orderstatus': o_orderstatus, 'o_totalprice': CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR),
  'o_orderdate': strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'o_orderpriority': o_orderpriority}}) AS VARCHAR)) AS h FROM orders)
SELECT {_FINGERPRINT_SQL} FROM rows""")
def table_fingerprint(spark, folder):
    shown = {
        "o_totalprice": F.col("o_totalprice").cast("decimal(15, 2)").cast("string"),
        "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
    }
    return A.table_fingerprint(table(spark, folder, "orders").withColumns(shown))


#: Columns of the shared tables: i whole number, d double, s text, t time, v vector. The first one is the project's key.
_COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:v label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}
_SHOWN_SQL = {
    "i": "CAST({0} AS VARCHAR)", "d": "CAST(CAST(floor({0} * 1000000) AS BIGINT) AS VARCHAR)", "s": "md5({0})",
    "t": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')", "v": "array_to_string(list_transform({0}, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)), ',')",
}


def _shown(name: str, kind: str) -> F.Column:
    column = F.col(name)
    if kind == "d":
        column = F.floor(column * 1_000_000)
    elif kind == "s":
        column = F.md5(column.cast("binary"))
    elif kind == "t":
        column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif kind == "v":
        column = F.array_join(F.transform(column, lambda x: F.floor(256 * x.cast("double")).cast("string")), ",")
    return F.coalesce(column.cast("string"), F.lit("-"))


def _columns(name: str) -> list[list[str]]:
    return [c.split(":") for c in _COLUMNS[name].split()]


def _row_sql(name: str) -> str:
    columns = _columns(name)
    row = ", ".join(f"coalesce({_SHOWN_SQL[kind].format(c)}, '-')" for c, kind in columns)
    project = f"{columns[0][0]} % 25"
    return f"SELECT '{name}' AS table_name, md5(CAST(to_json({{'project_id': {project}, 'row': concat_ws('|', {row})}}) AS VARCHAR)) AS h FROM {name} WHERE {project} <> 7"


@register("scoped_fingerprint", f"""
WITH rows AS ({' UNION ALL '.join(_row_sql(name) for name in _COLUMNS)})
SELECT table_name, {_FINGERPRINT_SQL} FROM rows GROUP BY table_name""")
def scoped_fingerprint(spark, folder):
    tables = {
        name: table(spark, folder, name).select(
            (F.col(_columns(name)[0][0]) % 25).alias("project_id"), F.concat_ws("|", *[_shown(c, kind) for c, kind in _columns(name)]).alias("row")
        )
        for name in _COLUMNS
    }
    return A.scoped_fingerprint(tables, F.col("project_id") != 7)


@register("corpus_fingerprint", f"""WITH RECURSIVE {CORPUS_SQL.strip()},
leaves AS (SELECT sha256('text' || chr(0) || relative_path || chr(0) || strlen(text) || chr(0) || sha256(text)) AS entry, count(*) AS n FROM corpus GROUP BY 1),
digits AS (SELECT CASE WHEN count(*) > 64 THEN len(format('{{:x}}', (count(*) - 1) // 64)) ELSE 0 END AS d FROM leaves),
levels AS (
  SELECT d, left(entry, CAST(d AS INT)) AS bucket, sha256(string_agg(entry || ':' || n, chr(10) ORDER BY entry)) AS digest FROM leaves, digits GROUP BY 1, 2
  UNION ALL
  SELECT d - 1, left(bucket, CAST(d - 1 AS INT)), sha256(string_agg(bucket || digest, chr(10) ORDER BY bucket)) FROM levels WHERE d > 0 GROUP BY 1, 2)
SELECT (SELECT count(*) FROM corpus) AS files, digest AS fingerprint FROM levels WHERE d = 0""")
def corpus_fingerprint(spark, folder):
    files = corpus(spark, folder).select(
        F.lit("text").alias("kind"),
        "relative_path",
        F.octet_length("text").cast("long").alias("bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
    )
    return A.corpus_fingerprint(files)


@register("latency_summary", """
SELECT event_type, count(*) AS samples, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.95) AS p95
FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY event_type""")
def latency_summary(spark, folder):
    samples = table(spark, folder, "events").select(
        "event_type", F.round(F.col("value") * 100).cast("bigint").alias("v")
    )
    return A.latency_summary(samples, ["event_type"], "v")


@register("distinct_batches", f"WITH {OPERATIONS_SQL.strip()} SELECT DISTINCT batch_id FROM operations WHERE batch_id IS NOT NULL")
def distinct_batches(spark, folder):
    return A.distinct_values(operations(spark, folder), "batch_id")


@register("distinct_props", "SELECT DISTINCT props FROM events WHERE props IS NOT NULL")
def distinct_props(spark, folder):
    return A.distinct_values(table(spark, folder, "events"), "props")


@register("import_summary", f"""WITH {CORPUS_SQL.strip()}
SELECT (SELECT count(DISTINCT regexp_replace(relative_path, '/[^/]*$', '')) FROM corpus) AS folders,
  count(*) AS files, count(*) FILTER (WHERE lower(relative_path) LIKE '%.txt') AS texts,
  CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM corpus""")
def import_summary(spark, folder):
    files = corpus(spark, folder).select(
        F.lit("text").alias("kind"), "relative_path", F.octet_length("text").cast("long").alias("bytes")
    )
    folders = (
        files.select(F.regexp_replace("relative_path", "/[^/]*$", "").alias("relative_path"))
        .distinct()
        .select(F.lit("folder").alias("kind"), "relative_path", F.lit(0).cast("long").alias("bytes"))
    )
    return A.import_summary(files.unionByName(folders))


@register("pull_report", f"""WITH {OPERATIONS_SQL.strip()},
outcomes AS (SELECT CASE WHEN status = 'completed' THEN 'applied' WHEN status IN ('conflict', 'blocked')
    THEN 'mergeRequired' ELSE 'upToDate' END AS outcome,
  CASE WHEN status IN ('conflict', 'blocked') THEN operation_kind END AS reason FROM operations)
SELECT outcome, reason, count(*) AS documents FROM outcomes GROUP BY outcome, reason""")
def pull_report(spark, folder):
    status = F.col("status")
    outcomes = operations(spark, folder).select(
        F.when(status == "completed", "applied")
        .when(status.isin("conflict", "blocked"), "mergeRequired")
        .otherwise("upToDate")
        .alias("outcome"),
        F.when(status.isin("conflict", "blocked"), F.col("operation_kind")).alias("reason"),
    )
    return A.pull_report(outcomes)


@register("projects_state", """
WITH projects AS (SELECT c_custkey AS project_id, c_name AS name,
    CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS trashed_at FROM customer),
tombstones AS (SELECT DISTINCT user_id + 1400 AS project_id FROM events)
SELECT coalesce(p.project_id, t.project_id) AS project_id,
  CASE WHEN p.project_id IS NULL THEN 'purged' WHEN trashed_at IS NULL THEN 'active' ELSE 'trashed' END AS state
FROM projects p FULL OUTER JOIN tombstones t ON p.project_id = t.project_id""")
def projects_state(spark, folder):
    projects = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).alias("trashed_at"),
    )
    tombstones = table(spark, folder, "events").select((F.col("user_id") + 1400).alias("project_id")).distinct()
    return R.project_state(projects, tombstones).select("project_id", "state")
