"""The corpus operators over the shared tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontamination, exact_dedup, jaccard, language, manifest, mixing, quality, secret_scan, sentence_spans, sharding, token_counts, topk, whitening
from quire.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


#: The vocabulary whose tokens are counted.
VOCABULARY = "byte_bpe_50k.json"


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op4_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_spans.without_repeats(table(spark, folder, "documents"), sentence_spans.PASSAGE)


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_components(table(spark, folder, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents
), s AS (
  SELECT id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
), c AS (
  SELECT id, doc_id, len(s) AS n, list_sort(s) AS s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS least,
         row_number() OVER (PARTITION BY list_sort(s) ORDER BY doc_id, id) AS turn
  FROM s
), e AS MATERIALIZED (
  SELECT least, n, unnest(s) AS g FROM c WHERE turn = 1 AND n > 0
), p AS MATERIALIZED (
  SELECT a.least AS a, b.least AS b
  FROM e a JOIN e b ON a.g = b.g AND a.least < b.least AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.least, b.least, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT DISTINCT a AS node, a AS reached FROM l
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a
), m AS (
  SELECT node, min(reached) AS least FROM r GROUP BY node
)
SELECT c.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE coalesce(m.least, c.least) END AS component_id
FROM c LEFT JOIN m ON c.least = m.node AND c.n > 0
"""


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(table(spark, folder, "documents"))


def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.quantised_top_k(table(spark, folder, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT doc_id, source, text, CAST(len(w) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / greatest(0.05::DOUBLE, len(list_distinct(w))::DOUBLE / greatest(len(w), 1)::DOUBLE) AS key
  FROM words
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size::DOUBLE) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, cap * (weights - weight_before) <= (total - cap_before) * weight AS capped FROM c
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight
              / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
  FROM h
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 1 END AS epochs FROM t
), r AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), z AS (
  SELECT *, epochs + CASE WHEN rest > 0 AND before * 2 + size <= rest * 2 THEN 1 ELSE 0 END AS copies FROM r
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM z
"""


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_report(table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.tamper_report(table(spark, folder, "documents"))


def _leaf_sql(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    shown = [f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
    return f"sha256({' || '.join(shown)})"


# DuckDB has no crc32: its table is built from the polynomial
OP11_SQL = f"""
WITH RECURSIVE polynomial AS (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(i)
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM polynomial
), d AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) % 5 = 0 AS chosen
  FROM documents, crc_table
), l AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN chosen THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS altered,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid
  FROM d
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n,
         row_number() OVER () AS id
  FROM l
), t AS (
  SELECT sid, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT sid, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY sid, lvl, pos // 16
), s AS (
  SELECT 0 AS lvl, sid AS pos, h, (SELECT count(DISTINCT sid) FROM leaves) AS n FROM t WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM s WHERE n > 1 GROUP BY lvl, pos // 16
), steps AS MATERIALIZED (
  SELECT id, lvl AS step, coalesce(string_agg(h, '' ORDER BY t.pos) FILTER (t.pos < leaves.pos >> (4 * lvl)), '') AS l,
         coalesce(string_agg(h, '' ORDER BY t.pos) FILTER (t.pos > leaves.pos >> (4 * lvl)), '') AS r
  FROM leaves JOIN t ON t.sid = leaves.sid AND t.n > 1 AND t.pos // 16 = leaves.pos >> (4 * lvl + 4) GROUP BY id, lvl
  UNION ALL
  SELECT id, 100 + lvl, coalesce(string_agg(h, '' ORDER BY s.pos) FILTER (s.pos < sid >> (4 * lvl)), ''),
         coalesce(string_agg(h, '' ORDER BY s.pos) FILTER (s.pos > sid >> (4 * lvl)), '')
  FROM leaves JOIN s ON s.n > 1 AND s.pos // 16 = sid >> (4 * lvl + 4) GROUP BY id, lvl
), proved AS (
  SELECT id, list(l ORDER BY step) AS ls, list(r ORDER BY step) AS rs, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY id
), fold AS (
  SELECT id, 1 AS step, altered AS h FROM leaves
  UNION ALL
  SELECT fold.id, step + 1, sha256(ls[step] || h || rs[step]) FROM fold JOIN proved ON fold.id = proved.id WHERE step <= len(ls)
), ends AS (
  SELECT id, arg_max(h, step) AS h FROM fold GROUP BY id
), whole AS (
  SELECT h AS root FROM s WHERE n = 1
)
SELECT doc_id, leaf, t.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, ends.h AS folded_root, ends.h = root AS verified
FROM leaves JOIN t ON t.sid = leaves.sid AND t.n = 1 JOIN ends ON ends.id = leaves.id LEFT JOIN proved ON proved.id = leaves.id, whole
"""


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings")).drop("eigenvalue")


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.deduplicate(spark, f"{folder}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP13_SQL = """
WITH n AS (
  SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST, id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_mix_sources": op9_mix_sources,
    "op10_shards": op10_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_whitening": op12_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op5_jaccard_join": OP5_SQL,
    "op8_exact_top_k": OP8_SQL,
    "op9_mix_sources": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_exact_dedup": OP13_SQL,
}
