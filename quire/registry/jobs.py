"""Queries on names and keys, merges, contracts, structure and leases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.ordered import with_row_number
from quire.plans import (
    contracts as C,
    hierarchy as H,
    leases as Z,
    ledger as L,
    merge as G,
    rules as B,
    storage_keys as K,
)
from quire.registry.core import register
from quire.registry.roles import CHAPTERS_SQL, CORPUS_SQL, LEASES_SQL, LEDGER_SQL, chapters, documents, lease_events, ledger, table, with_digest
from quire.streaming.changes import debounced_bursts

_LINES_SQL = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS name FROM documents)"


def _lines(spark, folder):
    return documents(spark, folder).select("doc_id", "source", F.explode(F.split("text", "\n", -1)).alias("name"))


@register("name_collisions", f"""WITH {_LINES_SQL}
SELECT source, lower(nfc_normalize(name)) AS name_key, count(*) AS members FROM lines WHERE name <> ''
GROUP BY 1, 2 HAVING count(*) > 1""")
def name_collisions(spark, folder):
    return K.name_collision_audit(_lines(spark, folder).where("name <> ''"), ["source"])


@register("storage_keys", f"""
WITH named AS (SELECT p_partkey, CASE WHEN p_size < 3 THEN 'CON.' || p_name WHEN p_size < 5 THEN p_name || '/x' WHEN p_size < 8 THEN '. .'
  WHEN p_size < 20 THEN upper(p_name) || ' . ' ELSE p_name END AS name FROM part),
keyed AS (SELECT p_partkey, lower(rtrim(name, ' .')) AS k FROM named)
SELECT p_partkey, CASE WHEN contains(k, '/') OR k = '' THEN 'STORAGE_NAME_INVALID' WHEN split_part(k, '.', 1) IN ({', '.join(repr(r) for r in K.RESERVED)})
  THEN 'STORAGE_NAME_RESERVED' END AS storage_code,
  CASE WHEN NOT contains(k, '/') AND k <> '' AND split_part(k, '.', 1) NOT IN ({', '.join(repr(r) for r in K.RESERVED)}) THEN k END AS storage_key FROM keyed""")
def storage_keys(spark, folder):
    size, name = F.col("p_size"), F.col("p_name")
    named = table(spark, folder, "part").select(
        "p_partkey",
        F.when(size < 3, F.concat(F.lit("CON."), name))
        .when(size < 5, F.concat(name, F.lit("/x")))
        .when(size < 8, ". .")
        .when(size < 20, F.concat(F.upper(name), F.lit(" . ")))
        .otherwise(name)
        .alias("name"),
    )
    return K.with_storage_key(named).select("p_partkey", "storage_code", "storage_key")


@register("storage_key_audit", f"""WITH {_LINES_SQL},
folded AS (SELECT source, replace(lower(nfc_normalize(name)), 'ß', 'ss') AS k FROM lines WHERE name IS NOT NULL),
stripped AS (SELECT source, rtrim(k, ' .') AS storage_key FROM folded WHERE NOT regexp_matches(k, '[/\\\\\\x00-\\x1F\\x7F]'))
SELECT source, storage_key, count(*) AS members FROM stripped
WHERE storage_key <> '' AND split_part(storage_key, '.', 1) NOT IN ({', '.join(repr(r) for r in K.RESERVED)}) GROUP BY ALL HAVING count(*) > 1""")
def storage_key_audit(spark, folder):
    # of the lines' characters only the sharp s differs between full case folding and lower case, and none under NFKC
    return K.storage_key_audit(_lines(spark, folder), ["source"])


_SIBLINGS_SQL = """folders AS (SELECT o_orderkey AS id, o_custkey AS project_id, CASE WHEN o_totalprice < 100000 THEN o_orderkey - 1 END AS parent_id,
  o_orderpriority AS name, o_orderstatus = 'P' AS is_deleted FROM orders),
documents_ AS (SELECT c_custkey AS id, c_custkey AS project_id, CAST(NULL AS BIGINT) AS parent_id, CASE WHEN c_acctbal < 0 THEN 'a/b' ELSE '2-HIGH' END AS name, false AS is_deleted FROM customer)"""


@register("migration_validation", f"""WITH {_SIBLINGS_SQL},
live AS (SELECT * FROM folders WHERE NOT is_deleted UNION ALL SELECT * FROM documents_)
SELECT project_id, 'STORAGE_NAME_INVALID' AS code, count(*) AS issues FROM live WHERE contains(name, '/') GROUP BY project_id
UNION ALL SELECT c.project_id, 'FOLDER_NOT_FOUND', count(*) FROM folders c LEFT JOIN folders p ON c.parent_id = p.id AND c.project_id = p.project_id AND NOT p.is_deleted
  WHERE NOT c.is_deleted AND c.parent_id IS NOT NULL AND p.id IS NULL GROUP BY c.project_id
UNION ALL SELECT project_id, 'PATH_CONFLICT', count(*) FROM (SELECT project_id, parent_id, lower(name) AS k FROM live WHERE NOT contains(name, '/')
  GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY project_id""")
def migration_validation(spark, folder):
    folders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"),
        F.when(F.col("o_totalprice") < 100000, F.col("o_orderkey") - 1).alias("parent_id"),
        F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "P").alias("is_deleted"),
    )
    documents = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("project_id"), F.lit(None).cast("bigint").alias("parent_id"),
        F.when(F.col("c_acctbal") < 0, "a/b").otherwise("2-HIGH").alias("name"), F.lit(False).alias("is_deleted"),
    )
    return K.migration_validation(folders, documents)


@register("reconciled_versions", r"""
WITH d AS (SELECT doc_id AS pair_id, lang, regexp_replace(text, '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS t, text FROM documents),
merged AS (SELECT pair_id, lang, text, CASE WHEN t = '' OR ends_with(t, chr(10)) THEN t ELSE t || chr(10) END AS body FROM d)
SELECT pair_id, CASE lang WHEN 'en' THEN 'merged' WHEN 'fr' THEN 'conflict' WHEN 'de' THEN 'merged' ELSE 'REMOTE_DELETION' END AS outcome,
  CASE lang WHEN 'en' THEN sha256('L' || chr(10) || body || 'R' || chr(10)) WHEN 'de' THEN sha256(text || chr(10) || 'L') END AS content_hash,
  CASE lang WHEN 'en' THEN 'q' WHEN 'de' THEN 'p' END AS path, CAST(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS BIGINT) AS conflicts FROM merged""")
def reconciled_versions(spark, folder):
    text, lang = F.col("text"), F.col("lang")
    ended = F.when(text.rlike(r"[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]\z"), text).otherwise(F.concat(text, F.lit("\n")))
    pairs = documents(spark, folder).select(
        F.col("doc_id").alias("pair_id"),
        text.alias("base"),
        F.when(lang == "en", F.concat(F.lit("L\n"), text)).when(lang == "fr", F.concat(ended, F.lit("L"))).otherwise(F.concat(text, F.lit("\nL"))).alias("local"),
        F.when(lang == "en", F.concat(ended, F.lit("R"))).when(lang == "fr", F.concat(ended, F.lit("R"))).otherwise(text).alias("remote"),
        F.lit("p").alias("base_path"),
        F.lit("p").alias("local_path"),
        F.when(lang == "en", "q").otherwise("p").alias("remote_path"),
        (lang == "es").alias("remote_deleted"),
    )
    out = G.reconcile_versions(pairs)
    return out.select("pair_id", "outcome", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "path", "conflicts")


@register("payload_digests", """
SELECT event_id, sha256(replace(props, ': ', ':')) AS payload_hash, CASE WHEN value > 50 THEN 'CONTRACT_DIGEST_MISMATCH' END AS problem FROM events""")
def payload_digests(spark, folder):
    stated = F.when(F.col("value") > 50, "0").otherwise(F.sha2(F.replace("props", F.lit(": "), F.lit(":")).cast("binary"), 256))
    rows = table(spark, folder, "events").select("event_id", F.col("props").alias("payload"), stated.alias("payload_sha256"))
    actual = C.payload_sha256(F.col("payload"))
    problem = F.when(actual != F.col("payload_sha256"), "CONTRACT_DIGEST_MISMATCH")
    return rows.select("event_id", actual.alias("payload_hash"), problem.alias("problem"))


@register("contract_audit", """
WITH intents AS (SELECT l_orderkey AS batch_id, l_orderkey * 10 + l_linenumber AS operation_id, l_quantity > 2 AS sound,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) AS sequence FROM lineitem),
same AS (SELECT batch_id, max(n) > 1 AS repeated FROM (SELECT batch_id, operation_id, count(*) AS n FROM intents GROUP BY 1, 2) GROUP BY 1),
shape AS (SELECT batch_id, bool_or(NOT sound) AS malformed FROM intents GROUP BY 1),
batches AS (SELECT o_orderkey AS batch_id, o_custkey % 3 AS m, o_orderstatus, o_orderpriority, o_totalprice FROM orders)
SELECT b.batch_id, CASE WHEN m = 2 AND o_orderstatus = 'P' THEN 'PROJECT_MIGRATING' WHEN o_orderpriority = '1-URGENT' THEN 'CONTRACT_DIGEST_MISMATCH'
  WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 'CONTRACT_NOT_ALLOWED' WHEN o_totalprice < 20000 THEN 'PROTOCOL_TOO_OLD' WHEN o_totalprice < 40000 THEN 'CAPABILITY_MISMATCH'
  WHEN o_totalprice < 60000 THEN 'INVALID_ARGUMENT' WHEN o_totalprice < 80000 THEN 'CONTRACT_DIGEST_MISMATCH' WHEN malformed THEN 'INVALID_ARGUMENT' WHEN repeated THEN 'OPERATION_ID_REUSED' END AS code
FROM batches b LEFT JOIN same USING (batch_id) LEFT JOIN shape USING (batch_id)""")
def contract_audit(spark, folder):
    price, priority, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    mode = F.when((F.col("o_custkey") % 3 == 2) & (status == "P"), "ID_BASED").otherwise("LEGACY")
    intent_list = F.lit('[{"sequence": 1}]')
    batches = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("batch_id"),
        F.col("o_custkey").alias("project_id"),
        mode.alias("mode"),
        F.lit(0).alias("epoch"),
        F.when((priority == "2-HIGH") & (status == "O"), "v9").otherwise("v1").alias("contract_version"),
        F.when(priority == "1-URGENT", "bad").when((priority == "2-HIGH") & (status == "O"), "off").otherwise("good").alias("contract_sha256"),
        F.when(price < 20000, 2).otherwise(3).alias("protocol_version"),
        F.when(price < 40000, F.array(F.lit("x"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("capabilities"),
        F.when(price < 60000, "").otherwise("build").alias("client_build_id"),
        intent_list.alias("ordered_intents"),
        F.when(price < 80000, "0").otherwise(F.sha2(F.lit('[{"sequence":1}]').cast("binary"), 256)).alias("batch_payload_sha256"),
    )
    payload = F.concat(F.lit('{"size": '), F.col("l_quantity").cast("bigint").cast("string"), F.lit(', "a": 1}'))
    canonical = F.concat(F.lit('{"a":1,"size":'), F.col("l_quantity").cast("bigint").cast("string"), F.lit("}"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("operation_id"),
        F.lit("folder").alias("entity_kind"),
        F.lit("create").alias("intent_kind"),
        F.lit(0).alias("base_revision"),
        payload.alias("payload"),
        F.when(F.col("l_quantity") > 2, F.sha2(canonical.cast("binary"), 256)).otherwise("0").alias("payload_sha256"),
        F.lit(None).cast("bigint").alias("supersedes_operation_id"),
        "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )
    intents = with_row_number(lines, ["batch_id"], ["l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice"], "sequence")
    projects = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("project_id"), F.lit("LEGACY").alias("actual_mode"), F.lit(0).alias("actual_epoch")
    )
    allowlist = spark.createDataFrame(
        [("good", "v1", True, ["a"], ["a", "b"]), ("off", "v8", False, ["a"], ["a", "b"])],
        "contract_sha256 string, version string, enabled boolean, required array<string>, allowed array<string>",
    )
    known = lines.select("operation_id", F.lit(None).cast("bigint").alias("project_id")).limit(0)
    return C.contract_audit(batches, intents, projects, allowlist, known)


_COMMITS_SQL = f"""WITH RECURSIVE {LEDGER_SQL.strip()},
shaped AS (SELECT document_id, operation_id, base_revision, content_hash, line_id, byte_count,
    CASE WHEN base_revision = 0 THEN 'create' WHEN is_deleted THEN 'delete' WHEN byte_count < 20 THEN 'restore' ELSE 'update' END AS kind,
    is_deleted AND base_revision > 0 AS gone, CASE WHEN byte_count = 7 THEN 'CONTENT_SIZE_MISMATCH' WHEN byte_count = 8 THEN 'CONTENT_DIGEST_MISMATCH' END AS fault,
    row_number() OVER (PARTITION BY document_id ORDER BY created_at, arrival, line_id, project_id, byte_count) AS seq FROM ledger),
verdicts AS (SELECT document_id, seq, row_number() OVER w AS n, CAST(content_hash AS VARCHAR) = first_value(content_hash) OVER w AS same
  FROM shaped WHERE fault IS NULL WINDOW w AS (PARTITION BY operation_id ORDER BY seq)),
asked AS (SELECT s.*, CASE WHEN n = 1 THEN 'first' WHEN same THEN 'replay' ELSE 'reused' END AS verdict FROM shaped s LEFT JOIN verdicts USING (document_id, seq)),"""


@register("document_commit_replay", _COMMITS_SQL + """
walk AS (
  SELECT document_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS operation_id, CAST(0 AS BIGINT) AS rev, false AS dead,
    CAST('' AS VARCHAR) AS hash, CAST('' AS VARCHAR) AS outcome FROM (SELECT DISTINCT document_id FROM asked)
  UNION ALL
  SELECT document_id, seq, operation_id, CASE WHEN outcome = 'committed' THEN base_revision + 1 ELSE rev END,
    CASE WHEN outcome = 'committed' THEN gone ELSE dead END, CASE WHEN outcome = 'committed' THEN content_hash ELSE hash END, outcome
  FROM (SELECT a.document_id, a.seq, a.operation_id, a.base_revision, a.gone, a.content_hash, w.rev, w.dead, w.hash,
    CASE WHEN fault IS NOT NULL THEN fault WHEN verdict = 'replay' THEN 'replayed' WHEN verdict = 'reused' THEN 'OPERATION_ID_REUSED'
      WHEN kind = 'create' THEN CASE WHEN w.rev > 0 THEN 'DOCUMENT_ALREADY_EXISTS' ELSE 'committed' END
      WHEN w.rev = 0 THEN 'DOCUMENT_NOT_FOUND' WHEN w.rev <> base_revision THEN 'REVISION_CONFLICT'
      WHEN kind IN ('update', 'delete') AND w.dead THEN 'DOCUMENT_NOT_FOUND' WHEN kind = 'restore' AND NOT w.dead THEN 'DOCUMENT_ALREADY_EXISTS'
      WHEN kind IN ('delete', 'restore') AND w.hash <> content_hash THEN 'CONTENT_DIGEST_MISMATCH' ELSE 'committed' END AS outcome
    FROM walk w JOIN asked a ON a.document_id = w.document_id AND a.seq = w.seq + 1))
SELECT document_id, seq, operation_id, outcome FROM walk WHERE seq > 0""")
def document_commit_replay(spark, folder):
    # numbered before ids and digests are made, which so need no exchange
    versions = ledger(spark, folder).drop("content_hash", "operation_id")
    rows = with_digest(L.numbered_requests(versions, ["created_at", "arrival", "line_id", "project_id", "byte_count"]))
    rows = rows.withColumn("operation_id", F.concat_ws("-", F.col("document_id").cast("string"), F.col("revision").cast("string")))
    base, size = F.col("base_revision"), F.col("byte_count")
    content = size.cast("string")
    requests = rows.select(
        "document_id", "seq", "operation_id", base,
        F.lit("p").alias("project_id"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(1).alias("structure_revision"),
        F.when(base == 0, "create").when(F.col("is_deleted"), "delete").when(size < 20, "restore").otherwise("update").alias("intent_kind"),
        (F.col("is_deleted") & (base > 0)).alias("is_deleted"),
        content.alias("content"),
        (F.octet_length(content) + F.when(size == 7, 1).otherwise(0)).alias("content_bytes"),
        F.when(size == 8, "0").otherwise(F.col("content_hash")).alias("content_sha256"),
        F.col("content_hash").alias("payload_digest"),
    )
    return L.document_commit_replay(requests).select("document_id", "seq", "operation_id", "outcome")


@register("lease_timeline", f"""WITH RECURSIVE {LEASES_SQL.strip()}
SELECT lease_event_id, document_id, who AS holder, make_timestamp(moment) AS at, result, make_timestamp(until) AS expires_at FROM walk WHERE n > 0""")
def lease_timeline(spark, folder):
    timeline = Z.lease_timeline(lease_events(table(spark, folder, "events")))
    return timeline.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "expires_at")})


@register("debounced_bursts", """
WITH marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM marked)
SELECT user_id AS document_id, min(ts) AS started_at, max(ts) AS last_ts, count(*) AS changes, arg_max(event_type, ts) AS last_change
FROM numbered GROUP BY user_id, burst""")
def debounced_bursts_query(spark, folder):
    changes = table(spark, folder, "events").select(
        F.col("user_id").alias("document_id"), "ts", F.col("event_type").alias("change")
    )
    return debounced_bursts(changes, "6 hours")


@register("payload_digest_audit", """
WITH payloads AS (SELECT event_id, event_type, CASE event_type WHEN 'view' THEN '{"b": 1, "a": ' || event_id || '}' WHEN 'error' THEN '{"a": 1.5}' ELSE '{"a": ' || event_id || '}' END AS payload FROM events)
SELECT event_id, CASE event_type WHEN 'error' THEN 'INVALID_ARGUMENT' ELSE 'CONTRACT_DIGEST_MISMATCH' END AS problem FROM payloads
WHERE event_type = 'error' OR (event_type = 'click' AND event_id % 2 = 0)""")
def payload_digest_audit(spark, folder):
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    plain = F.concat(F.lit('{"a": '), key, F.lit("}"))
    payload = F.when(kind == "view", F.concat(F.lit('{"b": 1, "a": '), key, F.lit("}"))).when(kind == "error", '{"a": 1.5}').otherwise(plain)
    canonical = F.when(kind == "view", F.concat(F.lit('{"a":'), key, F.lit(',"b":1}'))).otherwise(F.concat(F.lit('{"a":'), key, F.lit("}")))
    stated = F.when((kind == "click") & (F.col("event_id") % 2 == 0), "0").otherwise(F.sha2(canonical.cast("binary"), 256))
    intents = table(spark, folder, "events").select("event_id", payload.alias("payload"), stated.alias("payload_sha256"))
    return C.payload_digest_audit(intents).select("event_id", "problem")


@register("safe_names", """
WITH asked AS (SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS turn FROM part WHERE p_size > 10),
held AS (SELECT DISTINCT p_brand, lower(p_name) AS k FROM part WHERE p_size <= 10)
SELECT p_partkey AS request_id, CASE WHEN h.k IS NULL AND turn = 1 THEN p_name ELSE p_name || ' ' || (turn + CASE WHEN h.k IS NULL THEN 0 ELSE 1 END) END AS safe_name
FROM asked a LEFT JOIN held h ON a.p_brand = h.p_brand AND lower(a.p_name) = h.k""")
def safe_names(spark, folder):
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("request_id"), F.col("p_brand").alias("parent_id"), F.col("p_name").alias("name"), "p_size"
    )
    return H.safe_names(parts.where("p_size > 10"), parts.where("p_size <= 10")).select("request_id", "safe_name")


@register("folder_plan", """
WITH named AS (SELECT n_nationkey AS k, n_name, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
local AS (SELECT *, CASE WHEN k < 5 THEN path WHEN k < 15 THEN 'old/' || n_name END AS here FROM named)
SELECT 'n' || k AS folder_id, CASE WHEN k < 2 OR k = 24 THEN 'conflict' WHEN here IS NOT NULL THEN 'move' ELSE 'create' END AS action,
  CASE WHEN k < 2 THEN 'pendingLocalOperation' WHEN k = 24 THEN 'unknownParent' END AS reason,
  CASE WHEN k >= 2 AND k < 24 THEN here END AS from_path, CASE WHEN k < 2 OR k = 24 THEN here ELSE path END AS path
FROM local WHERE k < 2 OR (k NOT IN (20, 21) AND here IS DISTINCT FROM path)""")
def folder_plan(spark, folder):
    key = F.col("n_nationkey")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    regions = region.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("folder_id"),
        F.lit(None).cast("string").alias("parent_folder_id"),
        F.col("r_name").alias("name"),
        F.lit(False).alias("is_deleted"),
    )
    nations = nation.select(
        F.concat(F.lit("n"), key.cast("string")).alias("folder_id"),
        F.concat(F.lit("r"), F.when(key == 24, 9).otherwise(F.col("n_regionkey")).cast("string")).alias("parent_folder_id"),
        F.col("n_name").alias("name"),
        key.isin(20, 21).alias("is_deleted"),
    )
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    local = named.where("n_nationkey < 15").select(
        F.concat(F.lit("n"), key.cast("string")).alias("document_id"),
        F.lit("folder").alias("kind"),
        F.when(key < 5, F.concat_ws("/", "r_name", "n_name")).otherwise(F.concat(F.lit("old/"), "n_name")).alias("relative_path"),
    ).unionByName(regions.select(F.col("folder_id").alias("document_id"), F.lit("folder").alias("kind"), F.col("name").alias("relative_path")))
    blocked = nation.where("n_nationkey < 2").select(F.concat(F.lit("n"), key.cast("string")).alias("folder_id"))
    return H.plan_folders(regions.unionByName(nations), local, blocked)


@register("rule_decisions", f"""WITH {CHAPTERS_SQL.strip()},
counts AS (SELECT project_id, number, count(*) AS n FROM chapters GROUP BY 1, 2)
SELECT c.document_id AS request_id, CASE c.number WHEN 1 THEN 'manuscriptDeletionLocked' WHEN 2 THEN 'allowed' WHEN 3 THEN 'chapterPrefixLocked'
  WHEN 4 THEN 'manuscriptCannotLeave' WHEN 5 THEN 'duplicateChapterNumber' WHEN 6 THEN 'manuscriptUsesNaturalOrder' ELSE 'invalidChapterName' END AS decision FROM chapters c""")
def rule_decisions(spark, folder):
    rows = chapters(spark, folder)
    number = F.col("number")
    requests = rows.select(
        F.col("document_id").alias("request_id"),
        "project_id",
        F.when(number == 1, "trash").when(number.isin(2, 3), "rename").when(number == 4, "move").when(number == 6, "reorder").otherwise("create").alias("action"),
        F.lit("text").alias("kind"),
        F.when(number.isin(1, 2, 3, 4, 6), F.col("relative_path")).alias("source_path"),
        F.when(number == 4, "메인/설정집").when(number == 1, "메인/휴지통").when(number.isin(5, 7, 8), "메인/원고/2권").alias("target_path"),
        F.when(number == 2, "002화 new title.txt").when(number == 3, "999화 x.txt").when(number == 5, "001화.txt").when(number.isin(7, 8), "chapter.txt").alias("name"),
        F.lit(0).alias("position"),
    )
    return B.rule_decisions(requests, rows)


_ROOT, _VOLUME, _NOTES = "메인/원고", "메인/원고/1권", "메인/설정집"
#: One request of each kind: action, kind, source (null: the chapter itself), target, name, and the decision (null: by the chapters there are).
_REQUESTS = [
    ("trash", "text", None, None, None, "manuscriptDeletionLocked"),
    ("rename", "text", None, None, None, "allowed"),
    ("rename", "text", None, None, "999화 x.txt", "chapterPrefixLocked"),
    ("rename", "text", None, None, "a/b", "invalidName"),
    ("move", "text", None, _NOTES, None, "manuscriptCannotLeave"),
    ("create", "folder", "", _ROOT, "x", "invalidVolumeName"),
    ("create", "text", "", _ROOT, "x.txt", "manuscriptAcceptsVolumesOnly"),
    ("create", "folder", "", _ROOT, "2권", "allowed"),
    ("create", "text", "", "메인/원고/2권", "998화.txt", "allowed"),
    ("create", "text", "", "메인/원고/2권", "003화.txt", None),
    ("create", "folder", "", "메인/원고/2권", "x", "volumeAcceptsChaptersOnly"),
    ("reorder", "text", None, None, None, "manuscriptUsesNaturalOrder"),
    ("trash", "folder", _VOLUME, None, None, "manuscriptDeletionLocked"),
    ("rename", "folder", _VOLUME, None, "9권", "volumeNameLocked"),
    ("rename", "folder", _ROOT, None, "다른", "manuscriptRootLocked"),
    ("move", "folder", _VOLUME, _ROOT, None, "allowed"),
    ("move", "text", f"{_NOTES}/x.txt", _VOLUME, None, "externalItemCannotEnter"),
    ("rename", "text", f"{_NOTES}/x.txt", None, "y.txt", "allowed"),
    ("reorder", "text", f"{_NOTES}/x.txt", None, None, "allowed"),
    ("create", "text", "", _NOTES, "bad\tname", "invalidName"),
    ("split", "text", None, None, None, "unknownAction"),
]


@register("rule_branches", f"""WITH {CHAPTERS_SQL.strip()}
SELECT document_id AS request_id, CASE document_id % {len(_REQUESTS)} {' '.join(f"WHEN {i} THEN '{r[5]}'" for i, r in enumerate(_REQUESTS) if r[5])}
  ELSE CASE WHEN EXISTS (SELECT 1 FROM chapters o WHERE o.project_id = c.project_id AND o.number = 3) THEN 'duplicateChapterNumber' ELSE 'allowed' END END AS decision FROM chapters c""")
def rule_branches(spark, folder):
    rows = chapters(spark, folder)
    kinds = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(_REQUESTS)], "turn bigint, action string, kind string, source string, target_path string, name string")
    asked = rows.withColumn("turn", F.col("document_id") % len(_REQUESTS)).join(F.broadcast(kinds), "turn")
    source = F.when(F.col("source").isNull(), F.col("relative_path")).when(F.col("source") != "", F.col("source"))
    requests = asked.select(F.col("document_id").alias("request_id"), "project_id", "action", "kind", source.alias("source_path"), "target_path", "name", F.lit(0).alias("position"))
    return B.rule_decisions(requests, rows)
