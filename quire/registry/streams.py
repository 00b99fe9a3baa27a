"""Streaming operators run over the events table as a file stream.

Each runs to the end of what the table holds, writes its rows as a table, and
is compared with what batch SQL says of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.registry.core import register
from quire.registry.roles import LEASES_SQL, SNAPSHOTS_SQL, lease_events, snapshots_of, table
from quire.session import checkpointed_stream
from quire.streaming import changes as K
from quire.streaming.ordered import settled

#: Rows of the table come in no order of time: none is late within this.
SPAN = "60 days"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a pattern, as a stream takes a folder or a pattern but not one file
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@register("streamed_distinct_users", "SELECT DISTINCT user_id FROM events")
def streamed_distinct_users(spark, folder):
    out = K.dedupe_events(_events(spark, folder), "user_id", "60 days")
    return checkpointed_stream(out.select("user_id"))


@register("streamed_bursts", """
WITH marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM marked)
SELECT user_id AS document_id, count(*) AS changes, arg_max(event_type, ts) AS last_change FROM numbered GROUP BY user_id, burst
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def streamed_bursts(spark, folder):
    # bursts that the watermark has not closed yet are still open and not shown
    changes = _events(spark, folder).select(
        F.col("user_id").alias("document_id"), "ts", F.col("event_type").alias("change")
    )
    out = K.debounced_bursts(changes, "6 hours", "1 hour").select("document_id", "changes", "last_change")
    return checkpointed_stream(out)


@register("streamed_save_states", """
WITH saves AS (SELECT event_id, CAST(user_id AS VARCHAR) AS document_id, ts, CAST(floor(value) AS BIGINT) AS generation,
  CASE event_type WHEN 'click' THEN 'editing' WHEN 'view' THEN 'saving' WHEN 'error' THEN 'failed' ELSE 'saved' END AS shown FROM events),
marked AS (SELECT *, coalesce(generation < max(generation) OVER (PARTITION BY document_id ORDER BY ts, generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM saves)
SELECT document_id, generation, stale, last_value(CASE WHEN NOT stale THEN shown END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ts, generation
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM marked""")
def streamed_save_states(spark, folder):
    kind = F.col("event_type")
    saves = _events(spark, folder).select(
        F.col("user_id").cast("string").alias("document_id"),
        F.floor("value").cast("bigint").alias("generation"),
        F.when(kind == "click", "edited").when(kind == "view", "saveStarted").when(kind == "error", "saveFailed")
        .otherwise("saveSucceeded").alias("event"),
        "ts",
    )
    out = settled(saves, "ts", lambda feed: K.save_state(feed, SPAN))
    return out.select("document_id", "generation", "stale", "state")


@register("streamed_rate_limit", f"""WITH RECURSIVE {SNAPSHOTS_SQL.strip()},
autos AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, backup_id) AS n FROM snapshots WHERE reason = 'automaticSave'),
walk AS (SELECT document_id, n, backup_id, created_at AS last_kept, true AS kept FROM autos WHERE n = 1
  UNION ALL SELECT document_id, n, backup_id, CASE WHEN keep THEN created_at ELSE last_kept END, keep
  FROM (SELECT a.document_id, a.n, a.backup_id, a.created_at, w.last_kept,
      a.byte_count < 1048576 OR a.created_at - w.last_kept >= INTERVAL 172800 SECOND AS keep
    FROM walk w JOIN autos a ON a.document_id = w.document_id AND a.n = w.n + 1))
SELECT document_id, backup_id FROM walk WHERE kept""")
def streamed_rate_limit(spark, folder):
    taken = snapshots_of(_events(spark, folder))
    kept = settled(taken, "created_at", lambda feed: K.rate_limited_snapshots(feed, seconds=172800, delay=SPAN))
    return kept.select("document_id", "backup_id")


@register("streamed_operation_states", """
WITH offered AS (SELECT CAST(user_id AS VARCHAR) AS operation_id, CAST(event_id AS VARCHAR) AS event_id, ts,
  CASE WHEN event_type = 'purchase' AND value > 30 THEN 'committed' WHEN event_type = 'error' AND value > 40 THEN 'superseded'
    WHEN event_type = 'error' THEN 'conflict_detected' ELSE 'retry_scheduled' END AS kind FROM events),
closed AS (SELECT operation_id, min(ts) AS at FROM offered WHERE kind IN ('committed', 'superseded') GROUP BY 1),
marked AS (SELECT o.*, coalesce(o.ts > c.at, false) AS late, row_number() OVER (PARTITION BY o.operation_id ORDER BY o.ts) AS n,
  CASE WHEN o.ts > c.at THEN (SELECT k.kind FROM offered k WHERE k.operation_id = o.operation_id AND k.ts = c.at) ELSE o.kind END AS shown
  FROM offered o LEFT JOIN closed c USING (operation_id))
SELECT operation_id, event_id, CASE WHEN NOT late THEN n END AS event_sequence, late,
  CASE shown WHEN 'committed' THEN 'completed' WHEN 'superseded' THEN 'cancelled' WHEN 'conflict_detected' THEN 'conflict' ELSE 'retry_wait' END AS state FROM marked""")
def streamed_operation_states(spark, folder):
    kind, value = F.col("event_type"), F.col("value")
    offered = _events(spark, folder).select(
        F.col("user_id").cast("string").alias("operation_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.when((kind == "purchase") & (value > 30), "committed").when((kind == "error") & (value > 40), "superseded")
        .when(kind == "error", "conflict_detected").otherwise("retry_scheduled").alias("event_type"),
        "ts",
    )
    return settled(offered, "ts", lambda feed: K.operation_states(feed, SPAN))


@register("streamed_leases", f"""WITH RECURSIVE {LEASES_SQL.strip()}
SELECT document_id, lease_event_id, who AS holder, result, make_timestamp(moment) AS at, make_timestamp(until) AS expires_at FROM walk WHERE n > 0
UNION ALL SELECT document_id, NULL, held, 'expired', make_timestamp(until), make_timestamp(until)
FROM (SELECT *, lead(moment) OVER (PARTITION BY document_id ORDER BY n) AS next_at FROM walk) WHERE held IS NOT NULL AND (next_at IS NULL OR until <= next_at)""")
def streamed_leases(spark, folder):
    out = settled(lease_events(_events(spark, folder)), "ts", lambda feed: K.lease_state(feed, SPAN))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "expires_at")})


@register("tailed_changes", """
SELECT user_id AS document_id, event_id AS revision, 'feed' AS via FROM events WHERE event_type <> 'error'
UNION ALL SELECT user_id, max(event_id), 'pull' FROM events GROUP BY user_id
HAVING max(event_id) > coalesce(max(event_id) FILTER (event_type <> 'error'), -1)""")
def tailed_changes(spark, folder):
    # a feed that loses the changes of one kind, and pulls that see them
    revisions = lambda rows: rows.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("revision"), "ts")
    feed = revisions(_events(spark, folder).where("event_type <> 'error'"))
    newest = lambda: revisions(table(spark, folder, "events")).groupBy("document_id").agg(F.max("revision").alias("revision"))
    return K.tail_with_pulls(feed, newest).drop("batch")
