"""Change streams: tailing, duplicates, bursts, saves, leases, operations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.plans.leases import clamp_ttl
from quire.plans.ledger import TERMINAL_EVENTS
from quire.session import durable, shared_folder
from quire.streaming.ordered import TICK, Rule, in_event_order, instant

# Full pull as a safety net, quiet gaps before pull and autosave.
PERIODIC_PULL = "90 seconds"
PULL_QUIET = "450 milliseconds"
AUTOSAVE_QUIET = "800 milliseconds"

CHANGE_SCHEMA = "project_id string, document_id string, change string, revision bigint, ts timestamp"


def read_change_feed(
    spark: SparkSession, path: str, project_id: str | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """Row changes as a stream of JSON files, optionally of one project."""
    feed = (
        spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
    return feed if project_id is None else feed.where(F.col("project_id") == project_id)


def tail_changes(changes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """What a full pull finds beyond the changes seen so far.

    The batch is the truth: rows of ``snapshot`` newer than the highest
    revision seen in ``changes``, or never seen.
    """
    seen = changes.groupBy("document_id").agg(F.max("revision").alias("_seen"))
    return snapshot.join(seen, "document_id", "left").where("_seen IS NULL OR revision > _seen").drop("_seen")


def tail_with_pulls(
    changes: DataFrame, pull: Callable[[], DataFrame], folder: str | None = None, every: str = PERIODIC_PULL
) -> DataFrame:
    """Tail a change stream; a full pull from time to time adds what it missed.

    ``changes``: ``document_id, revision, ts``; ``pull`` reads the newest
    ``document_id, revision`` of all documents. Result: ``document_id,
    revision, via`` (``feed`` or ``pull``) and the micro-batch.

    A micro-batch passes its changes on and writes the highest revision of
    each of its documents. When the newest change is ``every`` past the last
    pull, the kept high-water table, with the marks since it was written, is
    compared with a full pull; what is newer there goes out, and the table is
    written anew. All of it lies under ``folder`` by micro-batch, so that one
    that runs twice writes the same, and a later run goes on from there.
    """
    spark = changes.sparkSession
    folder = folder or shared_folder(spark)
    marks = changes.select("document_id", "revision").schema
    for name in ("high", "marks", "out/via=feed", "out/via=pull"):
        spark.createDataFrame([], marks).write.mode("ignore").parquet(f"{folder}/{name}/batch=-1")
    spark.createDataFrame([(None,)], "at timestamp").write.mode("ignore").parquet(f"{folder}/pulls/batch=-1")
    wait = pd.Timedelta(every)

    def read(name: str, schema: str | StructType) -> DataFrame:
        own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.read.schema(StructType([*own.fields, StructField("batch", LongType())])).parquet(f"{folder}/{name}")

    def take(batch: DataFrame, number: int) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        put(batch.select("document_id", "revision").distinct(), "out/via=feed")
        put(batch.groupBy("document_id").agg(F.max("revision").alias("revision")), "marks")
        newest = batch.agg(F.max("ts")).first()[0]
        last = read("pulls", "at timestamp").where(F.col("batch") < number).orderBy(F.desc("batch")).first()
        if newest is None or (last["at"] is not None and newest - last["at"] < wait):
            return
        high = read("high", marks).where(F.col("batch") == last["batch"])
        since = read("marks", marks).where(F.col("batch").between(last["batch"] + 1, number))
        seen = high.union(since).select("document_id", "revision")
        found = durable(tail_changes(seen, pull().select("document_id", "revision")))
        put(found, "out/via=pull")
        put(seen.union(found).groupBy("document_id").agg(F.max("revision").alias("revision")), "high")
        put(spark.createDataFrame([(newest,)], "at timestamp"), "pulls")

    query = (
        changes.writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", f"{folder}/log").start()
    )
    query.awaitTermination()
    own = StructType([*marks.fields, StructField("via", StringType()), StructField("batch", LongType())])
    return spark.read.schema(own).parquet(f"{folder}/out")


def dedupe_events(events: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """First of each id within the watermark; later repeats are the batch's."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def debounced_bursts(changes: DataFrame, gap: str = PULL_QUIET, delay: str | None = None) -> DataFrame:
    """One row per burst of a document's changes, with its last change.

    Works on streams (with ``delay`` as watermark) and tables alike. Session
    windows merge within each task before the shuffle.
    """
    source = changes.withWatermark("ts", delay) if delay else changes
    return (
        source.groupBy(F.session_window("ts", gap).alias("burst"), "document_id")
        .agg(F.count("*").alias("changes"), F.max_by("change", "ts").alias("last_change"), F.max("ts").alias("last_ts"))
        .select("document_id", F.col("burst.start").alias("started_at"), "last_ts", "changes", "last_change")
    )


# --- stateful operators ---------------------------------------------------------------
#
# Each is a rule over the events of a key in order of time. State expires by
# event time where the rule has an end; the others keep one small row per key.

_SAVE_STATES = {"edited": "editing", "saveStarted": "saving", "saveSucceeded": "saved", "saveFailed": "failed"}


def _saved(state, event):
    at, generation, kind = event
    newest, shown = state or (None, None)
    stale = newest is not None and generation < newest
    if not stale:
        newest, shown = generation, _SAVE_STATES[kind]
    return (newest, shown), [(generation, kind, at, stale, shown)]


def save_state(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Save state after each event; events of an older generation are stale.

    ``events``: ``document_id, generation, event, ts``.
    """
    rule = Rule("generation bigint, shown string", "generation bigint, event string, ts bigint, stale boolean, state string", _saved)
    out = in_event_order(events, ["document_id"], "ts", ["generation", "event"], [], rule, delay)
    return out.withColumn("ts", instant("ts"))


def _leased(state, event):
    at, _, holder, action, ttl = event
    held, until = state or (None, None)
    if action == "release":
        mine = held == holder
        held, until = (None, None) if mine else (held, until)
        result = "released" if mine else "notHeld"
    elif held is not None and held != holder:
        result = "LEASE_CONFLICT"
    else:
        result = "renewed" if held == holder else "acquired"
        held, until = holder, at + ttl * 1_000_000
    return (None if held is None else (held, until)), [(event[1], holder, result, at, until)]


def lease_state(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Leases as they change; a timer reports those that run out.

    ``events``: ``document_id, lease_event_id, holder, action, ttl_seconds,
    ts``. A lease that ends at the instant of an event has ended before it.
    Rows of ``expired`` have no event.
    """
    kind = events.schema["lease_event_id"].dataType.simpleString()
    rule = Rule(
        "holder string, until bigint",
        f"lease_event_id {kind}, holder string, result string, at bigint, expires_at bigint",
        _leased,
        end=lambda state: state[1],
        close=lambda state: [(None, state[0], "expired", state[1], state[1])],
    )
    timed = events.withColumn("ttl", clamp_ttl(F.col("ttl_seconds")).cast("bigint"))
    out = in_event_order(timed, ["document_id"], "ts", ["lease_event_id"], ["holder", "action", "ttl"], rule, delay)
    return out.withColumns({"at": instant("at"), "expires_at": instant("expires_at")})


def rate_limited_snapshots(snapshots: DataFrame, large: int = 1024 * 1024, seconds: int = 300, delay: str = "1 minute") -> DataFrame:
    """Automatic snapshots kept; state is the last kept time, while it still matters."""
    gap = seconds * 1_000_000

    def keep(state, event):
        at, backup, size = event
        if size >= large and state is not None and at - state[0] < gap:
            return state, []
        return (at,), [(backup, at)]

    automatic = snapshots.where("reason = 'automaticSave'") if TICK not in snapshots.columns else snapshots.where(f"reason = 'automaticSave' OR {TICK}")
    kind = snapshots.schema["backup_id"].dataType.simpleString()
    rule = Rule("last bigint", f"backup_id {kind}, created_at bigint", keep, end=lambda state: state[0] + gap)
    out = in_event_order(automatic, ["document_id"], "created_at", ["backup_id"], ["byte_count"], rule, delay)
    return out.withColumn("created_at", instant("created_at"))


# State shown for each event type.
_OPERATION_STATES = {
    "enqueued": "pending", "dispatch_started": "inflight", "retry_scheduled": "retry_wait",
    "blocked": "blocked", "conflict_detected": "conflict", "committed": "completed",
    "replayed": "completed", "cancel_requested": "cancelled", "superseded": "cancelled",
}


def _operated(state, event):
    _, event_id, kind = event
    sequence, last = state or (0, None)
    closed = last in TERMINAL_EVENTS
    if not closed:
        sequence, last = sequence + 1, kind
    return (sequence, last), [(event_id, None if closed else sequence, _OPERATION_STATES.get(last, "pending"), closed)]


def operation_states(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """State of each operation after each event; ``late`` marks events after
    the end, which leave the state alone and can be routed aside.

    ``events``: ``operation_id, event_id, event_type, ts``.
    """
    kind = events.schema["event_id"].dataType.simpleString()
    rule = Rule("sequence bigint, last string", f"event_id {kind}, event_sequence bigint, state string, late boolean", _operated)
    return in_event_order(events, ["operation_id"], "ts", ["event_id"], ["event_type"], rule, delay)
