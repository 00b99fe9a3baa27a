"""Jobs on the version ledger, operation queue and event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quire.functions.digests import content_sha256
from quire.functions.names import valid_relative_path
from quire.operators.chains import committed, follow, next_at_or_after, replayed, split_by_size, state_before
from quire.operators.ordered import newest, sort_columns, top_rows, with_previous, with_row_number, with_running
from quire.operators.windows import DONE, lane_heads, unfinished
from quire.session import durable, task_limit

# Content limit, event types after which an operation is closed.
MAX_CONTENT_BYTES = 10 * 1024 * 1024
TERMINAL_EVENTS = ["committed", "replayed", "cancel_requested", "superseded"]


# --- idempotency and replay -----------------------------------------------------------


def idempotency(requests: DataFrame, order: list[str]) -> DataFrame:
    """Per request: ``first``, ``replay`` of an equal payload, or ``reused``.

    Needs ``operation_id, payload_digest`` and the order columns. The first
    row per id is found on the map side, so a hot id costs one row per task.
    Requests without an id are left out.
    """
    return with_verdict(requests.where("operation_id IS NOT NULL"), order, F.lit(True))


def with_verdict(requests: DataFrame, order: list[str], counted: Column) -> DataFrame:
    """Requests with the verdict of :func:`idempotency` on those that are ``counted``; null for others.

    Only ids that come again are joined, with what their first request says.
    """
    own = requests.where(counted & F.col("operation_id").isNotNull())
    at = F.struct(*order)
    first = F.struct(at.alias("at"), F.col("payload_digest").alias("digest"))
    firsts = own.groupBy("operation_id").agg(F.count("*").alias("_n"), F.min_by(first, at).alias("_first"))
    joined = requests.join(firsts.where("_n > 1").drop("_n"), "operation_id", "left")
    verdict = (
        F.when(F.col("_first").isNull() | (at == F.col("_first.at")), "first")
        .when(F.col("payload_digest") == F.col("_first.digest"), "replay")
        .otherwise("reused")
    )
    return joined.withColumn("verdict", F.when(counted & F.col("operation_id").isNotNull(), verdict)).drop("_first")


def reused_operation_ids(requests: DataFrame) -> DataFrame:
    """Ids that carry more than one payload."""
    pairs = requests.select("operation_id", "payload_digest").distinct()
    return pairs.groupBy("operation_id").agg(F.count("*").alias("payloads")).where("payloads > 1")


def replay_ledger(requests: DataFrame, order: list[str]) -> DataFrame:
    """Outcome of each commit request, as if all were run one after the other.

    Needs ``document_id, seq, operation_id, project_id, base_revision,
    device_id, relative_path, content_hash, is_deleted``; ``seq`` numbers a
    document's requests, and ``order`` (ties by document) puts those of all
    documents in one sequence that agrees with it. Adds ``outcome``
    (``committed``, ``replayed`` or an error code) and ``revision``. An
    operation id is taken by its first commit, whatever the document; a live
    path of a project is held by one document from a commit there to its next.

    Projects that share no document and no id with another, and are of
    ordinary size, are replayed in one sorted stream per partition. The others
    go through :func:`_replay_in_rounds`.
    """
    apart = _apart(requests)
    if apart is None:
        return _replay_by_project(requests, order)
    same = F.col("project_id").eqNullSafe(F.col("_project"))
    alone = _replay_by_project(requests.join(apart, same, "left_anti"), order)
    return alone.unionByName(_replay_in_rounds(requests.join(apart, same, "left_semi"), order))


#: Requests of a project that one stream replays, keeping its paths and ids in memory.
PROJECT_ROWS = 200_000
_PAYLOAD = ["document_id", "project_id", "base_revision", "device_id", "relative_path", "content_hash", "is_deleted"]


def _apart(requests: DataFrame) -> DataFrame | None:
    """``_project`` of projects that share documents or ids with others, or are large; None if there are none."""
    limit = task_limit(requests.sparkSession, "taskRows", PROJECT_ROWS)
    project = F.col("project_id").alias("_project")
    out = requests.groupBy(project).count().where(F.col("count") > limit).select("_project")
    several = (F.col("_low") != F.col("_high")) | (F.col("_none") & F.col("_low").isNotNull())
    for key in ("document_id", "operation_id"):
        pairs = requests.where(F.col(key).isNotNull()).select(key, project)
        spans = pairs.groupBy(key).agg(
            F.min("_project").alias("_low"), F.max("_project").alias("_high"), F.max(F.col("_project").isNull()).alias("_none")
        )
        shared = spans.where(several).select(key)
        out = out.union(pairs.join(shared, key, "left_semi").select("_project"))
    out = durable(out.distinct())
    return None if out.isEmpty() else out


def _outcomes(judged: DataFrame, earlier: Column, repeated: Column) -> DataFrame:
    """The outcome from the state before a request and whether its id was taken, by the same payload or not."""
    exists = F.col("was_base_revision").isNotNull()
    founding = F.col("base_revision") == 0
    outcome = (
        F.when(F.col("committed"), "committed")
        .when(earlier & repeated, "replayed")
        .when(earlier, "OPERATION_ID_REUSED")
        .when(founding & exists, "DOCUMENT_ALREADY_EXISTS")
        .when(founding & F.col("is_deleted"), "INVALID_ARGUMENT")
        .when(founding, "PATH_CONFLICT")
        .when(~exists | (F.col("was_project_id") != F.col("project_id")), "DOCUMENT_NOT_FOUND")
        .when(F.col("was_base_revision") + 1 != F.col("base_revision"), "REVISION_CONFLICT")
        .otherwise("PATH_CONFLICT")
    )
    revision = F.when(F.col("outcome").isin("committed", "replayed"), F.col("base_revision") + 1)
    return judged.withColumn("outcome", outcome).select(
        "document_id", "seq", "operation_id", "outcome", revision.alias("revision")
    )


def _replay_by_project(requests: DataFrame, order: list[str]) -> DataFrame:
    """The replay of projects that nothing else touches, each in sequence."""
    needed = list(dict.fromkeys([*_PAYLOAD, "seq", "operation_id", *(c.lstrip("-") for c in order)]))
    dealt = requests.select(*needed).repartition("project_id")
    ordered = dealt.sortWithinPartitions("project_id", *sort_columns(order), "document_id", "seq")
    kept = ["document_id", "seq", "operation_id", "project_id", "base_revision", "is_deleted"]
    payload = F.to_json(F.struct(*_PAYLOAD)).alias("payload")
    kinds = {f.name: f for f in requests.schema.fields}
    was = [StructField("was_base_revision", kinds["base_revision"].dataType), StructField("was_project_id", kinds["project_id"].dataType)]
    marks = [StructField(n, BooleanType()) for n in ("committed", "earlier", "repeated")]
    out = StructType([*(kinds[c] for c in kept), *marks, *was])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, docs, holders, taken = _NONE, {}, {}, {}
        names = ["project_id", "document_id", "operation_id", "base_revision", "relative_path", "is_deleted", "payload"]
        for batch in batches:
            marked = []
            for own, doc, operation, base, path, gone, said in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if own != project:
                    project, docs, holders, taken = own, {}, {}, {}
                state = docs.get(doc)
                known = operation is not None and operation in taken
                same = known and taken[operation] == said
                fits = (base == 0 and gone is False) if state is None else base == state[0] + 1
                held = gone is False and path is not None and holders.get(path, doc) != doc
                # a document takes a request without an id once
                spent = operation is None and state is not None and state[2]
                if doc is not None and fits and not known and not held and not spent:
                    if state is not None and state[1] is not None:
                        del holders[state[1]]
                    place = path if gone is False else None
                    if place is not None:
                        holders[place] = doc
                    docs[doc] = (base, place, operation is None or (state is not None and state[2]))
                    if operation is not None:
                        taken[operation] = said
                    marked.append((True, False, False, None, None))
                else:
                    marked.append((False, known, same, None if state is None else state[0], None if state is None else own))
            done, known, same, base, own = zip(*marked, strict=True) if marked else ((),) * 5
            facts = [pa.array(done, pa.bool_()), pa.array(known, pa.bool_()), pa.array(same, pa.bool_())]
            facts += [pa.array(v, batch.schema.field(c).type) for v, c in ((base, "base_revision"), (own, "project_id"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *facts], names=out.names)

    judged = ordered.select(*kept, "relative_path", payload).mapInArrow(fold, out)
    return _outcomes(judged, F.col("earlier"), F.col("repeated"))


#: No project, not even the one without a name.
_NONE = object()


def _replay_in_rounds(requests: DataFrame, order: list[str]) -> DataFrame:
    """The replay of projects of any size, which may share documents and ids.

    Documents are replayed side by side, then told which of their requests met
    an id or a path that another commit held at that moment, and replayed
    without those, until nothing changes. A request's fate depends on earlier
    ones alone, so each round settles at least the next link of every chain of
    refusals, and what stays unchanged is what a replay in sequence gives.
    """
    # one sequence for all, as a number
    placed = with_row_number(requests.withColumn("_all", F.lit(1)), ["_all"], [*order, "document_id", "seq"], "at").drop("_all")
    shaped = durable(
        placed.withColumns(
            {
                "slot": F.col("project_id").cast("string"),
                "opens": F.array(F.col("project_id").cast("string")),
                "is_head": (F.col("base_revision") == 0) & ~F.col("is_deleted"),
            }
        )
    )
    keys = ["document_id", "seq"]
    paths, ids = _contended(shaped)
    done = durable(committed(shaped))
    blocked, asked_paths, asked_ids = None, paths, ids
    while True:
        commits = durable(shaped.join(done, keys, "left_semi").select(*keys, "at", *_PLACE, "is_deleted"))
        near = commits.join(asked_paths.select("document_id").distinct(), "document_id", "left_semi")
        met = _met_paths(asked_paths, near).union(_met_ids(asked_ids, commits))
        if blocked is None:
            met = durable(met)
            changed = met
        else:
            judged = asked_paths.select(*keys, F.lit("path").alias("by")).union(asked_ids.select(*keys, F.lit("id").alias("by")))
            met = durable(met.union(blocked.join(judged, [*keys, "by"], "left_anti")))
            changed = met.join(blocked, [*keys, "by"], "left_anti").union(blocked.join(met, [*keys, "by"], "left_anti"))
        again = durable(changed.select("document_id").distinct())
        if again.isEmpty():
            break
        # the other documents stand as they are, and so do refusals at paths and ids that these do not ask for
        free = shaped.join(again, "document_id", "left_semi").join(met, keys, "left_anti")
        done = durable(done.join(again, "document_id", "left_anti").unionByName(committed(free)))
        asked_paths, asked_ids = (durable(_asked_with(asked, again, place)) for asked, place in ((paths, _PLACE), (ids, ["operation_id"])))
        blocked = met
    commits = shaped.join(done, keys, "left_semi")
    judged = state_before(shaped, done, ["base_revision", "project_id"])
    taken = commits.groupBy(F.col("operation_id").alias("_operation")).agg(
        F.min_by(F.struct("at", F.struct(*_PAYLOAD).alias("payload"), F.col("base_revision") + 1), "at").alias("_taken")
    )
    joined = judged.join(taken, F.col("operation_id") == F.col("_operation"), "left")
    earlier = F.coalesce(F.col("_taken.at") < F.col("at"), F.lit(False))
    return _outcomes(joined, earlier, F.struct(*_PAYLOAD) == F.col("_taken.payload"))


_PLACE = ["project_id", "relative_path"]


def _contended(shaped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests for paths that several documents ask for, and for ids used more than once."""
    live = shaped.where(~F.col("is_deleted")).select("document_id", "seq", "at", *_PLACE)
    wanted = live.groupBy(*_PLACE).agg(F.min("document_id").alias("_low"), F.max("document_id").alias("_high"))
    paths = live.join(wanted.where("_low <> _high").drop("_low", "_high"), _PLACE, "left_semi")
    ids = shaped.select("document_id", "seq", "at", "operation_id")
    repeated = ids.groupBy("operation_id").count().where("count > 1").select("operation_id")
    return durable(paths), durable(ids.join(repeated, "operation_id", "left_semi"))


def _asked_with(asked: DataFrame, documents: DataFrame, place: list[str]) -> DataFrame:
    """All requests for what some documents ask for."""
    theirs = asked.join(documents, "document_id", "left_semi").select(*place).distinct()
    return asked.join(theirs, place, "left_semi")


def _met_paths(asked: DataFrame, commits: DataFrame) -> DataFrame:
    """``document_id, seq, by`` of requests whose path another document held when they came."""
    facts = commits.select("document_id", "seq", "at", *_PLACE, "is_deleted")
    # previous row in descending order: the document's next commit ends the hold
    ended = with_previous(facts, ["document_id"], ["-seq"], {"_end": "at"})
    hold = F.struct(F.col("_end").isNull().alias("open"), F.col("_end").alias("end"), F.col("document_id").alias("holder"))
    holds = ended.where(~F.col("is_deleted")).select(*_PLACE, "at", F.lit(1).alias("_kind"), hold.alias("_hold"))
    holds = holds.join(asked.select(*_PLACE).distinct(), _PLACE, "left_semi")
    both = asked.withColumn("_kind", F.lit(0)).unionByName(holds, allowMissingColumns=True)
    # of the holds begun before, the one that lasts longest is the one still on
    seen = with_running(both, _PLACE, ["at", "_kind"], {"_last": ("max", "_hold")}).where("_kind = 0")
    on = F.col("_last.open") | (F.col("_last.end") > F.col("at"))
    met = seen.where(on & (F.col("_last.holder") != F.col("document_id")))
    return met.select("document_id", "seq", F.lit("path").alias("by"))


def _met_ids(asked: DataFrame, commits: DataFrame) -> DataFrame:
    """``document_id, seq, by`` of requests whose id an earlier commit has."""
    first = asked.join(commits.select("document_id", "seq"), ["document_id", "seq"], "left_semi")
    first = first.groupBy("operation_id").agg(F.min("at").alias("_first"))
    met = asked.join(first, "operation_id").where("_first < at")
    return met.select("document_id", "seq", F.lit("id").alias("by"))


def commit_faults(requests: DataFrame) -> DataFrame:
    """First static fault of each document commit, null if none.

    Checks kind against base, sizes and digests; needs ``intent_kind,
    base_revision, is_deleted, name, structure_revision, content,
    content_bytes, content_sha256``.
    """
    kind, base, gone = F.col("intent_kind"), F.col("base_revision"), F.col("is_deleted")
    size = F.col("content_bytes")
    shape = (
        ~kind.isin("create", "update", "delete", "restore")
        | ~F.length("name").between(1, 255)
        | (F.col("structure_revision") < 1)
        | ~size.between(0, MAX_CONTENT_BYTES)
    )
    rules = (
        ((kind == "create") & ((base != 0) | gone))
        | ((kind != "create") & (base < 1))
        | ((kind == "update") & gone)
        | ((kind == "delete") & ~gone)
        | ((kind == "restore") & gone)
    )
    fault = (
        F.when(shape, "INVALID_ARGUMENT")
        .when(F.octet_length("content") != size, "CONTENT_SIZE_MISMATCH")
        .when(content_sha256(F.col("content")) != F.col("content_sha256"), "CONTENT_DIGEST_MISMATCH")
        .when(rules, "INVALID_ARGUMENT")
    )
    return requests.withColumn("fault", fault)


def document_commit_replay(requests: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Outcome of each document commit, in sequence per document.

    Needs the columns of :func:`commit_faults` and ``document_id, seq,
    project_id, operation_id, payload_digest, parent_id``. ``listed`` holds
    documents named by a tree order, which may not be deleted.
    """
    sound = F.col("fault").isNull()
    checked = with_verdict(commit_faults(requests).drop("content"), ["seq", "document_id"], sound)
    if listed is not None:
        checked = checked.join(
            listed.select("document_id", F.lit(True).alias("_listed")), "document_id", "left"
        )
    else:
        checked = checked.withColumn("_listed", F.lit(None).cast("boolean"))
    pinned = F.coalesce("_listed", F.lit(False)) & (F.col("intent_kind") == "delete")
    place = F.to_json(F.struct("project_id", "name", "parent_id", "structure_revision"))
    kind, sha = F.col("intent_kind"), F.col("content_sha256")
    slot = F.concat_ws(":", F.when(kind == "update", "update").otherwise(F.concat_ws(":", kind, sha)), place)
    live = F.array(F.concat_ws(":", F.lit("update"), place), F.concat_ws(":", F.lit("delete"), sha, place))
    dead = F.array(F.concat_ws(":", F.lit("restore"), sha, place))
    rule = {
        "slot": slot,
        "opens": F.when(F.col("is_deleted"), dead).otherwise(live),
        "is_head": kind == "create",
        "is_candidate": F.coalesce((F.col("verdict") == "first") & ~pinned, F.lit(False)),
    }
    facts = ["base_revision", "project_id", "name", "parent_id", "structure_revision", "is_deleted", "content_sha256"]
    asked = checked.select("document_id", "seq", "operation_id", "fault", "verdict", "intent_kind", "_listed", *facts)
    judged = replayed(asked, rule, facts)
    exists = F.col("was_base_revision").isNotNull()
    # a request that names no document is not told of its id
    named = F.col("document_id").isNotNull()
    moved = (
        (F.col("was_name") != F.col("name"))
        | ~F.col("was_parent_id").eqNullSafe(F.col("parent_id"))
        | (F.col("was_structure_revision") != F.col("structure_revision"))
    )
    outcome = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(named & (F.col("verdict") == "replay"), "replayed")
        .when(named & (F.col("verdict") == "reused"), "OPERATION_ID_REUSED")
        .when(F.col("committed"), "committed")
        .when((kind == "create") & exists, "DOCUMENT_ALREADY_EXISTS")
        .when(~exists | (F.col("was_project_id") != F.col("project_id")), "DOCUMENT_NOT_FOUND")
        .when(F.col("was_base_revision") + 1 != F.col("base_revision"), "REVISION_CONFLICT")
        .when(moved, "STRUCTURE_REVISION_CONFLICT")
        .when(kind.isin("update", "delete") & F.col("was_is_deleted"), "DOCUMENT_NOT_FOUND")
        .when(pinned, "INVARIANT_VIOLATION")
        .when((kind == "restore") & ~F.col("was_is_deleted"), "DOCUMENT_ALREADY_EXISTS")
        .otherwise("CONTENT_DIGEST_MISMATCH")
    )
    return judged.withColumn("outcome", outcome).select(
        "document_id",
        "seq",
        "operation_id",
        "outcome",
        F.when(F.col("outcome") == "committed", F.col("base_revision") + 1).alias("revision"),
    )


def rate_limit_large(
    snapshots: DataFrame, large: int = 1024 * 1024, seconds: int = 300
) -> DataFrame:
    """Automatic snapshots kept when large ones wait 300 s after the last kept.

    Small automatic snapshots are always kept, and so is one that follows the
    one before it by 300 s or more. Such rows open stretches that do not touch
    each other; inside a stretch each large save has one fixed successor.
    """
    automatic = snapshots.where("reason = 'automaticSave'")
    timed = automatic.withColumn("_at", F.unix_micros(F.col("created_at").cast("timestamp")))
    before = with_previous(timed, ["document_id"], ["_at", "backup_id"], {"_prior": "_at"})
    gap = seconds * 1_000_000
    sure = (
        (F.col("byte_count") < large) | F.col("_prior").isNull() | (F.col("_at") - F.col("_prior") >= gap)
    )
    marked = durable_segments(before.withColumn("_sure", sure))
    # chain nodes are the first row at each instant of a stretch
    keys = ["document_id", "_stretch"]
    nodes = marked.groupBy(*keys, "_at").agg(
        F.min("backup_id").alias("backup_id"), F.max("_sure").alias("_sure")
    )
    nodes = nodes.withColumn("id", F.struct(*keys, "_at"))
    small, heavy = split_by_size(nodes, "document_id")
    kept = _kept_by_fold(small, keys, gap)
    if heavy is not None:
        probes = heavy.select(*keys, (F.col("_at") + gap).alias("_at"), F.col("id").alias("probe_id"))
        ahead = next_at_or_after(heavy, probes, keys, "_at").select(F.col("probe_id").alias("id"), "next_at")
        links = heavy.join(ahead, "id", "left").select(
            "id",
            F.when(F.col("next_at").isNotNull(), F.struct(*keys, F.col("next_at").alias("_at"))).alias("next_id"),
            F.col("_sure").alias("is_head"),
        )
        kept = kept.unionByName(follow(links).select("id.*"))
    chosen = nodes.join(kept, [*keys, "_at"], "left_semi").select("backup_id")
    large_kept = automatic.join(chosen, "backup_id", "left_semi")
    # several small saves may share an instant; each of them is kept
    others = automatic.where(F.col("byte_count") < large).join(chosen, "backup_id", "left_anti")
    return large_kept.unionByName(others)


def durable_segments(marked: DataFrame) -> DataFrame:
    """Number the stretches that start at sure rows, per document."""
    one = marked.withColumn("_one", F.col("_sure").cast("long"))
    return with_running(one, ["document_id"], ["_at", "backup_id"], {"_stretch": ("sum", "_one")}).drop("_one")


def _kept_by_fold(nodes: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """The greedy rule over the ordered instants of each stretch; the last kept one is all its state."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = None, 0
        for batch in batches:
            kept = []
            for *key, at in batch.itertuples(index=False, name=None):
                take = key != here or at - last >= gap
                here, last = key, at if take else last
                kept.append(take)
            yield batch[kept]

    instants = nodes.select(*keys, "_at")
    ordered = instants.repartition(*keys).sortWithinPartitions(*keys, "_at")
    return ordered.mapInPandas(keep, instants.schema)


# --- conflicts and batches ------------------------------------------------------------


def path_ownership(current: DataFrame) -> DataFrame:
    """Live paths held by more than one document of a project."""
    live = current.where(~F.col("is_deleted"))
    held = live.select("project_id", "relative_path", "document_id").distinct()
    return held.groupBy("project_id", "relative_path").agg(
        F.count("*").alias("holders"), F.min("document_id").alias("first_holder")
    ).where("holders > 1")


def revision_conflicts(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requests whose base is not the document's current revision."""
    now = current.select("document_id", F.col("revision").alias("current_revision"))
    return requests.join(now, "document_id").where(F.col("base_revision") != F.col("current_revision"))


def batch_outcome(intents: DataFrame) -> DataFrame:
    """A batch applies whole or not at all; where it first failed.

    Needs ``batch_id, sequence, code`` with a null code for success.
    """
    failed = F.col("code").isNotNull()
    return intents.groupBy("batch_id").agg(
        F.count("*").alias("intents"),
        F.min(F.when(failed, F.col("sequence"))).alias("failed_sequence"),
        F.min_by("code", F.when(failed, F.col("sequence"))).alias("code"),
    ).withColumn("applied", F.col("failed_sequence").isNull())


# --- event log ------------------------------------------------------------------------


def event_append_rules(events: DataFrame, arrival: list[str]) -> DataFrame:
    """What happens to each event offered to the log, in arrival order.

    ``appended`` with its sequence; ``replayed`` for an identical event id,
    with the sequence of the first; ``EVENT_ID_REUSED`` for a different one;
    ``OPERATION_TERMINAL`` after the operation closed. An id whose first offer
    was refused stays refused, also for another operation.
    """
    payload = F.struct("operation_id", "event_type")
    ranked = events.withColumns({"_at": F.struct(*arrival), "_payload": payload})
    first = ranked.groupBy("event_id").agg(F.min("_at").alias("_first_at"))
    ranked = ranked.join(first, "event_id").withColumn("_is_first", F.col("_at") == F.col("_first_at"))
    closing = F.col("_is_first") & F.col("event_type").isin(TERMINAL_EVENTS)
    closed = ranked.groupBy("operation_id").agg(F.min(F.when(closing, F.col("_at"))).alias("_closed_at"))
    ranked = ranked.join(closed, "operation_id", "left")
    open_still = F.col("_closed_at").isNull() | (F.col("_at") <= F.col("_closed_at"))
    accepted = F.col("_is_first") & open_still
    numbered = with_running(
        ranked.withColumn("_one", accepted.cast("long")),
        ["operation_id"],
        arrival,
        {"_sequence": ("sum", "_one")},
    )
    kept = numbered.where(accepted).select(
        "event_id", F.col("_payload").alias("_kept"), F.col("_sequence").alias("_kept_sequence")
    )
    joined = numbered.join(kept, "event_id", "left")
    same = F.col("_payload") == F.col("_kept")
    outcome = (
        F.when(accepted, "appended")
        .when(~F.col("_is_first") & F.col("_kept").isNotNull() & same, "replayed")
        .when(~F.col("_is_first") & F.col("_kept").isNotNull(), "EVENT_ID_REUSED")
        .otherwise("OPERATION_TERMINAL")
    )
    sequence = F.when(F.col("outcome") == "appended", F.col("_sequence")).when(
        F.col("outcome") == "replayed", F.col("_kept_sequence")
    )
    return joined.withColumn("outcome", outcome).withColumn("sequence", sequence).drop(
        "_at", "_payload", "_first_at", "_is_first", "_closed_at", "_one", "_sequence", "_kept", "_kept_sequence"
    )


def cancel_states(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Answer to each cancel request: ``operation_id, event_id, seq``.

    ``states`` gives ``operation_id, state``. Repeats of a cancel are
    answered, not applied again.
    """
    joined = requests.join(states.select("operation_id", "state"), "operation_id", "left")
    first_of_id = top_rows(joined, ["event_id"], ["seq"], 1).select(
        "event_id", F.col("operation_id").alias("_owner"), F.col("seq").alias("_id_seq")
    )
    open_state = ~F.coalesce(F.col("state"), F.lit("")).isin(DONE) & F.col("state").isNotNull()
    first_of_op = (
        joined.where(open_state).groupBy("operation_id").agg(F.min("seq").alias("_op_seq"))
    )
    judged = joined.join(first_of_id, "event_id").join(first_of_op, "operation_id", "left")
    answer = (
        F.when(F.col("state").isNull(), "INVALID_ARGUMENT")
        .when((F.col("seq") > F.col("_id_seq")) & (F.col("_owner") != F.col("operation_id")), "EVENT_ID_REUSED")
        .when(F.col("state") == "completed", "OPERATION_TERMINAL")
        .when(F.col("state") == "cancelled", "already_cancelled")
        .when(F.col("seq") == F.col("_op_seq"), "cancelled")
        .otherwise("already_cancelled")
    )
    return judged.select("operation_id", "event_id", "seq", answer.alias("answer"))


# Retry delays in seconds.
INITIAL_DELAY, MAX_DELAY, JITTER, LEASE_DELAY, MAX_EXPONENT = 2.0, 300.0, 0.2, 3.0, 30


def expected_delay(attempt: Column, code: Column) -> Column:
    """Delay before the next attempt, without jitter."""
    exponent = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(MAX_EXPONENT))
    backoff = F.least(F.lit(MAX_DELAY), F.lit(INITIAL_DELAY) * F.pow(F.lit(2.0), exponent.cast("double")))
    return F.when(code == "LEASE_CONFLICT", F.lit(LEASE_DELAY)).otherwise(backoff)


def retry_audit(attempts: DataFrame, order: list[str]) -> DataFrame:
    """Attempts that came earlier or later than their retry delay allows.

    Needs ``operation_id, attempt, error_code, at_seconds`` in ``order``.
    """
    marked = with_previous(
        attempts,
        ["operation_id"],
        order,
        {"_before": "at_seconds", "_attempt": "attempt", "_code": "error_code"},
    )
    delay = expected_delay(F.col("_attempt"), F.col("_code"))
    jitter = F.when(F.col("_code").eqNullSafe("LEASE_CONFLICT"), 0.0).otherwise(JITTER)
    gap = (F.col("at_seconds") - F.col("_before")).cast("double")
    outside = (gap < delay * (1 - jitter)) | (gap > delay * (1 + jitter))
    return (
        marked.where("_before IS NOT NULL")
        .withColumns({"expected_seconds": delay, "gap_seconds": gap})
        .where(outside)
        .drop("_before", "_attempt", "_code")
    )


# How each failure code is handled; the last column marks automatic rebase.
FAILURE_HANDLING = [
    ("NETWORK_UNAVAILABLE", "retry", False),
    ("TIMEOUT", "retry", False),
    ("INVALID_RESPONSE", "retry", False),
    ("SERVER_REJECTED", "retry", False),
    ("AUTH_REQUIRED", "retry", False),
    ("LEASE_REQUIRED", "retry", False),
    ("LEASE_CONFLICT", "retry", False),
    ("LEASE_EXPIRED", "retry", False),
    ("FORBIDDEN", "blocked", False),
    ("INVALID_ARGUMENT", "blocked", False),
    ("DOCUMENT_NOT_FOUND", "conflict", False),
    ("DOCUMENT_ALREADY_EXISTS", "conflict", True),
    ("REVISION_CONFLICT", "conflict", True),
    ("OPERATION_ID_REUSED", "conflict", False),
    ("PATH_CONFLICT", "conflict", False),
    ("FOLDER_NOT_FOUND", "conflict", False),
    ("FOLDER_ALREADY_EXISTS", "conflict", False),
    ("FOLDER_NOT_EMPTY", "conflict", False),
]


def failure_breakdown(attempts: DataFrame) -> DataFrame:
    """Failures per project by handling; unknown codes are retried."""
    handling = attempts.sparkSession.createDataFrame(
        FAILURE_HANDLING, "error_code string, handling string, rebase boolean"
    )
    failed = attempts.where("error_code IS NOT NULL").groupBy("project_id", "error_code").agg(
        F.count("*").alias("n")
    )
    return (
        failed.join(F.broadcast(handling), "error_code", "left")
        .groupBy(
            "project_id",
            F.coalesce("handling", F.lit("retry")).alias("handling"),
            F.coalesce("rebase", F.lit(False)).alias("rebase_candidate"),
        )
        .agg(F.sum("n").alias("failures"))
    )


# --- queue ----------------------------------------------------------------------------


def stuck_work(ops: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """Operations a restart would requeue, and how.

    Needs ``queue_id, document_id, status, error_code, created_at``;
    ``open_conflicts`` holds ``document_id`` of unresolved conflicts.
    """
    heads = lane_heads(ops, ["document_id"], ["created_at", "queue_id"]).select(
        "queue_id", F.lit(True).alias("_head")
    )
    conflicts = open_conflicts.select("document_id").distinct().withColumn("_open", F.lit(True))
    joined = unfinished(ops).join(heads, "queue_id", "left").join(conflicts, "document_id", "left")
    head = F.coalesce("_head", F.lit(False))
    open_conflict = F.coalesce("_open", F.lit(False))
    status, error = F.col("status"), F.col("error_code")
    action = (
        F.when(status == "inflight", "pending")
        .when((status == "conflict") & (error == "DOCUMENT_NOT_FOUND") & head, "createAtZero")
        .when((status == "blocked") & (error == "FORBIDDEN") & head, "pending")
        .when(
            (status == "conflict") & error.isin("LEASE_CONFLICT", "DOCUMENT_ALREADY_EXISTS") & ~open_conflict,
            "pending",
        )
    )
    return joined.withColumn("action", action).where("action IS NOT NULL").select(
        "queue_id", "document_id", "status", "error_code", "action"
    )


def drop_noops(saves: DataFrame, state: DataFrame, ops: DataFrame) -> DataFrame:
    """Saves that change nothing, with the reason.

    ``saves``: ``save_id, document_id, relative_path, content_hash``;
    ``state``: ``document_id, base_path, base_hash, server_revision,
    is_deleted``; ``ops``: the queue.
    """
    busy = unfinished(ops).select("document_id").distinct().withColumn("_busy", F.lit(True))
    joined = saves.join(state, "document_id").join(busy, "document_id", "left")
    same = (
        (F.col("server_revision") > 0)
        & (F.col("relative_path") == F.col("base_path"))
        & (F.col("content_hash") == F.col("base_hash"))
        & F.col("_busy").isNull()
    )
    reason = F.when(F.col("is_deleted"), "documentDeleted").when(same, "unchanged")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select(
        "save_id", "document_id", "reason"
    )


def coalesce_tree_orders(ops: DataFrame) -> DataFrame:
    """Tree orders a newer one of the same document replaces."""
    waiting = ops.where(
        (F.col("operation_kind") == "treeOrder") & F.col("status").isin("pending", "retry_wait", "blocked")
    )
    latest = newest(waiting, ["document_id"], ["created_at", "queue_id"]).select(
        "document_id", F.col("queue_id").alias("kept_queue_id")
    )
    return waiting.join(latest, "document_id").where("queue_id <> kept_queue_id").select(
        "queue_id", "document_id", "kept_queue_id"
    )


def rebase_ops(ops: DataFrame, remote: DataFrame) -> DataFrame:
    """Conflicting lanes on a new base: the newest goes on, the rest are cancelled.

    ``remote``: ``document_id, revision``.
    """
    conflicted = ops.where("status = 'conflict' AND error_code = 'REVISION_CONFLICT'").select("document_id").distinct()
    lane = unfinished(ops).join(conflicted, "document_id", "left_semi")
    last = newest(lane, ["document_id"], ["created_at", "queue_id"]).select(
        "document_id", F.col("queue_id").alias("_last")
    )
    joined = lane.join(last, "document_id").join(
        remote.select("document_id", F.col("revision").alias("_remote")), "document_id"
    )
    successor = F.col("queue_id") == F.col("_last")
    return joined.select(
        "queue_id",
        "document_id",
        F.when(successor, "pending").otherwise("cancelled").alias("new_status"),
        F.when(successor, F.col("_remote")).otherwise(F.col("base_revision")).alias("new_base"),
    )


def resolve_report(conflicts: DataFrame) -> DataFrame:
    """Whether each resolution carries the text it claims to.

    Needs ``conflict_id, resolution, chosen_hash, local_hash, remote_hash``.
    """
    wanted = F.when(F.col("resolution") == "keep_local", F.col("local_hash")).when(
        F.col("resolution") == "use_remote", F.col("remote_hash")
    )
    state = F.when(wanted.isNull(), "unresolved").when(wanted == F.col("chosen_hash"), "valid").otherwise("mismatch")
    return conflicts.withColumn("check", state)


# --- pull and baseline ----------------------------------------------------------------


def pull_decisions(
    snapshots: DataFrame, state: DataFrame, flags: DataFrame, editing: DataFrame, purges: DataFrame | None = None
) -> DataFrame:
    """Outcome and reason of every pulled snapshot, by the first rule that holds.

    ``snapshots``: ``document_id, revision, is_deleted``; ``state``:
    ``document_id, server_revision``; ``flags``: see ``document_flags`` plus
    ``has_open_conflict``; ``editing``: ``document_id, is_composing, is_dirty,
    is_open``; ``purges``: ``document_id, purge_revision``.
    """
    joined = (
        snapshots.join(state.select("document_id", "server_revision"), "document_id", "left")
        .join(flags, "document_id", "left")
        .join(editing, "document_id", "left")
    )
    if purges is not None:
        joined = joined.join(purges.select("document_id", "purge_revision"), "document_id", "left")
    else:
        joined = joined.withColumn("purge_revision", F.lit(None).cast("bigint"))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    blocked = F.col("blocked_code").isNotNull()
    known = F.col("server_revision").isNotNull()
    stale = known & (F.col("revision") <= F.col("server_revision"))
    purged = F.col("is_deleted") & F.coalesce(F.col("purge_revision") >= F.col("revision"), F.lit(False))
    stale_reason = (
        F.when(flag("has_open_conflict"), "unresolvedConflict")
        .when(blocked, "blockedOperation")
        .when(flag("has_path_conflict"), "pathOccupied")
        .when(flag("has_unfinished"), "pendingOperation")
    )
    fresh_reason = (
        F.when(known & flag("has_open_conflict"), "unresolvedConflict")
        .when(known & blocked, "blockedOperation")
        .when(known & flag("has_unfinished"), "pendingOperation")
        .when(flag("is_composing"), "markedTextComposition")
        .when(flag("is_dirty"), "dirtyEditor")
        .when(F.col("is_deleted") & flag("is_open"), "remoteDeletion")
    )
    reason = F.when(stale, stale_reason).otherwise(fresh_reason)
    outcome = (
        F.when(F.col("reason").isNotNull(), "mergeRequired")
        .when(stale, "upToDate")
        .when(purged, "baselineOnly")
        .otherwise("applied")
    )
    return joined.withColumn("reason", reason).select("document_id", "revision", outcome.alias("outcome"), "reason")


def purge_eligible(snapshots: DataFrame, purges: DataFrame) -> DataFrame:
    """Deleted snapshots a purge covers."""
    limits = purges.select("document_id", "purge_revision")
    return snapshots.where("is_deleted").join(limits, "document_id").where("revision <= purge_revision")


def apply_baseline(state: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Next baseline: newer revisions win unless their path is another's.

    Both sides: ``document_id, revision, relative_path, content_hash,
    is_deleted``. The result is a whole new version of the table.
    """
    columns = ["revision", "relative_path", "content_hash", "is_deleted"]
    owners = state.where(~F.col("is_deleted")).groupBy("relative_path").agg(
        F.min("document_id").alias("_low"), F.max("document_id").alias("_high")
    )
    incoming = snapshots.join(owners, "relative_path", "left")
    other = F.col("_low").isNotNull() & (
        (F.col("_low") != F.col("document_id")) | (F.col("_high") != F.col("document_id"))
    )
    usable = incoming.where(F.col("is_deleted") | ~other).select(
        "document_id", *[F.col(c).alias(f"_n_{c}") for c in columns]
    )
    joined = state.join(usable, "document_id", "full_outer")
    newer = F.col("_n_revision").isNotNull() & (
        F.col("revision").isNull() | (F.col("_n_revision") > F.col("revision"))
    )
    return joined.select(
        "document_id", *[F.when(newer, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    )


# --- contracts and acknowledgements ---------------------------------------------------


def legacy_boundary(versions: DataFrame, projects: DataFrame, batches: DataFrame) -> DataFrame:
    """Versions of non-legacy projects that no contract batch explains."""
    modern = projects.where("mode <> 'LEGACY'").select("project_id")
    return versions.join(modern, "project_id", "left_semi").join(
        batches.select("operation_id"), "operation_id", "left_anti"
    )


def acknowledgement_audit(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that do not answer the request they name.

    Requests: ``operation_id, document_id, relative_path, is_deleted, content,
    base_revision``. Responses: ``operation_id`` and ``r_document_id,
    r_relative_path, r_is_deleted, r_content_hash, r_revision, r_kind``.
    """
    joined = requests.join(responses, "operation_id")
    creating = F.col("base_revision") == 0
    problem = (
        F.when(F.col("r_document_id") != F.col("document_id"), "documentId")
        .when(F.col("r_relative_path").cast("binary") != F.col("relative_path").cast("binary"), "relativePath")
        .when(F.col("r_is_deleted") != F.col("is_deleted"), "deletionFlag")
        .when(F.col("r_content_hash") != content_sha256(F.col("content")), "contentHash")
        .when(F.col("r_revision") != F.col("base_revision") + 1, "revision")
        .when(creating != (F.col("r_kind") == "create"), "operationKind")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("operation_id", "problem")


def initial_snapshot(documents: DataFrame, projects: DataFrame, orders: DataFrame) -> DataFrame:
    """Everything a first upload sends: project, documents by path, tree order."""
    first = projects.select(
        F.lit(0).cast("long").alias("stage"), "project_id", F.lit(None).cast("string").alias("relative_path"),
        F.lit("ensure").alias("kind"), F.lit(None).cast("string").alias("content_hash"),
    )
    middle = documents.select(
        F.lit(1).cast("long").alias("stage"), "project_id", "relative_path", F.lit("create").alias("kind"),
        content_sha256(F.col("text")).alias("content_hash"),
    )
    last = orders.select(
        F.lit(2).cast("long").alias("stage"), "project_id", F.lit(None).cast("string").alias("relative_path"),
        F.lit("reorder").alias("kind"), content_sha256(F.col("tree_order")).alias("content_hash"),
    )
    return first.unionByName(middle).unionByName(last).orderBy("project_id", "stage", "relative_path")


def restore_candidates(snapshots: DataFrame, contents: DataFrame, documents: DataFrame) -> DataFrame:
    """Snapshots fit to restore, each as the two rows a restore writes.

    The snapshot must name the document's project and carry the hash of its
    own content. ``contents``: ``backup_id, text``; ``documents``:
    ``document_id, project_id, text, generation``.
    """
    stored = snapshots.join(contents, "backup_id").where(
        content_sha256(F.col("text")) == F.col("content_hash")
    )
    now = documents.select(
        "document_id", "project_id", content_sha256(F.col("text")).alias("_current"), "generation"
    )
    fit = stored.join(now, ["document_id", "project_id"])
    rows = F.array(
        F.struct(F.lit("beforeRestore").alias("row_kind"), F.col("_current").alias("row_hash"), F.col("generation").alias("row_generation")),
        F.struct(F.lit("restored").alias("row_kind"), F.col("content_hash").alias("row_hash"), (F.col("generation") + 1).alias("row_generation")),
    )
    return fit.select("backup_id", "document_id", F.inline(rows))



def numbered_requests(requests: DataFrame, order: list[str]) -> DataFrame:
    """Arrival numbers per document, for the replays."""
    return with_row_number(requests, ["document_id"], order, "seq")
