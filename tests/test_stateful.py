"""Streams, leases, replays: against plain loops over the same rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.operators.chains import committed, committed_by_links
from quire.plans import leases as Z, ledger as L
from quire.session import disk_state
from quire.streaming import changes as K
from quire.streaming.ordered import settled
from tests.conftest import rows

T0 = dt.datetime(2026, 1, 1)


def _stream(spark, tmp_path, data, schema, parts=3):
    """The rows as a file stream, one micro-batch per file."""
    path = tmp_path / "in"
    size = -(-len(data) // parts)
    for i in range(parts):
        chunk = data[i * size : (i + 1) * size]
        if chunk:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(df, name, tmp_path, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_change_feed_tail_and_dedupe(spark, tmp_path):
    folder = tmp_path / "feed"
    data = [("p", "d1", "update", 1, T0), ("p", "d1", "update", 2, T0), ("q", "d2", "insert", 1, T0)]
    spark.createDataFrame(data, K.CHANGE_SCHEMA).write.json(str(folder))
    out = _run(K.read_change_feed(spark, str(folder), "p"), "feed", tmp_path)
    assert rows(out.select("document_id", "revision")) == [("d1", 1), ("d1", 2)]
    snapshot = spark.createDataFrame([("d1", 2), ("d1x", 1), ("d3", 5)], "document_id string, revision bigint")
    assert rows(K.tail_changes(out, snapshot)) == [("d1x", 1), ("d3", 5)]
    twice = [(str(i % 4), T0 + dt.timedelta(seconds=i)) for i in range(12)]
    events = _stream(spark, tmp_path, twice, "event_id string, ts timestamp")
    assert rows(_run(K.dedupe_events(events), "deduped", tmp_path).select("event_id")) == [("0",), ("1",), ("2",), ("3",)]


def test_bursts_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    data = sorted(
        ((f"d{rng.randrange(3)}", T0 + dt.timedelta(milliseconds=100 * rng.randrange(900)), f"c{i}") for i in range(120)), key=lambda r: r[1]
    )
    data = list({(d, t): (d, t, c) for d, t, c in data}.values())
    schema = "document_id string, ts timestamp, change string"
    batch = rows(K.debounced_bursts(spark.createDataFrame(data, schema)))
    closing = data + [("zz", T0 + dt.timedelta(hours=1), "end")]
    stream = _run(K.debounced_bursts(_stream(spark, tmp_path, closing, schema), delay="1 second"), "bursts", tmp_path)
    assert rows(stream.where("document_id <> 'zz'")) == batch


@pytest.fixture
def small_frames(spark):
    """Python sees five rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _shuffled(spark, tmp_path, data, schema, seed):
    """The rows in any order over five files, one micro-batch each."""
    return _stream(spark, tmp_path, random.Random(seed).sample(data, len(data)), schema, parts=5)


def test_save_state_drops_stale_generations(spark, tmp_path, small_frames):
    rng = random.Random(7)
    kinds = {"edited": "editing", "saveStarted": "saving", "saveSucceeded": "saved", "saveFailed": "failed"}
    data = [(f"d{rng.randrange(2)}", rng.randrange(30), rng.choice(list(kinds)), T0 + dt.timedelta(microseconds=rng.randrange(10**8))) for _ in range(150)]
    data += [(None, 1, "edited", T0), ("d0", 99, "edited", None)]  # a null key is a key, an event without a time is none
    want, last = [], {}
    for doc, generation, kind, at in sorted((r for r in data if r[3]), key=lambda r: (str(r[0]), r[3], r[1], r[2])):
        newest, shown = last.get(doc, (None, None))
        stale = newest is not None and generation < newest
        newest, shown = (newest, shown) if stale else (generation, kinds[kind])
        last[doc] = (newest, shown)
        want.append((doc, generation, kind, at, stale, shown))
    events = _shuffled(spark, tmp_path, data, "document_id string, generation bigint, event string, ts timestamp", 1)
    out = settled(events, "ts", lambda feed: K.save_state(feed, "1 hour"))
    assert rows(out) == sorted(want, key=lambda r: tuple(str(v) for v in r))


def test_events_wait_for_the_watermark(spark, tmp_path):
    data = [("d", i, "edited", T0 + dt.timedelta(minutes=10 * i)) for i in range(6)]
    events = _stream(spark, tmp_path, data, "document_id string, generation bigint, event string, ts timestamp", parts=6)
    with disk_state(spark):
        out = _run(K.save_state(events, "15 minutes"), "waiting", tmp_path)
    # the newest event is at 50 minutes, so those up to 35 are settled
    assert sorted(r.generation for r in out.collect()) == [0, 1, 2, 3]


class _Calls:
    """A state store of one key that counts the calls made to it."""

    def __init__(self):
        self.calls, self.values, self.state = 0, [], None

    def getListState(self, name, schema):
        return self

    getValueState = getListState

    def _counted(self, found=None):
        self.calls += 1
        return found

    def appendList(self, values):
        self._counted(self.values.extend(values))

    def appendValue(self, value):
        self.appendList([value])

    def registerTimer(self, at):
        self._counted()

    def exists(self):
        return self._counted(False)

    def get(self):
        return self._counted(list(self.values) or None)

    update = clear = deleteTimer = registerTimer


def test_events_of_a_key_wait_in_few_calls_and_values():
    from pyspark.sql import Row
    from quire.streaming.ordered import Rule, _Ordered

    rule = Rule("last bigint", "name string", lambda state, event: (state, []))
    processor, store = object.__new__(_Ordered), _Calls()
    processor.rule, processor.keys, processor.order = rule, 1, 1
    processor.init(store)
    rows = [Row(key="d", tick=False, step=None, at=list(range(i, i + 500)), name=["n"] * 500) for i in (1000, 500, 0)]
    assert list(processor.handleInputRows(("d",), iter(rows), None)) == []
    assert store.calls <= 3 and len(store.values) == 1


def test_events_of_a_key_and_step_are_gathered(spark):
    import pyarrow as pa
    from quire.streaming.ordered import TICK, _gathered

    rng = random.Random(8)
    data = [(rng.choice([None, 2**60 + 1, 2**60 + 2]), False, rng.randrange(3), i, rng.choice([None, "a"])) for i in range(900)]
    names = ["key", TICK, "_step", "_at", "name"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    frames = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*data[i : i + 7]), kinds)], names) for i in range(0, 900, 7)]
    out = [r for b in _gathered(iter(frames), ["key"]) for r in b.to_pylist()]
    assert len(out) == 9
    back = [(r["key"], r[TICK], r["_step"], at, name) for r in out for at, name in zip(r["_at"], r["name"])]
    assert sorted(back, key=lambda r: r[3]) == data


def test_events_within_the_delay_are_not_late(spark, tmp_path):
    """Steps of the watermark leave out no event that is on time, and keep none that is long past."""
    at = lambda seconds: T0 + dt.timedelta(seconds=seconds)
    data = [("d", 1, "edited", at(100.999)), ("d", 2, "edited", at(100.5)), ("d", 3, "edited", at(85.0)), ("d", 4, "edited", at(80.0)), ("d", 5, "edited", at(84.999001))]
    schema = "document_id string, generation bigint, event string, ts timestamp"
    path = tmp_path / "in"
    for part in (data[:1], data[1:2], data[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    out = settled(events, "ts", lambda feed: K.save_state(feed, "16 seconds"))
    assert [r.generation for r in out.orderBy("ts").collect()] == [5, 3, 2, 1]


def test_rate_limit_stream_equals_batch(spark, tmp_path, small_frames):
    rng = random.Random(4)
    data = [(f"d{rng.randrange(2)}", f"b{i:03d}", T0 + dt.timedelta(seconds=rng.randrange(9000)), rng.choice([5, 2_000_000]), "automaticSave") for i in range(150)]
    schema = "document_id string, backup_id string, created_at timestamp, byte_count bigint, reason string"
    batch = rows(L.rate_limit_large(spark.createDataFrame(data, schema)).select("backup_id"))
    taken = _shuffled(spark, tmp_path, data, schema, 2)
    stream = settled(taken, "created_at", lambda feed: K.rate_limited_snapshots(feed, delay="1 day"))
    assert rows(stream.select("backup_id")) == batch


def test_operation_states_stream(spark, tmp_path, small_frames):
    kinds = ["enqueued", "dispatch_started", "committed", "retry_scheduled"]
    data = [("o", f"e{i}", kind, T0 + dt.timedelta(seconds=i)) for i, kind in enumerate(kinds)]
    data += [("p", f"p{i:02d}", "retry_scheduled", T0 + dt.timedelta(seconds=i)) for i in range(30)] + [("p", "p99", "superseded", T0 + dt.timedelta(seconds=20, microseconds=1))]
    events = _shuffled(spark, tmp_path, data, "operation_id string, event_id string, event_type string, ts timestamp", 3)
    out = settled(events, "ts", lambda feed: K.operation_states(feed, "1 hour")).orderBy("event_id").collect()
    first = [(r.event_sequence, r.state, r.late) for r in out if r.operation_id == "o"]
    assert first == [(1, "pending", False), (2, "inflight", False), (3, "completed", False), (None, "completed", True)]
    second = {r.event_id: (r.event_sequence, r.state, r.late) for r in out if r.operation_id == "p"}
    assert second["p20"] == (21, "retry_wait", False) and second["p99"] == (22, "cancelled", False) and second["p21"] == (None, "cancelled", True)


def test_lease_stream_equals_timeline(spark, tmp_path, small_frames):
    rng = random.Random(9)
    data = [(f"d{rng.randrange(2)}", i, f"u{rng.randrange(3)}", rng.choice(["acquire"] * 4 + ["release"]), rng.randrange(10, 200), T0 + dt.timedelta(seconds=rng.randrange(6000))) for i in range(200)]
    schema = "document_id string, lease_event_id bigint, user_id string, action string, ttl_seconds int, ts timestamp"
    own = lambda df: df.withColumns({"device_id": F.lit("x"), "holder": F.concat("user_id", F.lit("/x"))})
    events = own(_shuffled(spark, tmp_path, data, schema, 4))
    out = settled(events, "ts", lambda feed: K.lease_state(feed, "1 day"))
    columns = ["lease_event_id", "document_id", "holder", "at", "result", "expires_at"]
    timeline = Z.lease_timeline(own(spark.createDataFrame(data, schema)))
    assert rows(out.where("result <> 'expired'").select(columns)) == rows(timeline.select(columns))
    # every lease that was granted ends in a release, a renewal or an end of its own
    expired = out.where("result = 'expired'").collect()
    assert expired and all(r.lease_event_id is None and r.at == r.expires_at for r in expired)
    given = [r for r in timeline.collect() if r.result in ("acquired", "renewed")]
    assert {(r.document_id, r.holder, r.at) for r in expired} <= {(r.document_id, r.holder, r.expires_at) for r in given}
    assert len([r for r in given if r.result == "acquired"]) == len(expired) + timeline.where("result = 'released'").count()


def test_tail_pulls_what_the_feed_missed(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("a", 1, at(0)), ("a", 2, at(1))], [("b", 1, at(30))], [("b", 2, at(100)), ("b", 2, at(100))]]
    now = iter([[("a", 2)], [("a", 3), ("b", 2), ("c", 7)], [("a", 9), ("b", 2), ("c", 7)]])
    schema = "document_id string, revision bigint, ts timestamp"
    path, folder = str(tmp_path / "in"), str(tmp_path / "tail")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    pull = lambda: spark.createDataFrame(next(now), "document_id string, revision bigint")
    out = K.tail_with_pulls(feed, pull, folder)
    want = [("a", 1, "feed", 0), ("a", 2, "feed", 0), ("b", 1, "feed", 1), ("b", 2, "feed", 2), ("a", 3, "pull", 2), ("c", 7, "pull", 2)]
    assert rows(out) == sorted(want, key=str)
    # a later run goes on from the kept table
    spark.createDataFrame([("c", 8, at(200))], schema).coalesce(1).write.mode("append").parquet(path)
    assert rows(K.tail_with_pulls(feed, pull, folder).where("batch > 2")) == [("a", 9, "pull", 3), ("c", 8, "feed", 3)]


def _brute_leases(events):
    out, held = {}, {}
    for doc, at, event, who, action, ttl in sorted(events):
        holder, end = held.get(doc, (None, -1))
        if holder is not None and end <= at:
            holder = None
        if action == "release":
            out[event] = "released" if holder == who else "notHeld"
            holder = None if holder == who else holder
        elif holder not in (None, who):
            out[event] = "LEASE_CONFLICT"
        else:
            out[event] = "renewed" if holder == who else "acquired"
            holder, end = who, at + max(30, min(ttl, 120))
        held[doc] = (holder, end)
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_lease_timeline_by_brute_force(spark, tight):
    rng = random.Random(9)
    events = [(f"d{rng.randrange(3)}", rng.randrange(9000), i, f"u{rng.randrange(3)}", rng.choice(["acquire"] * 4 + ["release"]), rng.randrange(10, 200)) for i in range(700)]
    df = spark.createDataFrame(events, "document_id string, at bigint, lease_event_id bigint, user_id string, action string, ttl_seconds int").select(
        "document_id", "lease_event_id", "user_id", F.lit("x").alias("device_id"), "action", "ttl_seconds", F.timestamp_seconds("at").alias("ts")
    )
    if tight:
        spark.conf.set("quire.taskBytes", "0")
        spark.conf.set("quire.taskRows", "5")
    try:
        timeline = Z.lease_timeline(df)
        assert {r.lease_event_id: r.result for r in timeline.collect()} == _brute_leases(events)
        state = Z.lease_state_at(timeline, F.timestamp_seconds(F.lit(4500)), "u0/x")
        found = {r.document_id: r.state for r in state.collect()}
    finally:
        spark.conf.unset("quire.taskBytes")
        spark.conf.unset("quire.taskRows")
    held = {}
    for doc, at, event, who, action, ttl in sorted(e for e in events if e[1] <= 4500):
        result = _brute_leases([e for e in events if e[1] <= 4500])[event]
        if result in ("acquired", "renewed"):
            held[doc] = (who, at + max(30, min(ttl, 120)))
        elif result == "released":
            held.pop(doc, None)
    for doc, shown in found.items():
        who, end = held.get(doc, (None, -1))
        assert shown == ("available" if end <= 4500 else "heldByMe" if who == "u0" else "heldByOther")


_REQUEST = "document_id string, seq bigint, operation_id string, project_id string, base_revision bigint, device_id string, relative_path string, content_hash string, is_deleted boolean"


def _requests(rng, n, documents=4, paths=3):
    return [
        (f"d{rng.randrange(documents)}", i, f"o{rng.randrange(n)}", "p" if rng.random() < 0.9 else "q", rng.randrange(6), "x", f"path{rng.randrange(paths)}", f"h{rng.randrange(3)}", rng.random() < 0.3)
        for i in range(n)
    ]


def _brute_replay(requests):
    out, docs, ops = {}, {}, {}
    for doc, seq, op, project, base, device, path, digest, gone in sorted(requests, key=lambda r: (r[1], r[0])):
        state = docs.setdefault(doc, {"rev": 0, "project": None, "at": None})
        payload = (doc, project, base, device, path, digest, gone)
        taken = not gone and any(d != doc and o["at"] == (project, path) for d, o in docs.items())
        if op in ops:
            found = "replayed" if ops[op] == payload else "OPERATION_ID_REUSED"
        elif base == 0:
            found = "DOCUMENT_ALREADY_EXISTS" if state["rev"] else "INVALID_ARGUMENT" if gone else "PATH_CONFLICT" if taken else "committed"
        elif not state["rev"] or state["project"] != project:
            found = "DOCUMENT_NOT_FOUND"
        else:
            found = "REVISION_CONFLICT" if state["rev"] != base else "PATH_CONFLICT" if taken else "committed"
        if found == "committed":
            state["rev"], state["project"], state["at"] = base + 1, project, None if gone else (project, path)
            ops[op] = payload
        out[doc, seq] = found
    return out


def _outcomes(spark, data):
    df = spark.createDataFrame(data, _REQUEST)
    return {(r.document_id, r.seq): r.outcome for r in L.replay_ledger(df, ["seq"]).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_by_brute_force(spark, seed):
    rng = random.Random(seed)
    data = _requests(rng, 60) + [(d, s + 60, f"o{s % 9}", p, b, x, h, g, z) for d, s, _, p, b, x, h, g, z in _requests(rng, 60)]
    expected = _brute_replay(data)
    assert _outcomes(spark, data) == expected
    # ids and revisions alone, each document for itself: the fold and the links
    shaped = spark.createDataFrame(data, _REQUEST).withColumns({"slot": F.col("project_id"), "opens": F.array("project_id"), "is_head": F.expr("base_revision = 0 AND NOT is_deleted")})
    assert rows(committed(shaped)) == rows(committed_by_links(shaped))


@pytest.mark.parametrize("seed", [3, 4])
def test_replay_of_contended_paths(spark, seed):
    rng = random.Random(seed)
    # revisions that mostly fit, so that documents move and meet
    data, revision = [], {}
    for i in range(400):
        doc = f"d{rng.randrange(12)}"
        base = revision.get(doc, 0)
        data.append((doc, i, f"o{rng.randrange(700)}", "p", base, "x", f"path{rng.randrange(8)}", "h", rng.random() < 0.15 and base > 0))
        revision[doc] = base + (rng.random() < 0.6)
    expected = _brute_replay(data)
    assert {"committed", "PATH_CONFLICT", "REVISION_CONFLICT", "OPERATION_ID_REUSED"} <= set(expected.values())
    assert _outcomes(spark, data) == expected


def test_replay_of_contended_paths_by_links(spark, heavy):
    rng = random.Random(5)
    data = _requests(rng, 40, documents=3, paths=2)
    assert _outcomes(spark, data) == _brute_replay(data)


def test_refused_move_frees_a_path(spark):
    step = lambda doc, seq, base, path, gone=False: (doc, seq, f"{doc}{seq}", "p", base, "x", path, "h", gone)
    data = [
        step("a", 0, 0, "one"), step("b", 1, 0, "two"), step("c", 2, 0, "one"),  # c is refused: a is there
        step("a", 3, 1, "two"),  # refused: b is there, so a stays
        step("c", 4, 0, "one"),  # still refused
        step("a", 5, 1, "one", True), step("c", 6, 0, "one"),  # a goes, c may come
        step("a", 7, 2, "one"),  # a cannot come back
    ]
    codes = [_brute_replay(data)[r[0], r[1]] for r in data]
    assert codes == ["committed", "committed", "PATH_CONFLICT", "PATH_CONFLICT", "PATH_CONFLICT", "committed", "committed", "PATH_CONFLICT"]
    assert _outcomes(spark, data) == _brute_replay(data)


def test_many_repeated_ids_of_one_document(spark, monkeypatch):
    """Ten thousand ids that come again with another payload take a few runs, not one each."""
    from quire.operators import chains

    runs = []
    monkeypatch.setattr(chains, "_successors", lambda df, real=chains._successors: runs.append(1) or real(df))
    data = [("d", i, f"o{i}", i) for i in range(10_000)] + [("d", 10_000 + i, f"o{i}", 10_000 + i) for i in range(10_000)]
    data += [("d", 20_000 + i, f"n{i}", 10_000 + i) for i in range(100)]
    df = spark.createDataFrame(data, "document_id string, seq bigint, operation_id string, base_revision bigint")
    df = df.withColumns({"slot": F.lit("p"), "opens": F.array(F.lit("p")), "is_head": F.col("base_revision") == 0})
    got = sorted(r.seq for r in committed_by_links(df).collect())
    assert got == [*range(10_000), *range(20_000, 20_100)]
    assert len(runs) <= 3


def test_document_commit_rules(spark):
    import hashlib

    def commit(doc, seq, op, kind, base, gone, text, name="n", digest=None, size=None, structure=1):
        sha = hashlib.sha256(text.encode()).hexdigest()
        return (doc, seq, op, "p", name, None, structure, kind, base, gone, text, len(text.encode()) if size is None else size, digest or sha, f"{op}{text}")

    data = [
        commit("d", 1, "o1", "create", 0, False, "a"), commit("d", 2, "o1", "create", 0, False, "a"), commit("d", 3, "o1", "create", 0, False, "b"),
        commit("d", 4, "o4", "update", 1, False, "b", size=9), commit("d", 5, "o5", "update", 1, False, "b", digest="0" * 64),
        commit("d", 6, "o6", "update", 1, False, "b", structure=2), commit("d", 7, "o7", "update", 1, False, "b"), commit("d", 8, "o8", "delete", 2, True, "a"),
        commit("d", 9, "o9", "delete", 2, True, "b"), commit("d", 10, "o10", "update", 3, False, "c"), commit("d", 11, "o11", "restore", 3, False, "b"),
        commit("d", 12, "o12", "restore", 4, False, "b"), commit("d", 13, "o13", "create", 0, False, "x"), commit("e", 1, "o14", "update", 1, False, "x"),
        commit("f", 1, "o15", "create", 0, False, "x"), commit("f", 2, "o16", "delete", 1, True, "x"), commit("d", 14, "o17", "update", 2, False, "z"), commit("d", 15, "o18", "create", 1, False, "z"),
    ]
    schema = (
        "document_id string, seq bigint, operation_id string, project_id string, name string, parent_id string, structure_revision int, intent_kind string, "
        "base_revision bigint, is_deleted boolean, content string, content_bytes bigint, content_sha256 string, payload_digest string"
    )
    listed = spark.createDataFrame([("f",)], "document_id string")
    out = {(r.document_id, r.seq): r.outcome for r in L.document_commit_replay(spark.createDataFrame(data, schema), listed).collect()}
    d = [out["d", i] for i in range(1, 16)]
    assert d == [
        "committed", "replayed", "OPERATION_ID_REUSED", "CONTENT_SIZE_MISMATCH", "CONTENT_DIGEST_MISMATCH", "STRUCTURE_REVISION_CONFLICT", "committed",
        "CONTENT_DIGEST_MISMATCH", "committed", "DOCUMENT_NOT_FOUND", "committed", "DOCUMENT_ALREADY_EXISTS", "DOCUMENT_ALREADY_EXISTS", "REVISION_CONFLICT", "INVALID_ARGUMENT",
    ]
    assert (out["e", 1], out["f", 1], out["f", 2]) == ("DOCUMENT_NOT_FOUND", "committed", "INVARIANT_VIOLATION")
