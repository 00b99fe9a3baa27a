"""Rules over a key's events in event-time order, whatever order they arrive in.

Events wait in keyed state on disk until the watermark has passed them; then
no earlier one can come, and they go through the rule in order of time. One
timer a key wakes it for the next waiting event or for the moment at which
its state ends by itself, so that ends and events interleave as they happened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from pickle import dumps, loads

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from quire.session import checkpointed_stream, disk_state, shared_folder

#: Events that wait as one value of state, and rows that leave as one, at most.
CHUNK = 10_000
#: Bytes of a task's events that are gathered by key at once.
GATHERED = 64 * 1024 * 1024
#: Steps in which the watermark moves by one delay.
STEPS = 16
#: The moment after all events, which closes a feed.
END = "9999-12-31 00:00:00"
#: Marks rows that only move the watermark.
TICK = "is_tick"

Event = tuple
State = tuple


@dataclass(frozen=True)
class Rule:
    """What events do to the state of their key.

    ``step(state, event)`` gives the next state and output rows. State and
    events are tuples, null state is none; an event is its instant in
    microseconds, then the other columns in order. ``end(state)`` is the
    instant at which a state ends by itself, if it does, and ``close(state)``
    the rows that this gives.
    """

    state: str
    output: str
    step: Callable[[State | None, Event], tuple[State | None, list[tuple]]]
    end: Callable[[State], int | None] = lambda state: None
    close: Callable[[State], list[tuple]] = lambda state: []


def _place(event: Event, size: int) -> tuple:
    return tuple((v is not None, v) for v in event[:size])


class _Ordered(StatefulProcessor):
    """The waiting events and the state of one key.

    Each call to the state store is a message to the executor and back, and
    each value that passes is converted one by one. So calls are few, events
    come and wait many to a value, and rows leave as arrays. A timer is set
    without asking for earlier ones; a key is drained once a micro-batch.
    """

    def __init__(self, rule: Rule, keys: list[str], order: int):
        self.rule, self.keys, self.order = rule, len(keys), order
        self.row = Row(*keys, *StructType.fromDDL(rule.output).names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("events", BinaryType())]))
        self.state = handle.getValueState("state", self.rule.state)
        self.drained: set[tuple] = set()

    def _wake(self, at: int) -> None:
        """Have a timer at the first millisecond not before this instant."""
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        events = (e for r in rows if not r[self.keys] for e in zip(*tuple(r)[self.keys + 2 :]))
        while fresh := list(islice(events, CHUNK)):
            self.waiting.appendValue((dumps(fresh),))
            least = min(e[0] for e in fresh)
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if tuple(key) in self.drained:
            return iter(())
        self.drained.add(tuple(key))
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for (events,) in self.waiting.get():
            for event in loads(events):
                (due if event[0] <= passed else later).append(event)
        due.sort(key=lambda e: _place(e, self.order))
        before = self.state.get()
        state = None if before is None else tuple(before)
        out: list[tuple] = []
        for event in due:
            state = self._ended(state, event[0], out)
            state, rows = self.rule.step(state, event)
            out += rows
        state = self._ended(state, passed, out)
        if due and later:
            self.waiting.put([(dumps(part),) for part in _parts(later)])
        elif due:
            self.waiting.clear()
        if state is not None:
            self.state.update(state)
        elif before is not None:
            self.state.clear()
        nexts = [e[0] for e in later]
        if state is not None and self.rule.end(state) is not None:
            nexts.append(self.rule.end(state))
        if nexts:
            self._wake(min(nexts))
        return iter([self.row(*key, *zip(*part)) for part in _parts(out)])

    def _ended(self, state: State | None, at: int, out: list[tuple]) -> State | None:
        end = None if state is None else self.rule.end(state)
        if end is None or end > at:
            return state
        out += self.rule.close(state)
        return None


def _parts(items: list) -> Iterator[list]:
    return (items[i : i + CHUNK] for i in range(0, len(items), CHUNK))


def _gathered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for the events of a key and step among those that fit :data:`GATHERED`."""
    held, size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if held and (batch is None or size >= GATHERED):
            rows = pa.Table.from_batches(held)
            by, of = rows.column_names[: len(keys) + 2], rows.column_names[len(keys) + 2 :]
            lists = rows.group_by(by, use_threads=False).aggregate([(c, "list") for c in of])
            yield from lists.select([*by, *[f"{c}_list" for c in of]]).rename_columns(rows.column_names).to_batches()
            held, size = [], 0


def in_event_order(events: DataFrame, keys: list[str], time: str, order: list[str], columns: list[str], rule: Rule, delay: str) -> DataFrame:
    """The rule's rows for a stream of events, by key and event time.

    Events of one instant go by ``order`` (null first). Those that come more
    than ``delay`` behind the newest are late and left out, as in any stream,
    and so are events without a time. A key's waiting events of one ``delay``
    must fit a task's memory. Start the query under :func:`disk_state`.

    The watermark moves in steps of a sixteenth of ``delay`` and stays up to
    two steps behind it. The events of a key within a step are late together
    or not at all, so that they go to the rule in one row.
    """
    spark = events.sparkSession
    zero = "timestamp_ntz'1970-01-01 00:00:00'"
    wait = spark.sql(f"SELECT timestampdiff(MILLISECOND, {zero}, {zero} + INTERVAL '{delay}')").first()[0]
    step = max(1, wait // STEPS)
    tick = F.col(TICK) if TICK in events.columns else F.lit(False)
    micros = F.unix_micros(F.col(time))
    parts = {"_step": F.timestamp_micros(micros - F.pmod(micros, F.lit(step * 1000))), TICK: tick, "_at": micros}
    own = [*order, *[c for c in columns if c not in order]]
    shaped = events.where(F.col(time).isNotNull()).select(*keys, *[v.alias(c) for c, v in parts.items()], *own)
    kinds = {f.name: f.dataType for f in shaped.schema}
    whole = StructType([StructField(c, kinds[c]) for c in [*keys, TICK, "_step"]] + [StructField(c, ArrayType(kinds[c])) for c in ["_at", *own]])
    dealt = shaped.select(*whole.names).repartition(*keys)
    rows = dealt.mapInArrow(lambda batches: _gathered(batches, keys), whole).withWatermark("_step", f"{wait + step} milliseconds")
    output = StructType.fromDDL(rule.output)
    packed = StructType([*whole[: len(keys)], *[StructField(f.name, ArrayType(f.dataType)) for f in output]])
    out = rows.groupBy(*keys).transformWithState(_Ordered(rule, keys, 1 + len(order)), packed, "append", "EventTime")
    return out.select(*keys, F.inline(F.arrays_zip(*output.names)))


def instant(name: str) -> Column:
    """Microseconds as a timestamp."""
    return F.timestamp_micros(name).alias(name)


def settled(feed: DataFrame, time: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over what its feed holds, close the feed, and read all rows back.

    A second source beside the feed has no row at first. Once the feed is used
    up it gets one row from the end of time, which no rule sees: the
    watermark passes all events and nothing is left waiting.
    """
    spark: SparkSession = feed.sparkSession
    path = shared_folder(spark)
    none = spark.range(0).select(F.lit(None).cast("timestamp").alias(time), F.lit(True).alias(TICK))
    none.write.parquet(f"{path}-ticks")
    ticks = spark.readStream.schema(none.schema).parquet(f"{path}-ticks")
    out = operator(feed.withColumn(TICK, F.lit(False)).unionByName(ticks, allowMissingColumns=True))
    with disk_state(spark):
        checkpointed_stream(out, path)
        spark.sql(f"SELECT timestamp'{END}' AS `{time}`, true AS {TICK}").write.mode("append").parquet(f"{path}-ticks")
        return checkpointed_stream(out, path)
