"""Greedy chains: which rows of an ordered sequence take effect.

Some rules look like a loop over a key's rows, where a row takes effect or not
by the row that last did. When the state after a row depends on that row
alone, each row has one fixed successor, and the rows that take effect are
those reached from the key's head. Successors come from one window; reached
rows come from doubling the jump, log2(length) joins, so a key of any size
spreads over the cluster. Keys of ordinary size are folded in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quire.operators.ordered import top_rows, with_previous, with_running
from quire.session import TASK_ROWS, durable, fits_one_task, task_limit


def follow(links: DataFrame) -> DataFrame:
    """Ids reached from the heads of ``id, next_id, is_head``."""
    links = durable(links)
    reached = links.where("is_head").select("id")
    jump = links.where("next_id IS NOT NULL").select("id", "next_id")
    while True:
        fresh = reached.join(jump, "id").select(F.col("next_id").alias("id")).distinct()
        fresh = durable(fresh.join(reached, "id", "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = durable(reached.unionByName(fresh))
        onward = jump.select(F.col("id").alias("next_id"), F.col("next_id").alias("_far"))
        jump = durable(jump.join(onward, "next_id").select("id", F.col("_far").alias("next_id")))


def next_at_or_after(points: DataFrame, probes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each probe the smallest point not before it, under equal keys.

    ``probes`` has the keys, ``at`` and a ``probe_id``; the result is
    ``probe_id, next_at``. One descending pass over both sets; no pairs.
    """
    data = points.select(*keys, at, F.col(at).alias("_point"), F.lit(0).alias("_probe"))
    asked = probes.select(*keys, at, "probe_id", F.lit(1).alias("_probe"))
    both = data.unionByName(asked, allowMissingColumns=True)
    seen = with_running(both, keys, [f"-{at}", "_probe"], {"next_at": ("min", "_point")})
    return seen.where("_probe = 1").select("probe_id", "next_at")


def split_by_size(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of heavy keys if there are any."""
    if fits_one_task(df):
        return df, None
    limit = task_limit(df.sparkSession, "taskRows", TASK_ROWS)
    heavy = durable(df.groupBy(key).count().where(F.col("count") > limit).select(key))
    if heavy.isEmpty():
        return df, None
    return df.join(heavy, key, "left_anti"), df.join(heavy, key, "left_semi")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Committed rows of the documents of one sorted partition."""
    document, revision, opens, used = None, 0, (), set()
    for batch in batches:
        keep = []
        rows = zip(
            batch["document_id"], batch["base_revision"], batch["slot"], batch["opens"],
            batch["operation_id"], batch["is_head"],
        )
        for key, base, slot, offered, operation, head in rows:
            if key != document:
                document, revision, opens, used = key, 0, (), set()
            allowed = head if revision == 0 else base == revision and slot in opens
            allowed = allowed and operation not in used
            if allowed:
                revision, opens = base + 1, tuple(offered)
                used.add(operation)
            keep.append(bool(allowed))
        yield batch.loc[keep, ["document_id", "seq"]]


def committed(requests: DataFrame) -> DataFrame:
    """``document_id, seq`` of the requests that take effect.

    Needs ``document_id, seq, operation_id, base_revision, slot, opens,
    is_head``: a head may found a document; after a row with revision r
    commits, the next to commit is the first later row with base r+1 (its
    ``base_revision`` + 1) whose ``slot`` is among those the row ``opens``.
    ``seq`` is unique within a document.
    """
    needed = requests.select(
        "document_id", "seq", "operation_id", "base_revision", "slot", "opens", "is_head"
    )
    light, heavy = split_by_size(needed, "document_id")
    kind = requests.schema["document_id"].dataType.simpleString()
    # one sorted stream per partition: no set-up cost per document
    ordered = light.repartition("document_id").sortWithinPartitions("document_id", "seq")
    out = ordered.mapInPandas(_fold, f"document_id {kind}, seq bigint")
    if heavy is not None:
        out = out.unionByName(committed_by_links(heavy))
    return out


def committed_by_links(requests: DataFrame) -> DataFrame:
    """:func:`committed` without a fold, for documents of any size.

    Repeated operation ids are taken out beforehand or in rounds: after a run,
    every row whose id an earlier reached row of its document has is left out
    of the next, until the same rows stay out.
    """
    requests = durable(requests.withColumn("id", F.struct("document_id", "seq")))
    operation = ["document_id", "operation_id"]
    repeated = durable(requests.groupBy(*operation).count().where("count > 1").select(*operation))
    several = durable(requests.join(repeated, operation, "left_semi").select(*operation, "seq", "id"))
    out = None
    while True:
        usable = requests if out is None else requests.join(out, "id", "left_anti")
        reached = durable(follow(_successors(usable)).select("id.*", "id"))
        if several.isEmpty():
            return reached.select("document_id", "seq")
        first = several.join(reached, "id", "left_semi").groupBy(*operation).agg(F.min("seq").alias("_first"))
        again = durable(several.join(first, operation).where("seq > _first").select("id"))
        known = out if out is not None else again.limit(0)
        if again.count() == known.count() and again.join(known, "id", "left_anti").isEmpty():
            return reached.select("document_id", "seq")
        out = again


def _successors(usable: DataFrame) -> DataFrame:
    """``id, next_id, is_head``: the row that would commit next after each row."""
    heads = top_rows(usable.where("is_head"), ["document_id"], ["seq"], 1).select("id", F.lit(True).alias("is_head"))
    probes = usable.select(
        "document_id",
        (F.col("base_revision") + 1).alias("base_revision"),
        F.explode("opens").alias("slot"),
        "seq",
        F.col("id").alias("probe_id"),
    )
    # equal sequence numbers never meet: a row's base differs from the one it opens
    found = next_at_or_after(usable, probes, ["document_id", "base_revision", "slot"], "seq")
    nearest = found.groupBy(F.col("probe_id").alias("id")).agg(F.min("next_at").alias("_next"))
    return (
        usable.select("id", "document_id")
        .join(nearest, "id", "left")
        .join(heads, "id", "left")
        .select(
            "id",
            F.when(F.col("_next").isNotNull(), F.struct("document_id", F.col("_next").alias("seq"))).alias("next_id"),
            F.coalesce("is_head", F.lit(False)).alias("is_head"),
        )
    )


def state_before(
    requests: DataFrame, done: DataFrame, columns: list[str], keep_own: bool = False
) -> DataFrame:
    """Requests with the last committed row before them, as ``was_<column>``.

    ``committed`` tells whether the request itself took effect. With
    ``keep_own`` committed requests, too, get the row before them.
    """
    marked = requests.join(
        done.withColumn("committed", F.lit(True)), ["document_id", "seq"], "left"
    ).withColumn("committed", F.coalesce("committed", F.lit(False)))
    marked = durable(marked)
    stamped = marked.withColumn("_mine", F.when(F.col("committed"), F.col("seq")))
    earlier = with_running(stamped, ["document_id"], ["seq"], {"_last": ("max", "_mine")})
    if keep_own:
        own = with_previous(
            marked.where("committed").select("document_id", "seq"), ["document_id"], ["seq"], {"_prior": "seq"}
        )
        earlier = earlier.join(own, ["document_id", "seq"], "left").withColumn(
            "_last", F.when(F.col("committed"), F.col("_prior")).otherwise(F.col("_last"))
        ).drop("_prior")
    else:
        earlier = earlier.withColumn("_last", F.when(~F.col("committed"), F.col("_last")))
    facts = marked.where("committed").select(
        "document_id", F.col("seq").alias("_last"), *[F.col(c).alias(f"was_{c}") for c in columns]
    )
    return earlier.join(facts, ["document_id", "_last"], "left").drop("_mine", "_last")


#: What decides whether a request takes effect; see :func:`committed`.
_RULE = ["document_id", "operation_id", "base_revision", "slot", "opens", "is_head", "is_candidate"]


def replayed(requests: DataFrame, rule: dict[str, Column], columns: list[str]) -> DataFrame:
    """Requests with ``committed``, and the last committed row before those that are not, as ``was_<column>``.

    What :func:`committed` and :func:`state_before` say together. ``rule``
    gives ``slot, opens, is_head`` and ``is_candidate``; a request that is no
    candidate takes no effect. It is evaluated behind the one exchange that
    documents of ordinary size go through.
    """
    light, heavy = split_by_size(requests, "document_id")
    ordered = light.repartition("document_id").sortWithinPartitions("document_id", "seq").withColumns(rule)
    facts = [StructField(f"was_{c}", requests.schema[c].dataType) for c in columns]
    out = StructType([*requests.schema.fields, StructField("committed", BooleanType()), *facts])
    kept = requests.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, revision, opens, used, last = None, 0, (), set(), None
        for batch in batches:
            # the last committed row of the document that goes on stands before the batch
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            first = 0 if last is None else 1
            at, done, before = (None if last is None else 0), [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in _RULE), strict=True), first):
                key, operation, base, slot, offered, head, candidate = row
                if key != document:
                    document, revision, opens, used, at = key, 0, (), set(), None
                allowed = head if revision == 0 else base is not None and base == revision and slot in opens
                allowed = bool(candidate and allowed and key is not None and operation not in used)
                done.append(allowed)
                before.append(None if allowed else at)
                if allowed:
                    at, revision, opens = i, None if base is None else base + 1, offered
                    used.add(operation)
            was = table.select(columns).take(pa.array(before, pa.int64()))
            arrays = [*(batch.column(c) for c in kept), pa.array(done), *(c.combine_chunks() for c in was.columns)]
            last = None if at is None else table.slice(at, 1).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    found = ordered.mapInArrow(fold, out)
    if heavy is None:
        return found
    slow = state_before(heavy, committed_by_links(heavy.withColumns(rule).where("is_candidate")), columns)
    return found.unionByName(slow.select(*out.names))
