"""Edit leases over time: who held a document, who was refused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.operators.chains import follow, next_at_or_after, split_by_size, state_before
from quire.operators.ordered import with_previous, with_row_number
from quire.session import durable

# Bounds and default of a lease in seconds.
MIN_TTL, MAX_TTL, DEFAULT_TTL = 30, 120, 90


def clamp_ttl(ttl: Column) -> Column:
    return F.greatest(F.lit(MIN_TTL), F.least(F.coalesce(ttl, F.lit(DEFAULT_TTL)), F.lit(MAX_TTL)))


def _timeline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted stream; the state is the current holder of one document."""
    document, holder, expires = None, None, None
    for batch in batches:
        results, ends = [], []
        rows = zip(batch["document_id"], batch["holder"], batch["action"], batch["at"], batch["ttl"])
        for key, who, action, at, ttl in rows:
            if key != document:
                document, holder, expires = key, None, None
            if expires is not None and expires <= at:
                holder, expires = None, None
            if action == "release":
                result = "released" if holder == who else "notHeld"
                if holder == who:
                    holder, expires = None, None
            elif holder is not None and holder != who:
                result = "LEASE_CONFLICT"
            else:
                result = "renewed" if holder == who else "acquired"
                holder, expires = who, at + ttl * 1_000_000
            results.append(result)
            ends.append(expires)
        yield batch.assign(result=results, expires=pd.array(ends, dtype="Int64"))[
            ["document_id", "holder", "at", "lease_event_id", "result", "expires"]
        ]


def lease_timeline(events: DataFrame) -> DataFrame:
    """Result of each lease event and when the lease then ends.

    Needs ``lease_event_id, document_id, user_id, device_id, action, ts,
    ttl_seconds``. A lease is one holder's until it expires; the holder may
    renew or release it. Documents of ordinary size go through one sorted
    stream per partition; larger ones through fixed successors.
    """
    holder = F.concat_ws("/", F.col("user_id").cast("string"), F.col("device_id").cast("string"))
    timed = events.select(
        "lease_event_id",
        "document_id",
        holder.alias("holder"),
        "action",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        clamp_ttl(F.col("ttl_seconds")).cast("bigint").alias("ttl"),
    )
    light, heavy = split_by_size(timed, "document_id")
    kinds = {c: timed.schema[c].dataType.simpleString() for c in ("document_id", "lease_event_id")}
    done = (
        light.repartition("document_id")
        .sortWithinPartitions("document_id", "at", "lease_event_id")
        .mapInPandas(
            _timeline,
            f"document_id {kinds['document_id']}, holder string, at bigint, "
            f"lease_event_id {kinds['lease_event_id']}, result string, expires bigint",
        )
    )
    if heavy is not None:
        done = done.unionByName(_timeline_by_links(heavy))
    return done.select(
        "lease_event_id", "document_id", "holder", F.timestamp_micros("at").alias("at"), "result",
        F.timestamp_micros("expires").alias("expires_at"),
    )


def _timeline_by_links(timed: DataFrame) -> DataFrame:
    """The same for documents of any size.

    An event takes effect if it is the holder's own, or an acquire of a free
    document. After a grant that is the holder's next event, if it comes
    before the lease ends, else the first acquire from then on; after a
    release it is the next acquire. Each event so has one fixed successor.
    """
    numbered = durable(
        with_row_number(timed, ["document_id"], ["at", "lease_event_id"], "seq").withColumns(
            {
                "id": F.struct("document_id", "seq"),
                "_end": F.col("at") + F.col("ttl") * 1_000_000,
                "_grant": F.col("action") != "release",
            }
        )
    )
    # previous row in descending order: the next event of the same holder
    ahead = with_previous(numbered, ["document_id", "holder"], ["-seq"], {"_own": "seq", "_own_at": "at"})
    acquires = numbered.where("_grant")
    moment = lambda at, seq: F.struct(at.alias("at"), seq.alias("seq"))
    points = acquires.select("document_id", moment(F.col("at"), F.col("seq")).alias("_when"))
    # a grant looks from the end of its lease on, a release from the next event on
    start = F.when(F.col("_grant"), moment(F.col("_end"), F.lit(0).cast("bigint"))).otherwise(
        moment(F.col("at"), F.col("seq") + 1)
    )
    probes = numbered.select("document_id", start.alias("_when"), F.col("id").alias("probe_id"))
    free = next_at_or_after(points, probes, ["document_id"], "_when").select(
        F.col("probe_id").alias("id"), F.col("next_at.seq").alias("_free")
    )
    joined = ahead.join(free, "id", "left")
    own_first = F.col("_grant") & (F.col("_own_at") < F.col("_end"))
    following = F.when(F.coalesce(own_first, F.lit(False)), F.col("_own")).otherwise(F.col("_free"))
    first = acquires.groupBy("document_id").agg(F.min("seq").alias("_head"))
    links = joined.join(first, "document_id", "left").select(
        "id",
        F.when(following.isNotNull(), F.struct("document_id", following.alias("seq"))).alias("next_id"),
        F.coalesce(F.col("seq") == F.col("_head"), F.lit(False)).alias("is_head"),
    )
    effective = follow(links).select("id.*")
    judged = state_before(numbered, effective, ["holder", "_end", "_grant"], keep_own=True)
    held = F.coalesce(F.col("was__grant") & (F.col("was__end") > F.col("at")), F.lit(False))
    mine = held & (F.col("was_holder") == F.col("holder"))
    result = (
        F.when(~F.col("_grant"), F.when(mine, "released").otherwise("notHeld"))
        .when(held & ~mine, "LEASE_CONFLICT")
        .when(mine, "renewed")
        .otherwise("acquired")
    )
    expires = (
        F.when(F.col("result").isin("acquired", "renewed"), F.col("_end"))
        .when(F.col("result") == "released", F.lit(None).cast("bigint"))
        .otherwise(F.when(held, F.col("was__end")))
    )
    return judged.withColumn("result", result).select(
        "document_id", "holder", "at", "lease_event_id", "result", expires.alias("expires")
    )


def lease_state_at(timeline: DataFrame, moment: Column, me: str) -> DataFrame:
    """Per document at a moment: available, heldByMe or heldByOther."""
    past = timeline.where(F.col("at") <= moment)
    last = past.groupBy("document_id").agg(
        F.max_by(
            F.struct("holder", "expires_at"),
            F.when(F.col("result").isin("acquired", "renewed"), F.struct("at", "lease_event_id")),
        ).alias("_grant"),
        F.max(F.when(F.col("result") == "released", F.struct("at", "lease_event_id"))).alias("_release"),
        F.max(
            F.when(F.col("result").isin("acquired", "renewed"), F.struct("at", "lease_event_id"))
        ).alias("_granted"),
    )
    held = (
        F.col("_grant").isNotNull()
        & (F.col("_grant.expires_at") > moment)
        & (F.col("_release").isNull() | (F.col("_release") < F.col("_granted")))
    )
    state = F.when(~held, "available").when(F.col("_grant.holder") == me, "heldByMe").otherwise("heldByOther")
    return last.select("document_id", F.coalesce(state, F.lit("available")).alias("state"))
