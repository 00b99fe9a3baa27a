"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Each document has an exponential key, -ln(u) / quality weight, with u a hash
of its id. A source's target is met first by complete epochs of the source,
then by its documents in key order until their sizes add up to the rest.

The running sum never needs a source in one task: keys fall into buckets that
keep their order, sums per (source, bucket) find the one bucket in which the
rest ends, and only that bucket's rows are sorted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import whole
from quire.session import durable

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Largest target of a source, and largest use of a document, in its sizes.
MOST = 3
#: Buckets of keys within a source, evenly over these logarithms of keys: one
#: holds at most a few times its share of the rows, whatever their weights.
BUCKETS, LOW, HIGH = 8_192, -12.0, 8.0
#: Smallest quality weight.
LEAST_WEIGHT = 0.05


_COUNTS = T.StructType([T.StructField("size", T.LongType()), T.StructField("kinds", T.LongType())])


@F.pandas_udf(_COUNTS)
def _words(texts: pd.Series) -> pd.DataFrame:
    """Words and distinct words; bytes split at exactly the six white-space characters."""
    found = [() if t is None else t.encode().split() for t in texts]
    return pd.DataFrame({"size": [len(w) for w in found], "kinds": [len(set(w)) for w in found]})


def _u(doc_id: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def measured(docs: DataFrame) -> DataFrame:
    """All columns of the rows, with size, sampling key and bucket under ``_m``.

    Quality weight: the share of distinct words, at least LEAST_WEIGHT.
    """
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.col("_w.kinds") / F.greatest(F.col("_w.size"), F.lit(1)))
    key = -F.log(_u(F.col("doc_id"))) / weight
    even = F.floor((F.log(key) - LOW) / (HIGH - LOW) * BUCKETS)
    bucket = F.least(F.greatest(even, F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
    facts = F.struct(F.col("_w.size").alias("size"), key.alias("key"), bucket.alias("bucket"), F.xxhash64("text").alias("text"))
    return docs.withColumn("_w", _words("text")).withColumn("_m", facts).drop("_w")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources (source, source_size), one row each.

    Sources in order of cap / weight: a source is capped if its share of what
    the sources before it left is above its cap; the others share the rest.
    """
    everything = Window.partitionBy()
    # nulls last, code point order
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
        .withColumn("weights_left", F.col("weights") - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("weights_left") <= F.col("left") * F.col("weight"))
    )
    free = F.when(~F.col("capped"), F.col("weight"))
    held = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    share = (F.col("total") - held) * F.col("weight") / F.sum(free).over(everything)
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source: target, complete epochs, and where the rest of its target ends."""
    sums = rows.groupBy("source", F.col("_m.bucket").alias("bucket")).agg(F.sum("_m.size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = durable(sums).withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    g = (
        targets(sizes, weights)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .alias("g")
    )
    # the last bucket that begins before the rest is used up
    found = sums.alias("p").join(g, F.col("p.source").eqNullSafe(F.col("g.source")), "right")
    reached = F.col("p.before") < F.col("g.rest")
    return durable(
        found.groupBy(F.col("g.source").alias("_source"))
        .agg(
            *[F.first(f"g.{c}").alias(c) for c in ("source_size", "target", "epochs", "rest")],
            F.coalesce(F.max(F.when(reached, F.col("p.bucket"))), F.lit(-1)).alias("edge"),
            F.coalesce(F.max(F.when(reached, F.col("p.before"))), F.lit(0)).alias("edge_before"),
        )
        .select("_source", F.struct("source_size", "target", "epochs", "rest", "edge", "edge_before").alias("_p"))
    )


def mix(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Add ``_p`` (the source's plan) and ``_copies`` to measured rows.

    Only the rows of each source's edge bucket are sorted.
    """
    known = rows.join(decided, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = Window.partitionBy("source").orderBy("_m.key", "doc_id", "_m.size", "_m.text").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = known.where("_m.bucket = _p.edge")
    before = F.col("_p.edge_before") + F.coalesce(F.sum("_m.size").over(order), F.lit(0))
    # the nearer of the two ends of the document that crosses the rest
    at_edge = at_edge.withColumn("_more", (before * 2 + F.col("_m.size") <= F.col("_p.rest") * 2).cast("long"))
    others = known.where("_m.bucket <> _p.edge").withColumn("_more", F.expr("_m.bucket < _p.edge").cast("long"))
    return at_edge.unionByName(others).withColumn("_copies", F.col("_p.epochs") + F.col("_more")).drop("_more")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document with its source's size and target and the words taken.

    A null text has no words. A null source is a source, the last. Rows
    without an id share one key; repeated rows are rows of their own. A source
    without words has target 0 and stays once. An empty table gives no rows;
    further columns are not read.
    """
    rows = durable(measured(docs.select("doc_id", "source", "text")).drop("text"))
    mixed = mix(rows, plan(rows))
    taken = (F.col("_copies") * F.col("_m.size")).alias("taken")
    return mixed.select("doc_id", "_m.size", "_p.source_size", "_p.target", taken, "source", F.col("_copies").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as it is taken, in its own columns.

    Texts stay where they are read; only edge buckets are sorted. Columns may
    have any names and types. Nulls, repeated rows and an empty table as in
    :func:`mix_report`.
    """
    rows = measured(whole(docs, "doc_id", "source", "text"))
    taken = mix(rows, plan(rows)).where("_copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return taken.withColumn("_copy", copies).select("row.*")
