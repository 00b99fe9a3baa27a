"""Ordered, per-key operators that survive a key holding much of the data.

Each operator is a plain window when no key is heavy. When one is, rows are
range-partitioned by (key, order), so that a heavy key spreads over many
tasks; the window then runs inside each run and a small table carries the
state over the run borders. A border splits at most one key, so that table
has at most two rows per partition, whatever the data holds.

``order`` is a list of column names; a leading ``-`` sorts descending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import durable, has_heavy_key

_RUN = "_run"


def sort_columns(order: list[str], reverse: bool = False) -> list[Column]:
    out = []
    for name in order:
        descending = name.startswith("-") != reverse
        column = F.col(name.lstrip("-"))
        out.append(column.desc() if descending else column.asc())
    return out


def _runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *sort_columns(order))
    # the run number must not change on a retry, hence the checkpoint
    return durable(ranged.withColumn(_RUN, F.spark_partition_id()))


def _split_keys(runs: DataFrame, keys: list[str], totals: list[Column]) -> DataFrame:
    """One row per (key, run) for keys lying in more than one run."""
    per_run = runs.groupBy(*keys, _RUN).agg(*totals)
    span = Window.partitionBy(*keys)
    return (
        per_run.withColumn("_n_runs", F.count("*").over(span)).where("_n_runs > 1").drop("_n_runs")
    )


def _null_safe_join(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of the border table, at most two rows per partition."""
    renamed = carry
    condition = None
    for name in [*keys, _RUN]:
        renamed = renamed.withColumnRenamed(name, f"_c_{name}")
        part = F.col(name).eqNullSafe(F.col(f"_c_{name}"))
        condition = part if condition is None else condition & part
    joined = df.join(F.broadcast(renamed), condition, "left")
    return joined.drop(*[f"_c_{n}" for n in [*keys, _RUN]])


def with_row_number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based position of each row within its key."""
    if not has_heavy_key(df, keys):
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    runs = _runs(df, keys, order)
    w = Window.partitionBy(*keys, _RUN).orderBy(*sort_columns(order))
    sizes = _split_keys(runs, keys, [F.count("*").alias("_n")])
    before = Window.partitionBy(*keys).orderBy(_RUN).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, _RUN, F.sum("_n").over(before).alias("_carry"))
    local = runs.withColumn(name, F.row_number().over(w).cast("long"))
    out = _null_safe_join(local, carry, keys)
    return out.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry", _RUN)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]
) -> DataFrame:
    """Columns of the preceding row of the same key: ``{new: old}``."""
    if not has_heavy_key(df, keys):
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        return df.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
    runs = _runs(df, keys, order)
    w = Window.partitionBy(*keys, _RUN).orderBy(*sort_columns(order))
    back = Window.partitionBy(*keys, _RUN).orderBy(*sort_columns(order, reverse=True))
    packed = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    tails = (
        runs.withColumn("_tail", F.row_number().over(back))
        .where("_tail = 1")
        .select(*keys, _RUN, packed.alias("_last"))
    )
    tails = _split_keys(tails, keys, [F.first("_last").alias("_last")])
    carry = tails.select(
        *keys, _RUN, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_RUN)).alias("_carry")
    )
    local = runs.withColumns(
        {"_here": F.lag(packed).over(w), "_first": F.row_number().over(w) == 1}
    )
    out = _null_safe_join(local, carry, keys)
    chosen = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_here"))
    out = out.withColumn("_chosen", chosen)
    out = out.withColumns({new: F.col(f"_chosen.{new}") for new in columns})
    return out.drop("_here", "_first", "_carry", "_chosen", _RUN)


_COMBINE = {
    "sum": lambda carry, here: F.coalesce(carry, F.lit(0)) + here,
    "max": lambda carry, here: F.greatest(carry, here),
    "min": lambda carry, here: F.least(carry, here),
}
_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def with_running(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, str]]
) -> DataFrame:
    """Running sum, max or min up to the current row: ``{new: (kind, old)}``."""
    frame = (Window.unboundedPreceding, Window.currentRow)
    if not has_heavy_key(df, keys):
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order)).rowsBetween(*frame)
        return df.withColumns(
            {new: _AGGREGATE[kind](old).over(w) for new, (kind, old) in columns.items()}
        )
    runs = _runs(df, keys, order)
    w = Window.partitionBy(*keys, _RUN).orderBy(*sort_columns(order)).rowsBetween(*frame)
    totals = [_AGGREGATE[kind](old).alias(f"_t_{new}") for new, (kind, old) in columns.items()]
    before = Window.partitionBy(*keys).orderBy(_RUN).rowsBetween(Window.unboundedPreceding, -1)
    carry = _split_keys(runs, keys, totals).select(
        *keys,
        _RUN,
        *[
            _AGGREGATE[kind](f"_t_{new}").over(before).alias(f"_p_{new}")
            for new, (kind, _) in columns.items()
        ],
    )
    local = runs.withColumns(
        {new: _AGGREGATE[kind](old).over(w) for new, (kind, old) in columns.items()}
    )
    out = _null_safe_join(local, carry, keys)
    out = out.withColumns(
        {new: _COMBINE[kind](F.col(f"_p_{new}"), F.col(new)) for new, (kind, _) in columns.items()}
    )
    return out.drop(*[f"_p_{new}" for new in columns], _RUN)


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in ``order``.

    The ``= 1`` filter lets Spark cut each map task to one row per key before
    the shuffle, so a heavy key costs no more than a light one.
    """
    return top_rows(df, keys, order, 1, reverse=True)


def top_rows(
    df: DataFrame, keys: list[str], order: list[str], n: int, reverse: bool = False
) -> DataFrame:
    """The first ``n`` rows per key (last ``n`` if reversed), cut on the map side."""
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order, reverse))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
