"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Groups that one key is dealt over before its rows meet, level by level.
SALTS = (1024, 32, 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(docs: DataFrame, *needed: str) -> DataFrame:
    """All of a row under ``row``, beside the columns an operator reads.

    Whatever names a user's columns have, they cannot meet an operator's own;
    ``select("row.*")`` gives them back.
    """
    own = F.struct(*[F.col(_quoted(c)).alias(c) for c in docs.columns])
    return docs.select(own.alias("row"), *[F.col(_quoted(c)).alias(c) for c in needed])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the given values decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def smallest_draws(df: DataFrame, key: str, size: int, draw: str, *ties: str) -> DataFrame:
    """At most ``size`` rows of each key, those with the smallest ``draw``, a hash.

    A key is cut within salts first, whose groups meet level by level, so that
    no task sees more than its share of a large key and none after the first
    more than 32 times ``size`` rows of it.
    """
    dealt = df
    for salts in SALTS:
        salt = F.pmod(F.xxhash64(draw), F.lit(salts))
        place = F.row_number().over(Window.partitionBy(key, salt).orderBy(draw, *ties))
        dealt = dealt.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")
    return dealt


def smallest_hashes(df: DataFrame, key: str, size: int, *hashed: str) -> DataFrame:
    """At most ``size`` rows of each key, those with the smallest hash of ``hashed``."""
    drawn = df.withColumn("_draw", F.xxhash64(F.lit(17), *hashed))
    return smallest_draws(drawn, key, size, "_draw", *hashed).drop("_draw")


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key, with the text of the smallest hash: repeated ids teach once."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def numbered(df: DataFrame, key: str, order: list[str], buckets: int, name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, no key in one task.

    Rows fall into buckets by a hash; counts per (key, bucket) give where each
    bucket begins, and a window numbers the rows inside. The table of counts
    has at most ``buckets`` rows a key. Only for rows that ``order`` tells
    apart, or that are equal. ``df`` should be a table, as it is read twice.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b"))
        .agg(F.count("*").alias("_n"))
        .select("_key", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return (
        dealt.withColumn("_inside", inside)
        .join(starts, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_inside", "_key", "_b", "_start")
    )


#: Largest bitmap, as a power of two of bits: 8 MB.
MOST_BITS = 26


def bitmap(df: DataFrame, name: str) -> np.ndarray:
    """Bits of a column of hashes, for telling early which rows cannot be in it.

    512 bits a row, up to a fixed size; with more rows it passes more, and the
    join behind it still decides.
    """
    bits = min(MOST_BITS, max(10, (512 * df.count()).bit_length()))
    low = F.col(name).bitwiseAND((1 << bits) - 1)
    one = F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))")
    cells = df.where(F.col(name).isNotNull()).groupBy(F.shiftright(low, 6).alias("cell")).agg(F.bit_or(one).alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for r in cells.collect():  # a cell at most once, and there are 2**20 at most
        out[r["cell"]] = r["bits"]
    return out.view(np.uint64)


def hits(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes.astype(np.int64).view(np.uint64) & np.uint64(len(cells) * 64 - 1)
    return ((cells[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)) == 1


def in_bitmap(df: DataFrame, name: str, cells: np.ndarray) -> DataFrame:
    """The rows whose hash may be in the bitmap."""
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[hits(shared.value, batch[name].to_numpy())]

    return df.mapInPandas(keep, df.schema)
