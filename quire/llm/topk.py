"""Exact top-k inner products by a table of pivot distances.

Vectors become integers. Pivots are chosen once, from a bounded sample, each
the vector that the pivots before it span least of, and every vector's squared
distances to all of them are stored beside it. Together they fix where it
stands to the span of the pivots: a foot in it and a height above it. With
feet a and heights h, |q - x|^2 is at least |a_q - a_x|^2 + (h_q - h_x)^2, the
largest bound that the distances of both allow, as that is reached where the
heights point the same way; so q . x is at most a_q . a_x + h_q h_x. (A single
pivot's bound |d(q, p) - d(x, p)|, at its largest over the pivots, leaves
nearly every pair of these vectors in.)

Candidates are evaluated in the order of that bound until the bound of the
next is under the k-th best product found. A query starts with the k-th best
of a sample, so that no group needs to find its own. Products are integers, so
ties, too, are exact. Candidates and queries are dealt over blocks of bounded
size; a task takes one block of each and returns its k best; those meet by
query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import smallest_hashes
from quire.session import durable

#: Candidates, and queries, of one group.
GROUP_ROWS = 16_384
#: Pivots for each dimension, and sampled rows of one length that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 0.875, 1_024
#: Candidates that give a query its first threshold: at most so many, and one in so many.
FIRST, FIRST_SHARE = 4_096, 16
#: Queries whose bounds are in memory at once.
BLOCK = 32
#: Candidates evaluated between two looks at the bound.
STEP = 64
#: Slack for rounding in bounds, relative to the product of the lengths.
SLACK = 1e-9
#: Share of a vector's square that a pivot must add to those before it.
NEW = 1e-6


def integers(df: DataFrame, scale: int, vector: str) -> DataFrame:
    """Rows whose vector is whole and finite, as integers floor(scale * x)."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = df.where(F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.withColumn("v", F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Rows of the sample, each with the largest part outside the span of those before."""
    left = sample.astype(np.float64)
    size = (left**2).sum(axis=1)
    least, chosen = NEW * size.max(initial=0), []
    while len(chosen) < max(1, int(PIVOTS * sample.shape[1])) and len(sample):
        out = (left**2).sum(axis=1)
        p = int(out.argmax())
        if out[p] <= least:
            break
        chosen.append(p)
        axis = left[p] / np.sqrt(out[p])
        left = left - np.outer(left @ axis, axis)
    return sample[chosen].astype(np.float64)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to pivots; exact while they are under 2**53."""
    x = vectors.astype(np.float64)
    return (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T


def standing(square: np.ndarray, table: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Foot and height of vectors over the span of the pivots, from their squares and pivot distances."""
    if not len(pivots):
        return np.sqrt(square)[:, None]
    products = (square[:, None] + (pivots**2).sum(axis=1)[None] - table) / 2
    foot = np.linalg.solve(np.linalg.cholesky(pivots @ pivots.T), products.T).T
    return np.column_stack([foot, np.sqrt(np.maximum(square - (foot**2).sum(axis=1), 0))])


def best_in_group(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
    pivots: np.ndarray, tables: tuple[np.ndarray, np.ndarray], floors: np.ndarray,
) -> tuple[pd.DataFrame, int]:
    """Up to k best candidates of each query, none under its floor; also how many products were evaluated.

    ``tables``: the pivot distances of candidates and queries. ``floors``:
    scores that k candidates somewhere are known to reach.
    """
    exact = vectors.shape[1] * float(max(np.abs(vectors).max(initial=0), 1)) * float(max(np.abs(queries).max(initial=0), 1)) < 2**53
    kind = np.float64 if exact else np.int64
    x_square, q_square = ((side.astype(np.float64) ** 2).sum(axis=1) for side in (vectors, queries))
    x_at, q_at = standing(x_square, tables[0], pivots), standing(q_square, tables[1], pivots)
    slack = SLACK * (np.sqrt(x_square.max(initial=0) * q_square) + 1)
    xk, qk = vectors.astype(kind), queries.astype(kind)
    out: list[tuple[int, int, int]] = []
    evaluated = 0
    for begin in range(0, len(qk), BLOCK):
        block = slice(begin, begin + BLOCK)
        upper = q_at[block] @ x_at.T + slack[block, None]
        for row, q in enumerate(range(begin, begin + len(upper))):
            best: list[tuple[int, int]] = []
            floor, left = floors[q], upper[row]
            open_ = np.flatnonzero(left >= floor)
            order = open_[np.argsort(-left[open_], kind="stable")]
            at = 0
            while at < len(order) and left[order[at]] >= floor:
                part = order[at : at + STEP]
                part = part[ids[part] != query_ids[q]]
                scores = xk[part] @ qk[q]
                evaluated += len(part)
                at += STEP
                part, scores = part[scores >= floor], scores[scores >= floor]
                best = sorted({*best, *((-int(s), int(i)) for s, i in zip(scores, ids[part], strict=True))})[:k]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
            out += [(int(query_ids[q]), i, -s) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64"), evaluated


def _stack(side: pd.DataFrame, name: str = "v", kind: type = np.int64) -> np.ndarray:
    return np.stack(side[name].to_numpy()).astype(kind)


def with_distances(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``d``, the squared distances to the pivots of a vector's length."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("n"):
                yield part.assign(d=list(distances(_stack(part), shared.value[n])))

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "v", "n").mapInPandas(measure, f"vec_id {kind}, v array<long>, n int, d array<double>")


def with_floors(asked: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Add ``floor``: the k-th best product of a query with the sampled candidates."""
    shared = asked.sparkSession.sparkContext.broadcast(sample)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("n"):
                ids, vectors = shared.value[n]
                floors = []
                for query, v in zip(part["vec_id"], part["v"], strict=True):
                    others = np.flatnonzero(ids != query)
                    scores = vectors[others] @ np.asarray(v, dtype=np.int64)
                    floors.append(int(np.partition(scores, -k)[-k]) if len(others) >= k else -(2**63))
                yield part.assign(floor=floors)

    schema = asked.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return asked.mapInPandas(look, f"{schema}, floor long")


def _blocks(count: int, size: int, least: int) -> int:
    """Blocks of at most about ``size`` rows of one length; at least ``least`` for inputs of some size."""
    return max(1, -(-count // size), min(least, -(-count // 1024)))


def _most(rows: DataFrame) -> int:
    return rows.groupBy("n").count().agg(F.max("count")).first()[0] or 0


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The k best candidates of every query: (query_id, rank, vec_id, score).

    Both sides have vec_id and v (array of long). A query meets candidates of
    its own length and not its own id. Rows without an id take no part,
    repeated rows count once, ties go to the smaller id; an empty side gives
    no rows; further columns are not read.
    """
    once = lambda side: durable(side.where("vec_id is not null").select("vec_id", "v", F.size("v").alias("n")).distinct())
    rows, asked = once(candidates), once(queries)
    most, cores = _most(rows), candidates.sparkSession.sparkContext.defaultParallelism
    groups, turns = _blocks(most, group_rows, cores), _blocks(_most(asked), group_rows, 1)
    # ids that repeat with other vectors give one candidate to the first threshold
    firsts = rows.groupBy("n", "vec_id").agg(F.min("v").alias("v"))
    drawn = smallest_hashes(firsts, "n", max(PIVOT_SAMPLE, min(FIRST, most // FIRST_SHARE)), "vec_id").orderBy("n", "vec_id").collect()
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {r["n"] for r in drawn}:
        mine = [r for r in drawn if r["n"] == n]
        by[n] = np.array([r["vec_id"] for r in mine]), np.array([r["v"] for r in mine], dtype=np.int64).reshape(len(mine), n)
    pivots = {n: choose_pivots(v[:PIVOT_SAMPLE]) for n, (_, v) in by.items()}
    size = min(FIRST, most // FIRST_SHARE)
    sample = {n: (i[:size], v[:size]) for n, (i, v) in by.items()}
    known = F.broadcast(candidates.sparkSession.createDataFrame([(n,) for n in by], "n int"))
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    dealt = with_distances(rows, pivots).withColumn("g", part(groups)).withColumn("t", over(turns))
    met = with_floors(with_distances(asked.join(known, "n", "left_semi").select("vec_id", "v", "n"), pivots), sample, k)
    sent = met.withColumn("t", part(turns)).withColumn("g", over(groups))
    shared = candidates.sparkSession.sparkContext.broadcast(pivots)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        tables = _stack(left, "d", np.float64), _stack(right, "d", np.float64)
        return best_in_group(
            left["vec_id"].to_numpy(), _stack(left), right["vec_id"].to_numpy(), _stack(right), k,
            shared.value[int(left["n"].iat[0])], tables, right["floor"].to_numpy(),
        )[0]

    keys = ("n", "g", "t")
    found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    found = found.distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised_top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """Every row whose id is divisible by ``every`` against all rows."""
    rows = integers(vectors.select("vec_id", "embedding"), scale, "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
