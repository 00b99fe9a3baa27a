"""Whitening of embeddings along the leading eigenvectors of their covariance.

Jacobi-Davidson without a matrix: the covariance V of the distinct vectors is
only ever applied. A pass over them sends a few directions to every task,
which adds up c (c . q) over its centred vectors c; sums of dimensions times
directions numbers come back, whatever the number of vectors.

The search space starts at random and is orthonormal. Each round projects V on
it (Rayleigh-Ritz), locks leading pairs whose residual has reached double
precision, and for the other wanted pairs (u, e) with residual r solves
(I - U U')(V - e I)(I - U U') t = -r by a few steps of MINRES, all pairs in
the same passes; the solutions widen the space. A wide space restarts from its
best directions; one that holds all dimensions is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.topk import integers
from quire.session import durable

#: Components asked for.
COMPONENTS = 4
#: Directions the search starts with, and restarts with once it has more than WIDEST.
START, WIDEST = 24, 96
#: Steps of MINRES for a correction, and rounds before the search is given up.
STEPS, ROUNDS = 3, 200
#: Largest residual of a locked pair, and least eigenvalue that counts as one, relative to the largest.
PRECISION, LEAST = 32 * np.finfo(np.float64).eps, 1e-12
#: Bytes of packed vectors in one row.
PACK = 4 << 20


def _pack(rows: DataFrame, length: int) -> DataFrame:
    """Vectors (v) of one length as rows of packed integers."""
    most = max(1, PACK // (8 * length))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), most):
                part = np.stack(batch["v"].iloc[begin : begin + most].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"x": [part.tobytes()]})

    return rows.select("v").mapInPandas(pack, "x binary")


def _chunks(batches: Iterator[pd.DataFrame], length: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for packed in batch["x"]:
            yield np.frombuffer(packed, dtype=np.int64).reshape(-1, length)


def _sums(packed: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums per dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * length
        for x in _chunks(batches, length):
            n += len(x)
            small = int(np.abs(x // 2).max()) < (1 << 60) // len(x)
            total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0), strict=True)]
        yield pd.DataFrame({"i": range(-1, length), "s": [str(v) for v in (n, *total)]})

    rows = packed.mapInPandas(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), [by.get(i, 0) for i in range(length)]


def _added(packed: DataFrame, mean: np.ndarray, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part`` over all centred vectors, added up in each task first."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for x in _chunks(batches, len(mean)):
            total += part(x - mean)
        yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

    out = np.zeros(int(np.prod(shape)))
    for r in packed.mapInPandas(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out.reshape(shape)


def _orthonormal(fresh: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Directions of ``fresh`` that the bases and each other do not hold."""
    known = np.hstack(bases) if bases else np.zeros((len(fresh), 0))
    out = known
    for q in fresh.T:
        size = np.linalg.norm(q)
        for _ in range(3):  # once more after each projection, for rounding
            q = q - out @ (out.T @ q)
        left = np.linalg.norm(q)
        if size > 0 and left > 1e-10 * size:
            out = np.column_stack([out, q / left])
    return out[:, known.shape[1] :]


def minres(apply: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, right: np.ndarray, held: np.ndarray, steps: int) -> np.ndarray:
    """Solutions t of P (V - shift I) P t = right, P without ``held``, a column each.

    The Lanczos vectors of all columns are applied in the same passes; the
    solution has the least residual in each column's Krylov space.
    """
    project = lambda x: x - held @ (held.T @ x)
    right = project(right)
    sizes = np.linalg.norm(right, axis=0)
    bases = [[r / s] if s > 0 else [] for r, s in zip(right.T, sizes, strict=True)]
    coefficients: list[list[np.ndarray]] = [[] for _ in bases]
    active = [j for j, b in enumerate(bases) if b]
    for _ in range(steps):
        if not active:
            break
        images = project(apply(np.column_stack([bases[j][-1] for j in active])))
        going = []
        for j, w in zip(active, images.T, strict=True):
            w = w - shifts[j] * bases[j][-1]
            basis = np.column_stack(bases[j])
            h = basis.T @ w
            w = w - basis @ h
            w = w - basis @ (basis.T @ w)
            left = np.linalg.norm(w)
            coefficients[j].append(np.append(h, left))
            if left > 1e-14 * max(1.0, np.abs(h).max()):
                bases[j].append(project(w) / np.linalg.norm(project(w)))
                going.append(j)
        active = going
    out = np.zeros_like(right)
    for j, columns in enumerate(coefficients):
        if not columns:
            continue
        m = len(columns)
        hessenberg = np.zeros((m + 1, m))
        for i, c in enumerate(columns):
            hessenberg[: len(c), i] = c
        y = np.linalg.lstsq(hessenberg, sizes[j] * np.eye(m + 1)[:, 0], rcond=None)[0]
        out[:, j] = np.column_stack(bases[j][:m]) @ y
    return out


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric operator, falling, and unit eigenvectors as columns."""
    wanted = min(wanted, size)
    space = _orthonormal(np.random.default_rng(12).standard_normal((size, min(size, START))))
    images = apply(space)
    locked, values = np.zeros((size, 0)), []
    for _ in range(ROUNDS):
        small = space.T @ images
        ritz, s = np.linalg.eigh((small + small.T) / 2)
        ritz, s = ritz[::-1], s[:, ::-1]
        vectors = space @ s
        residuals = images @ s - vectors * ritz
        residuals -= locked @ (locked.T @ residuals)
        scale = max([*values, ritz[0] if len(ritz) else 0.0, np.finfo(np.float64).tiny])
        whole = locked.shape[1] + space.shape[1] == size
        # leading pairs that are done leave the space
        done = 0
        while len(values) < wanted and done < len(ritz):
            if not whole and np.linalg.norm(residuals[:, done]) > PRECISION * np.sqrt(size) * scale:
                break
            values.append(float(ritz[done]))
            locked = np.column_stack([locked, vectors[:, done]])
            done += 1
        if len(values) == wanted:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        keep = slice(done, done + START if space.shape[1] > WIDEST else None)
        if done or keep.stop:
            space, images = vectors[:, keep], (images @ s)[:, keep]
        open_pairs = range(done, min(len(ritz), done + wanted - len(values)))
        if not open_pairs:  # all of the space is locked
            fresh = np.random.default_rng(size + len(values)).standard_normal((size, START))
        else:
            held = np.column_stack([locked, vectors[:, open_pairs]])
            fresh = minres(apply, ritz[list(open_pairs)], -residuals[:, open_pairs], held, STEPS)
        fresh = _orthonormal(fresh, locked, space)
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(size).standard_normal((size, 1)), locked, space)
        space, images = np.column_stack([space, fresh]), np.column_stack([images, apply(fresh)])
    raise RuntimeError(f"eigenvectors not found in {ROUNDS} rounds")


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def _whitened(rows: DataFrame, length: int, components: int) -> DataFrame:
    kind = rows.schema["vec_id"].dataType.simpleString()
    packed = durable(_pack(rows.select("v").distinct(), length))
    n, sums = _sums(packed, length)
    mean = np.array([s / n for s in sums])
    apply = lambda q: _added(packed, mean, lambda c: c.T @ (c @ q), (length, q.shape[1])) / n
    trace = float(_added(packed, mean, lambda c: np.array([(c * c).sum()]), (1,))[0]) / n
    values, axes = leading_pairs(apply, length, components) if trace > 0 else (np.zeros(0), np.zeros((length, 0)))
    real = values > LEAST * max(trace, 0)
    values, axes = values[real], axes[:, real]
    turn = axes / np.sqrt(values)
    k = len(values)
    spread = _added(packed, mean, lambda c: (c @ turn).T @ (c @ turn), (k, k)) / n if k else np.zeros((0, 0))
    error = float(np.abs(spread - np.eye(k)).max()) if k else 0.0
    reach = max(abs(s) for s in sums)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(np.int64)
            most = n * max(abs(int(x.max())), abs(int(x.min()))) + reach
            exact = most * most * length < 1 << 63
            from_mean = (x if exact else x.astype(object)) * n - np.array(sums, dtype=np.int64 if exact else object)
            deviation = [int(v) if int(v) < 1 << 63 else None for v in (from_mean * from_mean).sum(axis=1)]
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].repeat(k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": n,
                "deviation": pd.array(np.repeat(np.array(deviation, dtype=object), k), dtype="Int64"), "whitened": ((x - mean) @ turn).ravel(),
                "explained": np.tile(values / trace, len(x)), "identity_error": error, "eigenvalue": np.tile(values, len(x)),
            })

    return rows.select("vec_id", "v").mapInPandas(score, f"vec_id {kind}, {_OUT}")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 256) -> DataFrame:
    """Coordinates of every row along the leading components, a row for each.

    (vec_id, component, n, deviation, whitened, explained, identity_error,
    eigenvalue) of vec_id and embedding. Rows whose vector is null or holds
    null or non-finite entries are left out. The covariance is of the distinct
    vectors; repeated rows, and rows without an id, all get theirs. Vectors of
    different lengths are fitted apart, empty ones have no component. Where
    the vectors span fewer dimensions, as one vector alone does, only as many
    components exist. A deviation beyond a long is null. An empty table gives
    no rows; further columns are not read.
    """
    rows = durable(integers(vectors.select("vec_id", "embedding"), scale, "embedding").select("vec_id", "v"))
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.sparkSession.createDataFrame([], f"vec_id {kind}, {_OUT}")
    for length in lengths:
        if length:
            out = out.unionByName(_whitened(rows.where(F.size("v") == length), length, components))
    return out
