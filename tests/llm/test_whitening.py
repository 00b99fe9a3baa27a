"""Whitening against dense linear algebra, and its odd inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quire.llm import whitening
from quire.llm.queries import QUERIES
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, n string, eigenvalue int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "own", 1) for i, v in rows], SCHEMA)


def _check(rows, got, components=4):
    """Against the covariance as a matrix; signs are free, one a component."""
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in sound]
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit.astype(float) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    assert len(got) == len(sound) * components
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for (i, _), v in zip(sound, x, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for k in range(components):
            r = by[i, k + 1][0]
            want = float((np.array(v, dtype=float) - np.array([s / n for s in sums])) @ axes[:, k] / math.sqrt(values[k]))
            if abs(want) > 0.1:
                signs.setdefault(k, want * r["whitened"] > 0)
            assert abs(abs(want) - abs(r["whitened"])) < 1e-6 and (abs(want) < 0.1 or signs[k] == (want * r["whitened"] > 0))
            assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(values[k] / cov.trace(), rel=1e-9)


def test_equals_dense_decomposition(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    _check(rows, QUERIES["op12_whitening"](spark, SF_DIR).collect())


def test_nulls_repeats_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, [])]
    again = [(200 + i, v) for i, v in rows[:10]]
    out = whitening.whiten(_frame(spark, rows + bad + again)).collect()
    _check(rows + again, out)
    # another length is another space; a null id is an id
    short = [(300, [1.0, 0.0]), (301, [0.0, 1.0]), (None, [0.5, 0.25])]
    both = whitening.whiten(_frame(spark, rows + short)).collect()
    assert sorted(r["component"] for r in both if r["n"] == 3) == [1, 1, 1, 2, 2, 2]
    assert len([r for r in both if r["n"] == 40]) == 160


def test_few_dimensions(spark):
    assert whitening.whiten(_frame(spark, [])).collect() == []
    assert whitening.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(_frame(spark, [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])])).collect()
    assert [r["component"] for r in line] == [1, 1] and {round(abs(r["whitened"]), 9) for r in line} == {1.0}
    huge = whitening.whiten(_frame(spark, [(1, [3e9, 0.0]), (2, [-3e9, 1.0]), (3, [0.0, 5.0])])).collect()
    assert len(huge) >= 3 and all(r["deviation"] is None for r in huge if r["vec_id"] == 1)


def test_solver_on_near_ties_and_restarts():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = np.concatenate([[5.0, 5.0 - 1e-9, 4.999, 4.99], np.linspace(4.9, 0.1, 296)])
    v = (q * values) @ q.T
    got, axes = whitening.leading_pairs(lambda x: v @ x, 300, 4)
    assert np.abs(got - values[:4]).max() < 1e-12
    assert np.linalg.norm(v @ axes - axes * got, axis=0).max() < 1e-11
    assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12


def test_minres_solves_shifted_system():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    v, held = a + a.T, np.linalg.qr(rng.standard_normal((30, 2)))[0]
    right = rng.standard_normal((30, 2))
    t = whitening.minres(lambda x: v @ x, np.array([0.3, -0.2]), right, held, 28)
    project = np.eye(30) - held @ held.T
    for j, shift in enumerate((0.3, -0.2)):
        assert np.linalg.norm(project @ (v - shift * np.eye(30)) @ t[:, j] - project @ right[:, j]) < 1e-6
