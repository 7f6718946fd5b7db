"""Whitening against numpy's own eigensolver, brute-force statistics and edge cases."""

import math

import numpy as np
import pytest

from newsengine.llm.whitening import GRID, fit_whitener, leading_components, sturm_counts, tridiagonal, whiten

SCHEMA = "vec_id bigint, embedding array<float>, n string, __x int"


def brute(rows, k=4):
    good = [(i, [math.floor(GRID * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = ((fit * n - total) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        far = np.array(x, dtype=object) * n - total
        for j in range(len(values)):
            out[i, j + 1] = (n, int((far * far).sum()), (far / n).astype(float) @ vectors[:, j] / math.sqrt(values[j]), values[j] / np.trace(cov))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_components_equal_those_of_a_library_solver(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, size))
    cov = a @ a.T
    d, e, _ = tridiagonal(cov)
    want = np.linalg.eigvalsh(cov)
    assert list(sturm_counts(d, e, (want[1:] + want[:-1]) / 2)) == list(range(1, size))
    values, vectors = leading_components(cov, 4)
    k = min(4, size)
    assert np.allclose(values, want[::-1][:k], rtol=1e-12, atol=1e-12 * want[-1])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(cov @ vectors - vectors * values).max() < 1e-11 * want[-1]


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1], [3, 3 - 1e-13, 3 - 2e-13, 1, 0], [0, 0, 0, 0, 0], [1, 0, 0, 0, 0]])
def test_equal_and_close_eigenvalues_give_orthogonal_vectors(values):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    cov = q @ np.diag(np.array(values, float)) @ q.T
    found, vectors = leading_components((cov + cov.T) / 2, 4)
    assert np.allclose(found, sorted(values, reverse=True)[:4], atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-10
    assert np.abs(cov @ vectors - vectors * found).max() < 1e-11


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * [1, 3, 0.2, 2, 1, 0.5]]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one vector many times counts once
    rows += [(7, rows[8][1]), (None, rows[9][1])]  # a repeated and a null id
    odd = [(2000, None), (2001, [None, *[1.0] * 5]), (2002, [float("nan"), *[1.0] * 5]), (2003, [float("-inf"), *[1.0] * 5]), (2004, [1.0]), (2005, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], SCHEMA)
    found = whiten(df, fit_whitener(df), keep=["vec_id"]).collect()
    want = brute(rows[:300])
    assert len(found) == 4 * len(rows)
    assert not {r.vec_id for r in found} & {i for i, _ in odd}
    sign = {}
    for r in found:
        i = 7 if r.vec_id is not None and 1000 <= r.vec_id < 2000 else r.vec_id
        if i is None or i == 7:
            continue
        n, deviation, white, explained = want[i, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert math.isclose(r.explained, explained, rel_tol=1e-10)
        s = sign.setdefault(r.component, math.copysign(1, white * r.whitened))
        assert math.isclose(s * r.whitened, white, rel_tol=1e-8, abs_tol=1e-9)
        assert r.identity_error < 1e-9


def test_degenerate_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fit_whitener(none) is None
    assert whiten(none, None, keep=["vec_id"]).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], SCHEMA)
    found = whiten(same, fit_whitener(same), keep=["vec_id"]).collect()
    assert len(found) == 4
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], "", 0) for i in range(5)], SCHEMA)
    found = whiten(line, fit_whitener(line), keep=["vec_id"]).collect()
    assert {r.component for r in found if r.whitened is not None} == {1}
    assert abs(sum(r.whitened**2 for r in found if r.component == 1) / 5 - 1) < 1e-12


def test_wide_entries_stay_exact(spark):
    vectors = [[3e15, 0.0], [-3e15, 5.0], [1e3, 7.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    model = fit_whitener(df)
    x = [[math.floor(GRID * c) for c in v] for v in vectors]
    assert model.total == tuple(map(sum, zip(*x, strict=True)))
    for r in whiten(df, model, keep=["vec_id"]).collect():
        exact = sum((3 * c - s) ** 2 for c, s in zip(x[r.vec_id], model.total, strict=True))
        assert r.deviation == (exact if exact < 2**63 else None)
