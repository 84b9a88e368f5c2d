"""Whitening against exact integers and a dense eigensolver."""

import math
import random

import numpy as np
import pytest

from acadspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def brute(rows):
    """{index: x} of the usable rows, the fit list, its sums and its covariance."""
    usable = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, (_, v) in enumerate(rows)
              if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(usable.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    return usable, fit, n, sums, z.T @ z / n


def check(spark, rows, count=16):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    usable, fit, n, sums, v = brute(rows)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    out = W.whitening_report(df).collect()
    real = min(count, int((value > 1e-9 * value.sum()).sum()))
    assert len(out) == len(usable) * real and {r.component for r in out} == set(range(1, real + 1))
    by_id = {}
    for r in out:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for i, x in usable.items():
        got = by_id[rows[i][0]]
        assert got[1].deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) and got[1].n == n
        z = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        for k in range(1, real + 1):
            assert got[k].explained == pytest.approx(value[k - 1] / value.sum(), rel=1e-9) and got[k].identity_error < 1e-9
            gap = min(abs(value[k - 1] - e) for j, e in enumerate(value) if j != k - 1)
            if gap > 1e-6 * value[0]:
                want = z @ vector[:, k - 1] / math.sqrt(value[k - 1])
                if abs(want) > 1e-3:
                    signs.setdefault(k, set()).add(got[k].whitened * want > 0)
                assert abs(abs(got[k].whitened) - abs(want)) < 1e-7
    assert all(len(s) == 1 for s in signs.values())
    return out


def test_random_with_copies_and_odd_rows(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1 + j % 5) for j in range(24)] for _ in range(300)]
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[7]) for i in range(150)]
    rows += [(2000, None), (2001, [1.0] * 23 + [None]), (2002, [1.0] * 23 + [float("nan")]), (2003, [float("inf")] + [0.0] * 23)]
    check(spark, rows)


def test_few_dimensions_and_equal_eigenvalues(spark):
    grid = [(i, [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate((a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1))]
    out = check(spark, grid)
    assert len(out) == 24 and all(abs(r.explained - 1 / 3) < 1e-12 for r in out)
    check(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])  # rank one


def test_clusters_of_values():
    rng = np.random.default_rng(5)
    for values in ([9, 9, 9, 4, 4 + 1e-13, 4 - 1e-13, 1, 1, 1e-7, 0], list(range(60, 0, -1)), [5] * 12, [1, 0, 0, 0], [3, 2]):
        q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        v = q @ np.diag(np.array(values, float)) @ q.T
        v = (v + v.T) / 2
        k = min(16, len(values))
        got, vec = W.leading_components(v, k)
        assert np.allclose(got, sorted(values)[::-1][:k], atol=1e-12 * max(values))
        assert np.abs(vec.T @ vec - np.eye(k)).max() < 1e-13
        assert np.abs(v @ vec - vec * got).max() < 1e-12 * max(values)
    for v in (np.diag(np.arange(1.0, 21)), np.eye(7)):  # nothing to reduce
        got, vec = W.leading_components(v, 5)
        assert np.allclose(v @ vec, vec * got, atol=1e-12)


def test_nothing_and_large_steps(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whitening_report(empty).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "x")] * 3 + [(None, None, 1, "x"), (2, [], 1, "x")], SCHEMA)
    assert W.whitening_report(one).collect() == []
    rows = [(i, [3e38 if i == 0 else float(i), 0.5 * (i % 3)]) for i in range(5)] + [(None, [1.0, 2.0])] * 2 + [(9, [1.0] * 5)]
    out = W.whitening_report(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert {r.n for r in out} == {6} and {r.vec_id for r in out} == {0, 1, 2, 3, 4, None}
    assert all(r.identity_error < 1e-4 for r in out)
