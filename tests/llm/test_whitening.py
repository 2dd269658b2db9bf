"""Whitening: rank-one updates against numpy, and the operator against a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from premisa.llm import spectral_whitening as sw
from premisa.llm.common import session

SCHEMA = "vec_id bigint, embedding array<double>, label int, x int, id string, `a.b` int, whitened int"


def scatter(x):
    y = x - x.mean(axis=0)
    return y.T @ y


@pytest.mark.parametrize("case", ["plain", "few", "equal", "one value", "blocks", "tiny"])
def test_spectrum_of_rows(case):
    """Also where eigenvalues are equal, where most entries deflate, and with fewer rows than columns."""
    r = np.random.default_rng(7)
    x = {
        "plain": r.normal(size=(200, 12)) * np.linspace(1, 300, 12) + 1000,
        "few": r.normal(size=(5, 12)),
        "equal": np.vstack([np.eye(9), -np.eye(9)] * 4),
        "one value": np.repeat(r.normal(size=(1, 6)), 20, axis=0),
        "blocks": np.kron(np.eye(4), r.normal(size=(6, 3))),
        "tiny": np.vstack([r.normal(size=(40, 5)), r.normal(size=(40, 5)) * 1e-9]),
    }[case]
    parts = []
    for rows in (x[: len(x) // 3 + 1], x[len(x) // 3 + 1 :], x):
        s = None
        for row in rows:
            s = sw.with_row(s, row)
        parts.append(s)
    for n, mean, values, vectors in (parts[2], sw.combined(parts[0], parts[1])):
        want = scatter(x)
        size = max(np.abs(want).max(), 1e-300)
        assert n == len(x) and np.allclose(mean, x.mean(axis=0))
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max(initial=0) < 1e-12
        assert case == "one value" or np.abs((vectors * values) @ vectors.T - want).max() < 1e-12 * size
        assert (np.diff(values) >= 0).all()


def test_roots_close_to_their_poles():
    d = np.array([1.0, 1.0 + 1e-12, 2.0, 2.0 + 1e-9, 5.0])
    z = np.array([1e-9, 0.5, 1e-6, 0.5, 0.7])
    z /= np.sqrt(z @ z)
    roots, gap = sw.secular_roots(d, z, 3.0)
    assert (roots[:-1] >= d[:-1]).all() and (roots[:-1] <= d[1:]).all() and d[-1] < roots[-1] <= d[-1] + 3
    f = 1 / 3.0 + ((z * z)[:, None] / gap).sum(axis=0)
    assert (np.abs(f) < 1e-12 * (1 / 3.0 + np.abs((z * z)[:, None] / gap).sum(axis=0))).all()
    want = np.linalg.eigvalsh(np.diag(d) + 3 * np.outer(z, z))
    assert np.allclose(roots, want, rtol=1e-14)


def checked(rows, x, k=8):
    """The rows of the operator against exact sums and a plain eigendecomposition."""
    n, d = x.shape
    sums = [sum(int(v) for v in c) for c in x.T]
    mean = np.array([s / n for s in sums])
    y = x - mean
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(sum(Fraction(n * int(v) - s, n) ** 2 for v in c) for c, s in zip(x.T, sums, strict=True)) / n)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(by) == n and all(sorted(v) == list(range(1, min(k, d) + 1)) for v in by.values())
    for i in by:
        for c, r in by[i].items():
            assert r.n == n and int(r.deviation) == sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums, strict=True))
            assert abs(r.explained - values[c - 1] / trace) < 1e-9 * r.explained
            assert 0 <= r.identity_error < 1e-9
    for c in range(min(k, d)):
        got = np.array([by[i][c + 1].whitened for i in range(n)])
        want = y @ vectors[:, c] / np.sqrt(values[c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7, c


@pytest.mark.parametrize(("width", "parts"), [(5, 1), (40, 7), (60, 40)])
def test_whiten_equals_a_plain_decomposition(spark, width, parts):
    session(spark)
    r = np.random.default_rng(width)
    v = r.normal(size=(150, width)) * np.linspace(0.05, 0.4, width) ** 2
    v[40:90] = v[40]
    data = [(i, [float(c) for c in row], 1, 2, "i", 3, 4) for i, row in enumerate(v)]
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    x = np.floor(1024 * v) + 100_000
    checked(sw.whiten(df, fan=3).collect(), x.astype(np.int64))


def test_whiten_leaves_out_unsound_rows(spark):
    session(spark)
    good = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.5, -0.2]), (4, [-0.4, 0.3])]
    bad = [(5, None), (6, [None, 0.1]), (7, [float("nan"), 0.1]), (8, [0.1, float("-inf")]), (None, None)]
    df = spark.createDataFrame([(*x, None, 2, None, 3, 4) for x in good + bad], SCHEMA)
    rows = sw.whiten(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in rows) == sorted(
        [("1", 1), ("1", 2)] * 2 + [("None", 1), ("None", 2), ("4", 1), ("4", 2)]
    )
    assert {r.n for r in rows} == {4} and abs(sum({r.explained for r in rows}) - 1) < 1e-12
    assert sw.whiten(df.limit(0)).count() == 0
    assert sw.whiten(df.where("vec_id = 4")).count() == 0
    assert sw.whiten(df.where("vec_id = 1")).count() == 0
    # a column that never changes has no component
    flat = spark.createDataFrame([(i, [float(i), 7.0], 1, 2, "", 3, 4) for i in range(9)], SCHEMA)
    assert {r.component for r in sw.whiten(flat).collect()} == {1}
    with pytest.raises(ValueError, match="differ in length"):
        sw.whiten(df.union(spark.createDataFrame([(9, [1.0], 1, 2, "", 3, 4)], SCHEMA)))
    with pytest.raises(ValueError, match="too large"):
        sw.whiten(spark.createDataFrame([(9, [1e300], 1, 2, "", 3, 4)], SCHEMA))


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 3], [-(1 << 40), 5]])
    n, total = 10**9, np.array([12345, 8])
    want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    # 38 digits hold them, 64 bits do not
    assert max(want) > 1 << 63 and math.log10(max(want)) > 38
    with pytest.raises(Exception, match="precision"):
        sw._deviations(x, n, total)
    n = 10**6
    want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    assert [int(v) for v in sw._deviations(x, n, total).to_pylist()] == want
