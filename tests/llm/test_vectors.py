"""Whitening, against whole-number arithmetic in Python and known eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from flowscope.llm import queries, whitening

HIGH = np.longdouble


def known(values, seed=0):
    """A symmetric matrix in extended precision with these eigenvalues, and its eigenvectors."""
    v = np.random.default_rng(seed).standard_normal(len(values)).astype(HIGH)
    h = np.eye(len(values), dtype=HIGH) - 2 * np.outer(v, v) / (v @ v)
    return (h * np.array(values, HIGH)) @ h.T, h


def space_error(axes, want):
    """How far the space of ``axes`` is from that of ``want``."""
    return float(np.abs(axes - want @ (want.T @ axes)).max())


@pytest.mark.parametrize("values", [
    [5.0, 3.0, 2.0, 1.0],
    [1e12, 1e3, 1.0, 1e-3],
    [*np.linspace(10, 10.01, 40)],  # closer than the first solver can tell apart
    [1 + HIGH(i) * HIGH(1e-8) for i in range(6)] + [7.0, 9.0],
    [1e-30, 2e-30, 3e-30], [1e60, 2e60, 4e60],
])
def test_eigenvectors_to_double_precision(values):
    matrix, h = known(values)
    got_values, axes = whitening.refined_eigen(matrix)
    order = np.argsort(-np.array(values, HIGH))
    top = max(map(float, values))
    assert np.abs(got_values - np.array(values, HIGH)[order]).max() <= 1e-15 * top
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-15
    gap = float(np.min(np.abs(np.diff(np.sort(np.array(values, HIGH)))))) / top
    signs = np.sign((axes * h[:, order]).sum(0))
    assert np.abs(axes * signs - h[:, order]).max() < max(4e-16, 1e-17 / gap)


def test_equal_eigenvalues_give_any_basis_of_their_space():
    values = [4.0, 2.0, 2.0, 2.0, 1.0, 1.0, 0.0, 0.0]
    matrix, h = known(values, 3)
    got, axes = whitening.refined_eigen(matrix)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-15
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-15
    for some in ([0], [1, 2, 3], [4, 5], [6, 7]):
        assert space_error(axes[:, some].astype(HIGH), h[:, some]) < 1e-15


def test_clusters_within_clusters():
    """Gaps of 1, 1e-6 and 1e-12, each solved at its own scale."""
    values = [HIGH(a) + HIGH(b) * HIGH(1e-6) + HIGH(c) * HIGH(1e-12) for a in (1, 2) for b in (0, 1) for c in (0, 1)]
    matrix, h = known(values, 5)
    _, axes = whitening.refined_eigen(matrix)
    order = np.argsort(-np.array(values, HIGH))
    signs = np.sign((axes * h[:, order]).sum(0))
    assert np.abs(axes * signs - h[:, order]).max() < 1e-5


def test_a_matrix_of_zeros_and_of_one_row():
    values, axes = whitening.refined_eigen(np.zeros((3, 3), HIGH))
    assert values.tolist() == [0, 0, 0] and axes.tolist() == np.eye(3).tolist()
    assert whitening.refined_eigen(np.full((1, 1), HIGH(7)))[0].tolist() == [7]


def plainly(vectors):
    """n, and per vector the exact deviation, with the exact covariance, in Python's whole numbers."""
    x = {tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors}
    n, dims = len(x), len(next(iter(x)))
    s = [sum(v[i] for v in x) for i in range(dims)]
    deviation = {v: sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x}
    mean = [Fraction(t, n) for t in s]
    cov = [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in x) / n for j in range(dims)] for i in range(dims)]
    return n, s, deviation, cov


@pytest.mark.parametrize("scale, dims, parts", [(1.0, 5, 1), (3e5, 4, 7), (1e-3, 3, 3), (1.0, 20, 5)])
def test_whitened_against_whole_numbers(spark, scale, dims, parts):
    rng = np.random.default_rng(int(dims))
    some = [[float(x) for x in rng.standard_normal(dims) * scale * (1 + i % 3)] for i in range(60)]
    some += some[:30] + [some[0]] * 20  # repeated rows count once
    vectors = spark.createDataFrame([*enumerate(some)], "vec_id long, embedding array<double>").repartition(parts)
    models = whitening.fit(vectors)
    n, s, deviation, cov = plainly(some)
    model = models[dims]
    assert model.n == n and [t + n * 1_000_000 for t in model.sums] == s
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    trace = float(sum(cov[i][i] for i in range(dims)))
    k = min(dims, 16)
    got = {r.vec_id: r for r in whitening.whiten(vectors, models).collect()}
    assert len(got) == len(some)
    kept = values[::-1][:k] > dims * 2.3e-16 * values[-1]
    for i, v in enumerate(some):
        x = tuple(math.floor(64 * c) + 1_000_000 for c in v)
        assert got[i].deviation == (deviation[x] if deviation[x] < 2 ** 63 else None)
        assert got[i].n == n and len(got[i].whitened) == k
        centred = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)])
        for j in range(k):
            if not kept[j]:
                assert got[i].whitened[j] is None
                continue
            e, u = values[::-1][j], axes[:, ::-1][:, j]
            assert abs(abs(got[i].whitened[j]) - abs(float(centred @ u)) / math.sqrt(e)) < 1e-9
            assert abs(got[i].explained[j] - e / trace) < 1e-9 * got[i].explained[j]
        assert got[i].identity_error < 1e-12


def test_entries_too_large_for_sums_of_64_bits(spark):
    """Products beyond 53 and 63 bits are added up exactly; a deviation beyond 63 bits is null."""
    some = [[2.0 ** 40 + i, -(2.0 ** 41) * i, 3.0 * i * i] for i in range(5)]
    vectors = spark.createDataFrame([*enumerate(some)], "vec_id long, embedding array<double>")
    models = whitening.fit(vectors)
    n, s, deviation, cov = plainly(some)
    assert [t + n * 1_000_000 for t in models[3].sums] == s
    assert abs(models[3].values.sum() / float(sum(cov[i][i] for i in range(3))) - 1) < 1e-14
    for r in whitening.whiten(vectors, models).collect():
        want = deviation[tuple(math.floor(64 * c) + 1_000_000 for c in some[r.vec_id])]
        assert r.deviation == (want if want < 2 ** 63 else None)
    assert sorted(x < 2 ** 63 for x in deviation.values()) == [False] * 4 + [True]


def test_odd_vectors(spark):
    """Null, empty, with null or non-finite entries, of several lengths, equal ones, null keys, clashing names."""
    nan, inf = float("nan"), float("inf")
    some = [None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [-inf, 0.0], [2.0 ** 56, 0.0], [1e300, 0.0],
            [1.0, 2.0], [3.0, 5.0], [3.0, 5.001], [-4.0, 1.0], [7.0], [7.0], [1.0, 1.0, 1.0]]
    rows = [(None if i % 2 else i, v, 1.0, "clash", 3) for i, v in enumerate(some)]
    schema = "vec_id long, embedding array<double>, n double, key string, whitened int"
    vectors = spark.createDataFrame(rows, schema)
    models = whitening.fit(vectors)
    assert {d: m.n for d, m in models.items()} == {1: 1, 2: 3, 3: 1}  # 5.0 and 5.001 are one vector
    got = whitening.whiten(vectors, models)
    assert got.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    assert sorted(str(r.vec_id) for r in found) == sorted(str(r[0]) for r in rows[8:])
    for r in found:
        if r.n == 1:  # one vector has no variance
            assert r.deviation == 0 and r.identity_error is None
            assert set(r.whitened) == {None} and set(r.explained) == {None}
        else:
            assert len(r.whitened) == 2 and r.identity_error < 1e-12
    # a line: the second component has no variance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")
    for r in whitening.whiten(line, whitening.fit(line)).collect():
        assert r.whitened[1] is None and r.whitened[0] is not None and abs(r.explained[0] - 1) < 1e-12
    assert whitening.fit(vectors.limit(0)) == {}
    assert whitening.whiten(vectors.limit(0), {}).collect() == []


def test_query_of_whitening(spark, tmp_path):
    rng = np.random.default_rng(2)
    some = [[float(x) for x in rng.standard_normal(20).astype(np.float32)] for _ in range(80)] + [None]
    frame = spark.createDataFrame([*enumerate(some)], "vec_id long, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double"}
    rows = got.collect()
    n, _, deviation, _ = plainly(some[:-1])
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, j) for i in range(80) for j in range(1, 17)]
    white = np.zeros((80, 16))
    for r in rows:
        white[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[tuple(math.floor(64 * c) + 1_000_000 for c in some[r.vec_id])])
    # this table has no equal vectors, so the covariance of its result is the identity
    assert np.abs(np.cov(white.T, bias=True) - np.eye(16)).max() < 1e-12
    assert {r.identity_error for r in rows} == {rows[0].identity_error}
