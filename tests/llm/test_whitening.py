"""Whitening against plain arithmetic: exact rationals for the moments, numpy for the components."""
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from slantspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """n, S, covariance as fractions, computed from centred products (no polarisation)."""
    x = [[floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[sum(Fraction(n * r[i] - s[i], n) * Fraction(n * r[j] - s[j], n) for r in x) / n for j in range(d)] for i in range(d)]
    return x, n, s, cov


def check(spark, vectors, components=8):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), components=components).collect()
    x, n, s, cov = plain(vectors)
    v = np.array([[float(c) for c in line] for line in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(components, len(s))
    assert len(found) == n * k
    by = {(r["vec_id"], r["component"]): r for r in found}
    w = np.empty((n, k))
    for i in range(n):
        dev = sum((n * a - b) ** 2 for a, b in zip(x[i], s))
        for c in range(k):
            r = by[i, c + 1]
            assert r["n"] == n and r["deviation"] == dev and int(r["deviation_exact"]) == dev
            assert r["explained"] == pytest.approx(values[c] / np.trace(v), rel=1e-9)
            w[i, c] = r["whitened"]
    assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-8
    assert found[0]["identity_error"] < 1e-8
    # projecting back: V u = e u for the direction that the whitened values define
    z = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    u = (w.T @ z / n) / np.sqrt(values[:k])[:, None]
    assert np.abs(u @ u.T - np.eye(k)).max() < 1e-7
    assert np.abs(v @ u.T - u.T * values[:k]).max() < 1e-6 * values[0]


def test_equals_plain_covariance(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.standard_normal((60, 5)) @ rng.standard_normal((5, 5)))
    check(spark, rng.standard_normal((40, 12)) * np.arange(1, 13), components=8)


def test_moments_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = np.float32(rng.standard_normal((50, 4)) * [1, 10, 1e6, 1e12])   # squares beyond 64 bits
    rows = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)], SCHEMA)
    m = W.moments(W.integer_vectors(rows))
    _, n, s, cov = plain(vectors)
    assert (m.n, m.sums) == (n, s)
    assert np.array_equal(m.covariance, [[float(c) for c in line] for line in cov])   # rounded once, so equal to the last bit


def test_pair_sums_on_both_ways():
    y = np.array([[3, -4, 5], [1, 2, -7]], np.int64)
    for scale in (1, 10 ** 12):
        got = W.pair_square_sums(y * scale)
        for i in range(3):
            want = [sum(int(r[i]) ** 2 for r in y.tolist())] + [sum((r[i] + r[j]) ** 2 for r in y.tolist()) for j in range(i + 1, 3)]
            assert [int(v) for v in got[i]] == [v * scale ** 2 for v in want]


def test_dropped_rows_repeats_and_extra_columns(spark):
    good = [[0.5, 0.25, 1.0], [0.1, -0.2, 0.3], [0.1, -0.2, 0.3], [-1.0, 0.7, 0.2], [0.0, 0.0, 0.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1.0, 2.0]]
    rows = [(i if i != 3 else None, v, 9, 8, 7) for i, v in enumerate(good)] + [(100 + i, v, 9, 8, 7) for i, v in enumerate(bad)]
    found = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, n int, component int")).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found if r["component"] == 1) == [(False, 0), (False, 1), (False, 2), (False, 4), (True, 0)]
    assert {r["n"] for r in found} == {5} and len(found) == 15
    one, two = ([r["whitened"] for r in sorted(found, key=lambda r: r["component"]) if r["vec_id"] == i] for i in (1, 2))
    assert one == pytest.approx(two, rel=1e-12)


def test_directions_without_variance_and_empty(spark):
    flat = [(i, [float(i), float(2 * i), 5.0], 0) for i in range(6)]
    found = W.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in found)
    assert found[0]["identity_error"] < 1e-9
    same = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    empty = W.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert W.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e12], 0), (2, [-1e12], 0), (3, [0.0], 0)]
    found = {r["vec_id"]: r for r in W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found[1]["deviation"] is None and int(found[1]["deviation_exact"]) == (3 * 1024 * 10 ** 12) ** 2
    assert found[3]["deviation"] == 0
