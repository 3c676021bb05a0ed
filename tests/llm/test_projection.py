import math

import numpy as np
import pytest

from slantspark.llm import projection_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, weight string, cell int"


def brute(rows, cosine):
    fit = {i: (np.array(v, float), lab) for i, v, lab in rows
           if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(fit)
    degree, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            (a, la), (b, lb) = fit[i], fit[j]
            if la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                degree[i] += 1
                degree[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (degree.get(i, 0), root(i) if i in parent else i) for i, _, _ in rows if i is not None}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out, n = [], 0
    for label in (0, 1, 2):
        for size in (1, 1, 1, 2, 3, 12, 40):
            base = rng.standard_normal(24)
            for k in range(size):
                noise = rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.1, 0.14, 0.2, 0.25])
                out.append((n * 13 % 997, ((base + noise) * rng.choice([1, 3.0])).astype(np.float32).tolist(), label))
                n += 1
    v = out[0][1]
    return out + [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] + [1.0] * 23, 0), (2003, [None] + [1.0] * 23, 0),
                  (2004, v, None), (2005, v, 0), (2006, v, 0), (2007, v[:12], 0), (2008, [float("inf")] * 24, 0), (2009, [], 0)]


@pytest.mark.parametrize("block", [4096, 7])
def test_links_equal_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(projection_dedup, "BLOCK_ROWS", block)
    table = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA)
    got = projection_dedup.near_duplicate_vectors(table).collect()
    want = brute(rows, 0.98)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(d for d, _ in want.values()) > 500


def test_null_ids_and_empty_table(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0], 0, "", 0), (4, [1.0, 0.0], 0, "", 0), (4, [1.0, 0.0], 0, "", 0)], SCHEMA)
    got = sorted((tuple(r) for r in projection_dedup.near_duplicate_vectors(table).collect()), key=repr)
    assert got == sorted([(None, 0, None, True), (4, 1, 4, True), (4, 1, 4, True)], key=repr)
    assert projection_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_collision_count_recall():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.9801 * a + math.sqrt(1 - 0.9801 ** 2) * side  # pairs just above the threshold
    found = {(i, j) for x, y in projection_dedup.linked_pairs(a, b, 0.98, False) for i, j in zip(x.tolist(), y.tolist())}
    assert {(i, i) for i in range(400)} <= found
    assert projection_dedup.collision_threshold(24) > 15


def test_counts_equal_direct_counting():
    rng = np.random.default_rng(6)
    q, t = rng.standard_normal((30, 5)), rng.standard_normal((70, 5))
    want = (np.abs(q[:, None] - t[None]) <= 0.4).sum(axis=2)
    assert (projection_dedup._counted(q, t, 0.4) == want).all()
