"""Tree search against brute force: exact when all leaves are visited, measured recall else."""
import numpy as np
import pytest

from slantspark.llm import kmeans_tree as K

SCHEMA = "vec_id long, embedding array<double>, label int"
QUERY = "vec_id % 20 = 0"


def brute(rows, k, every=20):
    """{query row: [(score, id)]} over (id, vector) rows that take part."""
    out = []
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            near = sorted((-float(np.dot(v, w)), i) for m, (i, w) in enumerate(rows) if m != n)[:k]
            out.append((q, [(-s, i) for s, i in near]))
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
    for rows in out.values():
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return out


def same(found, rows, k):
    got, want = answers(found), dict(brute(rows, k))
    assert set(got) == {q for q, near in want.items() if near}
    for q, line in got.items():
        assert [r["vec_id"] for r in line] == [i for _, i in want[q]], q
        assert [r["score"] for r in line] == pytest.approx([s for s, _ in want[q]], rel=1e-12, abs=1e-12)


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16)) * 3
    return [(i, (centres[i % 30] + rng.standard_normal(16)).tolist()) for i in range(1500)]


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("bin_rows, bin_queries", [(8192, 4096), (40, 7)])
def test_all_leaves_equal_brute_force(spark, clouds, bin_rows, bin_queries):
    same(K.nearest(table_of(spark, clouds), QUERY, recall=1.01, leaf_sample=32, bin_rows=bin_rows, bin_queries=bin_queries), clouds, 20)


def test_recall_is_reached_with_part_of_the_leaves(spark, clouds):
    got = answers(K.nearest(table_of(spark, clouds), QUERY, recall=0.95, leaf_sample=16))
    hits = [i in [r["vec_id"] for r in got[q]] for q, near in brute(clouds, 20) for _, i in near]
    assert np.mean(hits) >= 0.9
    first = got[0][0]
    assert first["calibrated_recall"] >= 0.95
    sample = np.array([v for _, v in clouds])
    assert first["leaves_visited"] < K.fit_tree(sample, leaf_rows=16).leaves / 2


def test_ties_and_copies(spark):
    """Whole-number vectors tie often; copies of one vector make up a third of the rows, queries among them."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 2.0] if i % 3 == 0 else [float(x) or 1.0 for x in rng.integers(-2, 3, 3)]) for i in range(240)]
    same(K.nearest(table_of(spark, rows), QUERY, k=5, recall=1.01, leaf_sample=8, bin_rows=16, bin_queries=4), rows, 5)


def test_rows_that_take_no_part_repeats_and_extra_columns(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.9, 0.1]), (4, [-1.0, 0.0]), (5, [0.9, 0.1])]
    bad = [(40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    schema = "vec_id long, embedding array<double>, score int, rank int, h1 int, leaf int"
    everything = [(i, v, 1, 2, 3, 4) for i, v in rows + bad + rows]            # each row twice: a repeated row counts once
    same(K.nearest(spark.createDataFrame(everything, schema), QUERY, k=20), rows, 20)


def test_rows_that_share_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0])]
    found = sorted((r["rank"], r["vec_id"], r["score"]) for r in K.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), QUERY).collect())
    assert found == [(1, 1, 1.0), (1, 1, 1.0), (2, 20, 0.0), (2, 20, 0.0)]     # each row is the other's candidate


def test_few_rows_no_query_and_empty(spark):
    assert K.nearest(spark.createDataFrame([(20, [1.0], 0)], SCHEMA), QUERY).count() == 0
    assert K.nearest(spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], SCHEMA), QUERY).count() == 0
    empty = K.nearest(spark.createDataFrame([], SCHEMA), QUERY)
    assert empty.count() == 0 and empty.columns[:4] == ["query_id", "rank", "vec_id", "score"]


def test_walk_visits_best_bins_first():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 6))
    tree = K.fit_tree(x, leaf_rows=20)
    place = tree.place(x)
    assert set(place) <= set(range(tree.leaves)) and np.bincount(place).max() <= 60
    full = tree.visits(x[:5], tree.leaves)
    assert all(sorted(v) == list(range(tree.leaves)) for v in full)
    assert [v[:3] for v in full] == tree.visits(x[:5], 3)
