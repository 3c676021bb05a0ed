"""The approximate neighbours: equal to the exact mode with all buckets, measured recall with few, odd tables."""
import numpy as np
import pytest

from slantspark.operators import knn as KN
from slantspark.operators import knn_approx as KA

SCHEMA = "id long, label string, a double, b double, c double, d double"
FEATURES = ["a", "b", "c", "d"]


def points(seed, n, start=0):
    """Clusters of very different density, as counts of words and signs have."""
    rng = np.random.default_rng(seed)
    scale = 10.0 ** rng.integers(0, 4, n)
    x = rng.standard_normal((n, 4)) * scale[:, None] + rng.integers(0, 5, (n, 1)) * 50
    return [(start + i, "xyz"[int(abs(v[0])) % 3], *map(float, np.round(v, 1))) for i, v in enumerate(x)]


def neighbours(candidates):
    out = {}
    for r in candidates.collect():
        out.setdefault(r["row"], []).append((r["dist"], r["train_id"]))
    return {row: sorted(v) for row, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(points(1, 3000), SCHEMA).repartition(3), spark.createDataFrame(points(2, 300, 10_000), SCHEMA).repartition(2)


def test_all_buckets_equal_the_exact_mode(spark, tables):
    train, test = tables
    search = KA.ApproximateNeighbours(train, test, FEATURES, "id", "label", 5, trees=2, visits=1000, bucket_rows=200, group_rows=64)
    exact = {r["id"]: r["votes"] for r in KN.Neighbours(train, test, FEATURES, "id", "label", 5).labels().collect()}
    assert search.buckets > 10 and {r["id"]: r["votes"] for r in search.labels().collect()} == exact


def test_recall_against_the_exact_mode(spark, tables):
    train, test = tables
    search = KA.ApproximateNeighbours(train, test, FEATURES, "id", "label", 5, bucket_rows=100)
    ids = {r["row"]: r["id"] for r in search.test.select("row", "id").collect()}
    exact = KN.Neighbours(train, test, FEATURES, "id", "label", 5)
    exact_ids = {r["row"]: r["id"] for r in exact.test.select("row", "id").collect()}
    truth = {exact_ids[row]: {i for _, i in found} for row, found in neighbours(exact.candidates()).items()}
    got = {ids[row]: {i for _, i in found} for row, found in neighbours(search.candidates()).items()}
    assert set(got) == set(truth) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(truth[i] & got[i]) / 5 for i in truth]) >= 0.95
    assert search.recall >= 0.97 and search.visits < search.buckets / 2


def test_ties_copies_nulls_and_empty_tables(spark):
    rows = [(i, "x" if i % 2 else "y", 1.0, 1.0, 1.0, 1.0) for i in range(500)] + [(900, "z", 2.0, 0.0, 0.0, 0.0), (901, None, 2.0, 0.0, 0.0, 0.0)]
    train = spark.createDataFrame(rows, SCHEMA)
    test = spark.createDataFrame([(1, "x", 1.0, 1.0, 1.0, 1.0), (1, "x", 1.0, 1.0, 1.0, 1.0), (None, None, 2.0, 0.0, 0.0, 0.0)], SCHEMA)
    search = KA.ApproximateNeighbours(train, test, FEATURES, "id", "label", 5, bucket_rows=20, visits=50)
    found = neighbours(search.candidates())
    assert sorted(map(tuple, found.values()))[0] == tuple((0.0, i) for i in range(5)) and len(found) == 3
    assert KA.knn_predict_approx(train.limit(0), test, FEATURES, "id", "label").where("prediction IS NULL").count() == 3
    assert KA.knn_predict_approx(train, test.limit(0), FEATURES, "id", "label").count() == 0
