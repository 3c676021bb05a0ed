"""The forest: both growing steps agree, it learns, and what it sends with a task stays small."""
import numpy as np
from pyspark.sql import functions as F

from slantspark.operators import forest as FO
from slantspark.operators import models as MD


def table(spark, n=600):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 5)).round(2)
    rows = [(*map(float, r), "high" if r[0] + r[1] > 0.5 else "mid" if r[2] > 0 else "low") for r in x]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, label string").repartition(3).localCheckpoint()


def test_big_nodes_split_over_partitions_give_the_same_trees(spark):
    df, names = table(spark), list("abcde")
    one = FO.fit(df, names, trees=4, local_rows=10_000)
    cut = FO.fit(df, names, trees=4, local_rows=150)
    rows = df.select(*names)
    p = [[r[0] for r in f.transform(rows).select("probability").collect()] for f in (one, cut)]
    assert p[0] == p[1] and len(one.packed["feature"]) == len(cut.packed["feature"])


def test_forest_learns_and_keeps_the_settings(spark):
    df, names = table(spark), list("abcde")
    new = table(spark, 900)
    full = FO.fit(df, names, trees=20)
    scored = full.transform(new)
    assert scored.where("label = predicted_label").count() > 0.85 * 900
    assert full.labels == ["high", "low", "mid"] and len(full.roots) == 20
    few = FO.fit(df, names, trees=20, min_rows=100)
    flat = FO.fit(df, names, trees=20, max_depth=0)
    assert len(few.packed["feature"]) < 20 * 13 and len(flat.packed["feature"]) == 20
    odd = spark.createDataFrame([(None, float("nan"), 0.0, 0.0, 0.0)], "a double, b double, c double, d double, e double")
    assert full.transform(odd).first()["predicted_label"] in full.labels


def test_trees_choose_the_best_split_of_the_features_they_try():
    """One node by brute force: Gini over all features tried and all bins."""
    rng = np.random.default_rng(2)
    bins, label, weight = rng.integers(0, 9, (80, 7)).astype(np.uint8), rng.integers(0, 3, 80), rng.integers(1, 3, 80).astype(float)
    key = FO._root_key(5, 0)
    subset = FO._subsets(key, 7)
    feature, split, left = FO.choose(FO._counts(bins, label, weight, np.zeros(80, int), subset, 3), subset, 1)

    def gini(m):
        n = np.bincount(label[m], weight[m], 3)
        return n.sum() - (n * n).sum() / max(n.sum(), 1)

    cost = {(f, s): gini(bins[:, f] <= s) + gini(bins[:, f] > s) for f in subset[0] for s in range(8) if 0 < (bins[:, f] <= s).sum() < 80}
    assert abs(cost[feature[0], split[0]] - min(cost.values())) < 1e-9
    assert left[0].tolist() == np.bincount(label[bins[:, feature[0]] <= split[0]], weight[bins[:, feature[0]] <= split[0]], 3).tolist()


def test_the_forest_of_the_detector_is_a_few_bytes_a_node(spark, tmp_path):
    """Spark ML's forest went with each task as objects, and its fit sent all nodes' statistics from each partition."""
    from slantspark.operators import features as FE
    df = table(spark).select("label", *[F.col("abcde"[k % 5]).alias(c) for k, c in enumerate(FE.FEATURE_COLUMNS)])
    model = MD.fit_all(df, ("RandomForest",))["RandomForest"]
    nodes = len(model.packed["feature"])
    assert len(model.roots) == 100 and sum(map(len, model.packed.values())) < 6 * nodes + 100 * 200 * 8
    again = MD.open_model(MD.save_model(model, str(tmp_path / "f")))
    assert again == model
