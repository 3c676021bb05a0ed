"""Splits, exact KNN, metrics, models, label codes."""
import numpy as np
from pyspark.sql import functions as F

from slantspark.operators import knn as KN
from slantspark.operators import metrics as A
from slantspark.operators import quality as Q
from slantspark.operators import split as SP
from slantspark.operators import textclf as TC

from paths import SF_SMALL


def test_valid_ids(spark):
    df = spark.createDataFrame([("007",), ("x2",), ("1.5",), (None,), ("12",), ("1e3",)], "article_id string")
    assert [r[0] for r in Q.cast_id(df).orderBy("article_id").collect()] == [7, 12]
    c = Q.valid_id_counts(df).collect()[0]
    assert (c.valid_ids, c.invalid_ids, c.total_rows) == (2, 4, 6)


def test_split_stable_under_repartitioning(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "article_id")
    a = {r[0] for r in SP.train_test_split(df.repartition(1), "article_id")[1].collect()}
    b = {r[0] for r in SP.train_test_split(df.repartition(16), "article_id")[1].collect()}
    train = {r[0] for r in SP.train_test_split(df, "article_id")[0].collect()}
    assert a == b and not (a & train) and len(a | train) == 2000
    assert 300 < len(a) < 500


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    tr = [(i, f"c{rng.integers(0, 3)}", *map(float, rng.integers(0, 4, 3))) for i in range(300)]
    te = [(1000 + i, "c0", *map(float, rng.integers(0, 4, 3))) for i in range(50)]
    schema = "id long, label string, a double, b double, c double"
    train, test = spark.createDataFrame(tr, schema), spark.createDataFrame(te, schema)
    rows = KN.knn_predict(train, test, ["a", "b", "c"], "id", "label", 5, block_rows=70).collect()
    assert len(rows) == len(te)
    got = {r["id"]: r["prediction"] for r in rows}
    X = np.array([t[2:] for t in tr]); ids = np.array([t[0] for t in tr]); labels = [t[1] for t in tr]
    for row in te:
        d = ((X - np.array(row[2:])) ** 2).sum(axis=1)
        order = sorted(range(len(tr)), key=lambda j: (d[j], ids[j]))[:5]
        votes = {}
        for j in order:
            votes[labels[j]] = votes.get(labels[j], 0) + 1
        best = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        assert got[row[0]] == best


def _clustered(n, seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 12, n) * 1000.0
    return [(i, f"c{int(c) % 3}", *(c + rng.standard_normal(3)).tolist()) for i, c in enumerate(centre)]


def test_knn_prunes_block_pairs_exactly(spark):
    schema = "id long, label string, a double, b double, c double"
    tr, te = _clustered(1200, 1), _clustered(200, 2)
    train, test = spark.createDataFrame(tr, schema), spark.createDataFrame(te, schema)
    search = KN.Neighbours(train, test, ["a", "b", "c"], "id", "label", 5, block_rows=100, group_rows=20)
    groups = search.test.select("tblk", "tpart").distinct().count()
    met = search.others(search._best(search.own())).select("tblk", "tpart", "rblk").distinct().count() + groups
    assert search.blocks >= 8 and met < groups * search.blocks / 2
    got = {r["id"]: sorted(r["votes"]) for r in search.labels().collect()}
    x = np.array([t[2:] for t in tr])
    for row in te:
        d = ((x - np.array(row[2:])) ** 2).sum(axis=1)
        assert got[row[0]] == sorted(tr[j][1] for j in sorted(range(len(tr)), key=lambda j: (d[j], tr[j][0]))[:5])


def test_knn_equal_norms_and_empty_sides(spark):
    schema = "id long, label string, a double"
    same = spark.createDataFrame([(i, "x" if i % 2 else "y", 1.0) for i in range(90)], schema)
    test = spark.createDataFrame([(1000, "x", 1.0), (1001, "y", 5.0)], schema)
    got = {r["id"]: r["prediction"] for r in KN.knn_predict(same, test, ["a"], "id", "label", 5, block_rows=10, group_rows=1).collect()}
    assert got == {1000: "y", 1001: "y"}  # ids 0-4
    none = same.limit(0)
    assert {r["id"]: r["prediction"] for r in KN.knn_predict(none, test, ["a"], "id", "label").collect()} == {1000: None, 1001: None}
    assert KN.knn_predict(same, none, ["a"], "id", "label").count() == 0
    few = {r["id"]: r["prediction"] for r in KN.knn_predict(same.where("id < 2"), test, ["a"], "id", "label").collect()}
    assert few == {1000: "x", 1001: "x"}


def test_delimited_files_keep_every_text(spark, tmp_path):
    from slantspark.sources import delimited as D
    texts = ["  lead and trail  ", " ", "", "x\n", "\r", "\\N", "\\", "\\n", "a\\\nb", "\\\\N", 'q"q', '"', "a,b", "a\tb", "\n\n", "é ß", "#c", "null", None,
             "\u0085x\u2028", "x" * 100_000]
    rows = [(str(i), t, " ", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, D.ARTICLES_RAW_SCHEMA)
    for name, write, read in (("c", D.write_csv, D.read_csv), ("t", D.write_tsv, D.read_tsv)):
        path = write(df.coalesce(1), str(tmp_path / name))
        assert sorted(map(tuple, read(spark, path, D.ARTICLES_RAW_SCHEMA).collect()), key=repr) == sorted(rows, key=repr)


def test_delimited_scan_splits_one_file(spark, tmp_path):
    from slantspark.sources import delimited as D
    df = spark.range(20_000).selectExpr("cast(id as string) article_id", "'t' title", "'' published_at", "concat('line\\n', id, repeat('x', 50)) article_text")
    path = D.write_csv(df.coalesce(1), str(tmp_path / "big"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        back = D.read_csv(spark, path, D.ARTICLES_RAW_SCHEMA)
        assert back.rdd.getNumPartitions() > 4 and back.exceptAll(df).count() == 0 and back.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_foreign_delimited_files(spark, tmp_path):
    from slantspark.sources import delimited as D
    (tmp_path / "f.csv").write_text('article_id,title,published_at,article_text\n1,t,,"two\nlines \\n"\n2," ",x,plain\n')
    got = D.read_csv(spark, str(tmp_path / "f.csv"), D.ARTICLES_RAW_SCHEMA, own=False).orderBy("article_id").collect()
    assert got[0].article_text == "two\nlines \\n" and got[1].title == " "


def test_fit_rows_bound(spark):
    from slantspark.operators import models as MD
    df = spark.range(10_000).withColumnRenamed("id", "article_id")
    assert MD.bounded(df, None).count() == 10_000 and 800 < MD.bounded(df, 1000).count() < 1200


def test_metrics_hand_computed(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] + [("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    assert sum(r["n"] for r in A.confusion_long(df).collect()) == len(rows)
    rep = {r["class"]: r for r in A.classification_report(df).collect()}
    assert rep["a"]["precision"] == round(3 / 5, 6) and rep["a"]["recall"] == 0.75
    assert rep["c"]["precision"] == 0.0 and rep["c"]["f1_score"] == 0.0 and rep["c"]["support"] == 1
    assert A.accuracy(df).collect()[0][0] == 5 / 8


def test_label_codes(spark):
    df = spark.createDataFrame([("least",), ("right",), ("left",), ("left-center",), ("",), (None,)], "b string")
    codes = [r[0] for r in df.select(TC.encode_label(F.col("b"), 3)).collect()]
    assert codes == [0, 1, 2, 0, 0, 0]
    five = [r[0] for r in df.select(TC.encode_label(F.col("b"), 5)).collect()]
    assert five == [0, 1, 2, 4, 0, 0]
    names = [r[0] for r in spark.range(6).select(TC.decode_label(F.col("id"), 3)).collect()]
    assert names == ["least", "right", "left", "Invalid predicted label", "Invalid predicted label",
                     "Invalid predicted label"]


def test_vocab_encode_shapes(spark):
    df = spark.createDataFrame([(1, "a b c a".split()), (2, []), (3, ["w"] * 600)], "k long, words array<string>")
    vocab = TC.vocabulary(df)
    v = {r["token"]: r["id"] for r in vocab.collect()}
    assert v == {"w": 4, "a": 5, "b": 6, "c": 7}
    enc = {r["k"]: r for r in TC.vocab_encode(df, "k", vocab.where("id < 6"), max_len=8).collect()}
    assert enc[1]["input_ids"] == [2, 5, 1, 1, 5, 3, 0, 0] and enc[1]["attention_mask"] == [1] * 6 + [0] * 2
    assert enc[2]["input_ids"] == [2, 3, 0, 0, 0, 0, 0, 0]
    assert enc[3]["input_ids"] == [2, 4, 4, 4, 4, 4, 4, 3]


def test_vocabulary_ranks_over_many_partitions(spark):
    df = spark.createDataFrame([([f"w{k}"] * (k % 7 + 1),) for k in range(500)], "words array<string>").repartition(13)
    got = [(r.token, r.id) for r in TC.vocabulary(df).collect()]
    want = sorted((-(k % 7 + 1), f"w{k}") for k in range(500))
    assert dict(got) == {w: n + 4 for n, (_, w) in enumerate(want)}


def test_forest_probabilities_and_roundtrip(spark, tmp_path):
    from slantspark.operators import models as MD
    from slantspark.plans import dataset as DS
    ft = DS.features(spark, SF_SMALL).where("label <> ''").cache()
    model = MD.fit_all(ft, ("RandomForest",))["RandomForest"]
    assert MD.class_order(model) == sorted(MD.class_order(model))
    scored = MD.predict(model, ft)
    from pyspark.ml.functions import vector_to_array
    sums = scored.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert all(abs(r.s - 1.0) < 1e-9 for r in sums.collect())
    n_classes = len(MD.class_order(model))
    assert {len(r[0]) for r in scored.select(vector_to_array("probability")).collect()} == {n_classes}
    path = MD.save_model(model, str(tmp_path / "rf"))
    again = MD.predict(MD.open_model(path), ft).select("article_id", F.col("predicted_label").alias("p2"))
    joined = scored.select("article_id", "predicted_label").join(again, "article_id")
    assert joined.where("predicted_label <> p2").count() == 0
    assert MD.open_model(str(tmp_path / "missing")) is None
    # train accuracy at least the majority class share
    acc = A.accuracy(scored.select("label", F.col("predicted_label").alias("prediction"))).collect()[0][0]
    majority = ft.groupBy("label").count().agg(F.max("count")).collect()[0][0] / ft.count()
    assert acc >= majority


def test_summary_matches_parts(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] + [("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    s = A.summary(df).collect()[0]
    w = A.weighted_prf(df).collect()[0]
    assert s.accuracy == round(5 / 8, 6)
    assert (s.precision, s.recall, s.f1_score) == (w.precision, w.recall, w.f1_score)


def test_k_smallest_ties_exact():
    rng = np.random.default_rng(3)
    for _ in range(50):
        d = rng.integers(0, 4, size=(7, 30)).astype(float)        # many ties
        k = int(rng.integers(1, 8))
        r, c = KN._k_smallest(d, k)
        for i in range(d.shape[0]):
            want = sorted(range(d.shape[1]), key=lambda j: (d[i, j], j))[:k]
            assert list(c[r == i]) == want


def test_log_loss_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from slantspark.plans import dataset as DS
    data = TC.prepare(DS.relabelled(spark, SF_SMALL)).select("article_id", "words", "labels")
    train, evl = SP.train_eval_split(data, "article_id")
    model = TC.train(train, max_iter=5)
    scored = model.transform(evl.withColumn("labels", F.col("labels").cast("double")))
    want = MulticlassClassificationEvaluator(labelCol="labels", metricName="logLoss").evaluate(scored)
    got = A.log_loss(scored, "labels", "probability").collect()[0][0]
    assert abs(got - want) < 1e-9
    acc = MulticlassClassificationEvaluator(labelCol="labels", metricName="accuracy").evaluate(scored)
    assert abs(TC.evaluate(model, evl).collect()[0]["accuracy"] - round(acc, 6)) < 1e-9
