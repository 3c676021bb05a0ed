"""Lifecycles B and C end to end on sf0.001, and the CLI build on hand-written XML."""
from pyspark.sql import functions as F

from paths import SF_SMALL


def test_detector_train_test_predict_save(spark, tmp_path):
    from slantspark.plans import dataset as DS
    from slantspark.plans.detector import Detector
    det = Detector().train(DS.features(spark, SF_SMALL))
    summary, reports = det.test()
    assert {r["model"] for r in summary.collect()} == {"RandomForest", "DecisionTree", "KNN"}
    assert {r["model"] for r in reports.where("class = 'macro avg'").collect()} == {"RandomForest", "DecisionTree", "KNN"}
    texts = spark.createDataFrame([("The senate passed the bill on Tuesday.",)], "article_text string")
    res = det.predict(texts).collect()[0]["result"]
    label, *probs = res.split(",")
    assert label in {"least", "left", "right"} and abs(sum(map(float, probs)) - 1) < 1e-9
    path = det.save(str(tmp_path / "det"))
    again = Detector.open(spark, path)
    assert again.predict(texts).collect()[0]["result"] == res


def test_text_classifier(spark, tmp_path):
    from slantspark.plans import dataset as DS
    from slantspark.plans.text_classifier import TextClassifier
    clf = TextClassifier().train(DS.relabelled(spark, SF_SMALL), max_iter=5)
    metrics, confusion, report = clf.evaluate()
    m = metrics.collect()[0]
    assert 0 <= m["accuracy"] <= 1 and m["log_loss"] >= 0
    assert sum(r["n"] for r in confusion.collect()) == clf.eval_table.count()
    texts = spark.createDataFrame([("some words here",)], "text string")
    assert clf.predict(texts).collect()[0]["predicted_label"] in {"least", "left", "right"}


def test_cli_build(spark, tmp_path):
    import slantspark.__main__ as cli
    from test_xml import ARTICLES, TRUTH, _write
    out = str(tmp_path / "out")
    arts = _write(ARTICLES.replace('id="x2"', 'id="3"'))
    truth = _write(TRUTH)
    cli.main(["build", "--articles", arts, "--truth", truth, "--out", out])   # reuses the active session
    ft = spark.read.parquet(f"{out}/features")
    assert sorted(r["article_id"] for r in ft.collect()) == [1, 2, 3]
    assert ft.where(F.col("article_id") == 3).collect()[0]["label"] == ""


def test_cli_from_xml_to_a_prediction_through_csv(spark, tmp_path, capsys):
    import slantspark.__main__ as cli
    from test_xml import _write
    bias = ["left", "right", "least", "left-center", "right-center"]
    arts = "<articles>" + "".join(f'<article id="{k}" title="t"><p>Some words {bias[k % 5]} number {k}.</p></article>' for k in range(1, 81))
    truth = "<articles>" + "".join(f'<article id="{k}" hyperpartisan="true" bias="{bias[k % 5]}"/>' for k in range(1, 81))
    arts, truth = arts + '<article id="x9"><p>bad id</p></article><article id="81">a & b</article></articles>', truth + "</articles>"
    out = str(tmp_path / "out")
    cli.main(["build", "--articles", _write(arts), "--truth", _write(truth), "--out", out, "--format", "csv", "--xml-errors", "quarantine"])
    assert [(r.side, r.article_id, r.n) for r in spark.read.parquet(f"{out}/rejected_ids").collect()] == [("articles", "x9", 1)]
    assert spark.read.parquet(f"{out}/rejected_xml").count() == 1
    profile = {(r.check, r.value): r.n for r in spark.read.parquet(f"{out}/profile").collect()}
    assert profile["article ids", "invalid_ids"] == 1 and profile["merged labels", "left-center"] == 16
    cli.main(["train", "--features", f"{out}/features", "--models", f"{out}/models", "--format", "csv", "--fit-rows", "60"])
    cli.main(["predict", "--models", f"{out}/models", "--text", "Some words left number 3."])
    assert any(line.strip("|+- ").split(",")[0] in ("least", "left", "right") for line in capsys.readouterr().out.splitlines()[-6:])
    cli.main(["textclf", "--merged", f"{out}/merged_raw", "--model", f"{out}/tc", "--labels", "5", "--format", "csv", "--strict", "--text", "words least"])
    assert "labels" not in spark.read.parquet(f"{out}/rejected_ids").columns


def test_strict_modes_raise(spark, tmp_path):
    import pytest

    from slantspark.plans.text_classifier import TextClassifier
    merged = spark.createDataFrame([(1, "a b", "left"), (2, "c", "sideways")], "article_id long, article_text string, bias string")
    with pytest.raises(Exception, match="unknown label"):
        TextClassifier().train(merged, strict=True)
    import slantspark.__main__ as cli
    from test_xml import ARTICLES, TRUTH, _write
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cli.main(["build", "--articles", _write(ARTICLES), "--truth", _write(TRUTH), "--out", str(tmp_path), "--ids", "failfast"])


# An invented article with the traits of the reference's sample input: HTML
# entities left in the text, mojibake quotes, paragraphs glued without a space,
# and a link.
SAMPLE_ARTICLE = ("*Update added.Only last spring, the river towns were busy and hopeful that the boom would "
                  "hold.Not anymore.&#160;With grain prices sliding, the co-ops have cut 1,200 jobs.See "
                  "http://example.org/report?id=7 for details.â€œWe are still growing,â€\u009d said a "
                  "spokesman for the Treasurer.&#160;&#160;")


def test_sample_article_predictions(spark):
    from slantspark.functions import text as TX
    from slantspark.plans import dataset as DS
    from slantspark.plans.detector import Detector
    from slantspark.plans.text_classifier import TextClassifier
    from test_text import t6_py, t13_py
    row = spark.createDataFrame([(SAMPLE_ARTICLE,)], "article_text string").select(
        TX.preprocess_features("article_text").alias("a"), TX.preprocess_text_classifier("article_text").alias("b")
    ).collect()[0]
    assert row.a == t6_py(SAMPLE_ARTICLE) and row.b == t13_py(SAMPLE_ARTICLE)
    assert "http" not in row.a and "&#160;" in row.a          # entities are not decoded, links are removed
    texts = spark.createDataFrame([(SAMPLE_ARTICLE,)], "article_text string")
    res = Detector().train(DS.features(spark, SF_SMALL)).predict(texts).collect()[0]["result"]
    label, *probs = res.split(",")
    assert label in {"least", "left", "right"} and len(probs) == 3
    clf = TextClassifier().train(DS.relabelled(spark, SF_SMALL), max_iter=5)
    name = clf.predict(texts.withColumnRenamed("article_text", "text")).collect()[0]["predicted_label"]
    assert name in {"least", "left", "right"}
