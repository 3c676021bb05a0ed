"""Queries on texts use all tasks when a table is one file with one row group."""
import pytest
from pyspark.sql import functions as F

from slantspark.plans import dataset as DS
from slantspark.session import spread


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("one-file"))
    rows = [(n if n % 9 else None, f"The {n} Dogs ran. A cat in NATO slept, it said 'no'?", "en", "s", 40) for n in range(64)]
    rows += [(3, "A second text of one id!", "en", "s", 24), (5, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(n, n % 2, 0) for n in range(0, 64, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def _parts(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_features_of_one_file_use_many_tasks(spark, one_file, monkeypatch):
    judged, extract = [], DS.FE.extract_features
    monkeypatch.setattr(DS.FE, "extract_features", lambda df, *a, **k: judged.append(df) or extract(df, *a, **k))
    table = DS.features(spark, one_file)
    assert _parts(judged[0]) > 1
    got = sorted(map(tuple, table.collect()))
    want = [n for n in range(0, 64, 2) if n % 9] + [3] * 4
    assert sorted(r[1] for r in got) == sorted(want)
    monkeypatch.setattr(DS, "BROADCAST_IDS", -1)               # the labels join alone gives the same rows
    assert sorted(map(tuple, DS.features(spark, one_file).collect())) == got


def test_many_files_stay_where_they_are(spark, tmp_path):
    spark.range(100).repartition(20).write.parquet(str(tmp_path / "many"))
    assert "REPARTITION" not in spread(spark.read.parquet(str(tmp_path / "many")))._jdf.queryExecution().toString()
