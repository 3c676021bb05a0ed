from paths import SF_SMALL


def test_stream_features_equal_batch(spark):
    from slantspark.plans.queries import REGISTRY
    s = REGISTRY["stream_features"](spark, SF_SMALL)
    b = REGISTRY["all_doc_features"](spark, SF_SMALL)
    assert s.count() == b.count() and s.exceptAll(b.select(*s.columns)).count() == 0


def test_streams_of_a_table_of_several_files(spark, tmp_path):
    """A table laid out as a folder of part files streams whole, a file a batch."""
    from slantspark.plans.queries import REGISTRY
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    s = REGISTRY["stream_features"](spark, str(tmp_path))
    b = REGISTRY["all_doc_features"](spark, SF_SMALL)
    assert s.count() == docs.count() and s.exceptAll(b.select(*s.columns)).count() == 0
