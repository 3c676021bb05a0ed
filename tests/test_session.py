"""Lineage cuts and scratch output live under the session's checkpoint folder."""
from slantspark.session import cut_lineage, ensure_checkpoint_dir, scratch_path


def test_cut_lineage_uses_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    assert base == spark.sparkContext.getCheckpointDir()
    df = cut_lineage(spark.range(10).withColumnRenamed("id", "x"), "unit")
    files = df.inputFiles()
    assert files and all(base.replace("file:", "") in f for f in files)
    assert df.count() == 10
    assert scratch_path(spark, "x").startswith(base.rstrip("/") + "/scratch/x-")


def test_existing_checkpoint_dir_is_kept(spark):
    before = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == before


def test_unset_folder_raises_off_a_local_master():
    from types import SimpleNamespace

    import pytest

    from slantspark import session
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


def test_drop_scratch(spark):
    import os

    from slantspark.session import drop_scratch
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    drop_scratch(spark, path)
    assert not os.path.exists(path.replace("file:", ""))
