"""What a Python worker keeps between stages."""
from slantspark.llm.common import map_arrow, per_worker


def test_a_cache_of_an_earlier_stage_goes_once_a_stage_does_not_ask_for_it(spark):
    rows = spark.range(0, 40, 1, 1)

    def using(batch):
        per_worker(("test",), lambda: [1])
        yield {"n": batch.column(0)}

    def other(batch):
        import pyspark
        yield {"n": [len(pyspark.__dict__.get("_slantspark_per_worker", {}))] * batch.num_rows}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        map_arrow(rows, using, "n long").count()
        map_arrow(rows, using, "n long").collect()
        left = [r.n for r in map_arrow(rows, other, "n long").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert left[-30:] == [0] * 30
