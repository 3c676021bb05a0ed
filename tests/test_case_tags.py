"""The stand-in tagged table and the counts of neighbouring tags."""
from pyspark.sql import functions as F

from slantspark.operators import sequence_tagger as ST
from slantspark.plans import tagging as TG


def test_case_tags_of_one_file_use_many_tasks(spark, tmp_path):
    rows = [(n, f"The {n} Dogs ran. A cat in NATO slept.", "en", "s", 40) for n in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert TG.case_tags(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1


def test_shapes_follow_the_letters(spark):
    words = ["a", "A", "Ab", "AB", "aB", "ABc", "É", "Éa", "éA", "ÉÀ", "ǅ", "ℂ", "ªA", "1", "_", "", "a1", "A1", "1A", "1Ab", "٣", "\U0001d54f", "ß", "İ"]
    df = spark.createDataFrame([(w,) for w in words], "raw string")
    upper, lower, letter = (F.col("raw").rlike(rf"\p{{{c}}}") for c in ("Lu", "Ll", "L"))
    plain = F.when(~letter, "O").when(~upper, "L").when(F.col("raw").rlike(r"^\p{Lu}\P{Lu}*$"), "T").when(~lower, "U").otherwise("M")
    assert df.where(plain != TG.word_shape(F.col("raw"))).count() == 0


def test_transitions_by_numbers_need_no_sort(spark):
    rows = [(1, 0, "b"), (1, 1, "a"), (1, 1, "b"), (1, 3, "b"), (2, 0, "a")]
    words = spark.createDataFrame(rows, "sent int, pos int, tag string")
    numbers = words.withColumn("tag", F.when(F.col("tag") == "a", 0).otherwise(1))
    counted = ST._neighbours(numbers, ["sent"], "pos", "tag")
    assert "SortAggregate" not in counted._jdf.queryExecution().toString()
    names = {0: "a", 1: "b", None: None}
    assert {(names[r.prev], names[r.cur], r.n) for r in counted.collect()} == {tuple(r) for r in ST._neighbours(words, ["sent"], "pos", "tag").collect()}
    assert {tuple(r) for r in ST.transition_counts(words, ["sent"]).collect()} == {("^", "b", 2), ("b", "a", 1), ("a", "$", 2), ("b", "$", 1), ("^", "a", 1)}
