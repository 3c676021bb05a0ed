"""Token values counted a batch at a time against the column expressions, on odd input, and that costly steps run once a row."""
import random

from pyspark.sql import functions as F

from slantspark.operators import annotate as K
from slantspark.operators import chunk_grammar as CG
from slantspark.operators import features as FE
from slantspark.operators import token_stats as TS


def test_equal_to_the_column_expressions(spark, monkeypatch):
    monkeypatch.setattr(TS, "SLICE_TOKENS", 50)
    rng = random.Random(4)
    words = ["the", "big", "dog", "his", "it", "and", "runs", "quickly", "running", "ly", "a", "_", "__", "_x", "12", "3.5", "2nd", "٣", "½", "€", "$", "%",
             ".", ",", "-", "?", "…", "naïve", "über", "東", "𝒳", "😀", "washington", "mr", "who", "n't", "not", "beautiful", "ing", "sing"]
    texts = [(n, [rng.choice(words) for _ in range(rng.randint(0, 60))]) for n in range(60)] + [(60, None), (61, []), (62, ["a big"] * 3), (63, ["dog"] * 500)]
    df = spark.createDataFrame(texts, "k int, _tok array<string>").repartition(3).select("k", "_tok", K.token_codes(F.col("_tok")).alias("_code"))
    got = df.select("k", TS.token_stats(F.col("_tok")).alias("s")).select("k", "s.*")
    want = df.select("k", *[c.cast("int").alias(n) for n, c in FE.token_values(F.col("_tok"), F.col("_code")).items()]).select("k", *TS.FIELDS)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(got.where("k <> 60")) == rows(want.where("k <> 60"))
    assert got.where("k = 60 AND tokens IS NULL AND chunks IS NULL").count() == 1


def test_tokens_are_not_judged_one_by_one_and_folds_run_once(spark):
    df = spark.createDataFrame([(1, "The dog runs.")], "k int, article_text string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    plain = plan(FE.extract_features(df, keep=["k"]))
    assert "transform(" not in plain and "aggregate(" not in plain and "Exchange" not in plain
    assert plan(FE.extract_features(df, keep=["k"], chunks=CG.NOUN_PHRASES)).count("aggregate(") == 1
