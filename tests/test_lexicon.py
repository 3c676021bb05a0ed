from slantspark.functions import lexicon as L


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert L.STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_word_tag_pairs_unique():
    pairs = L.word_tag_pairs()
    assert len({w for w, _ in pairs}) == len(pairs)
