"""Feature path on hand-made rows."""
from pyspark.sql import functions as F

from slantspark.operators import annotate as K
from slantspark.operators import features as FE


def _features(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, article_text string")
    return {r["doc_id"]: r.asDict() for r in FE.extract_features(df, keep=["doc_id"]).collect()}


def test_empty_text_gives_zeros(spark):
    row = _features(spark, [""])[0]
    for c in FE.FEATURE_COLUMNS:
        assert row[c] == 0, c


def test_counts_on_known_sentence(spark):
    text = "The quick brown fox jumped over the lazy dog. He said: 'it is 340,000 dollars!' Why?"
    r = _features(spark, [text])[0]
    toks = ["the", "quick", "brown", "fox", "jumped", "over", "the", "lazy", "dog", ".", "he", "said", ":", "'",
            "it", "is", "340,000", "dollars", "!", "'", "why", "?"]
    assert r["word_count"] == len(toks)
    assert r["unique_words_count"] == len(set(toks))
    assert r["avg_word_length"] == sum(map(len, toks)) / len(toks)
    assert r["bigram_length"] == len(toks) - 1 and r["trigram_length"] == len(toks) - 2
    assert r["quotes_count"] == 2 and r["question_mark_count"] == 1 and r["exclamation_count"] == 1
    assert r["punctuation_count"] == 6           # . : ' ! ' ?
    assert r["digits_count"] == 0 == r["numeric_count"]   # "340,000" is not all digits
    assert r["sentence_count"] == 2                       # "!'" is not followed by a space
    assert r["conjunctions_count"] == 0
    assert r["entities_count"] == 1                        # "340,000 dollars"
    assert r["avg_entity_length"] == len("340,000 dollars")
    assert r["stop_words_count"] == sum(t in {"the", "over", "he", "it", "is", "why"} for t in toks)


def test_noun_chunk_fold_matches_window_version(spark):
    texts = ["the big dog and the small cat sat on a mat", "", "red fast cars run quickly home today",
             "they said the old man saw her new car"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string")
    tok = df.select("doc_id", K.tokenize("t").alias("tok"))
    folded = {r[0]: (r[1], r[2]) for r in tok.select(
        "doc_id", K.noun_chunk_stats("tok", K.pos_tags("tok")).alias("s")).select("doc_id", "s.chunks", "s.chars").collect()}
    long = tok.select("doc_id", F.posexplode("tok").alias("pos", "tok")).withColumn("tag", K.rule_tag(F.col("tok")))
    chunks = K.noun_chunks_long(long, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("chunk_chars").alias("c"))
    windowed = {r[0]: (r[1], r[2]) for r in chunks.collect()}
    for i in range(len(texts)):
        assert folded[i] == windowed.get(i, (0, 0))


def test_tagger_closed_class_and_suffixes(spark):
    words = ["he", "and", "the", "quickly", "running", "jumped", "happiness", "beautiful", "cats", "42", ",", "zzz"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    tags = [r[0] for r in df.select(K.rule_tag(F.col("w"))).collect()]
    assert tags == ["PRP", "CC", "DT", "RB", "VBG", "VBD", "NN", "JJ", "NNS", "CD", ",", "NN"]


def test_feature_table_label_defaults(spark):
    df = spark.createDataFrame([("some text here",)], "article_text string")
    row = FE.feature_table(df).collect()[0]
    assert row["label"] == "Unknown" and row["article_id"] is None
    assert FE.feature_table(df).columns == ["label", "article_id", *FE.FEATURE_COLUMNS]


def test_entity_spans_longest_non_overlapping(spark):
    gaz = spark.createDataFrame([("new york", "GPE"), ("new york city", "GPE"), ("york", "GPE"), ("city hall", "FAC"),
                                 ("hall", "X")], "entity string, label string")
    texts = [["i", "love", "new", "york", "city", "hall"], ["york", "city", "hall", "new"], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, toks array<string>")
    got = sorted((r["doc_id"], r["start"], r["n"], r["entity"]) for r in K.entity_spans(df, "doc_id", "toks", gaz).collect())
    gz = {"new york": "GPE", "new york city": "GPE", "york": "GPE", "city hall": "FAC", "hall": "X"}
    want = []
    for d, toks in enumerate(texts):
        i = 0
        while i < len(toks):
            hit = next((n for n in (3, 2, 1) if i + n <= len(toks) and " ".join(toks[i:i + n]) in gz), None)
            if hit:
                want.append((d, i, hit, " ".join(toks[i:i + hit])))
                i += hit
            else:
                i += 1
    assert got == sorted(want)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

WORDS = st.sampled_from(["the", "big", "dog", "ran", "quickly", "and", "he", "said", "3", "340,000", ".", "!", "?",
                         "'", "happiness", "texas", "beautiful", "<b>", "http://x.y/z", "\n", "  "])


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=25).map(" ".join), min_size=40, max_size=40))
def test_feature_invariants(spark, texts):
    rows = _features(spark, texts)
    for r in rows.values():
        n = r["word_count"]
        assert r["bigram_length"] == max(n - 1, 0) and r["trigram_length"] == max(n - 2, 0)
        assert r["unique_words_count"] <= n and r["digits_count"] == r["numeric_count"]
        assert r["verbs_count"] + r["adjectives_count"] + r["adverbs_count"] + r["nouns_count"] <= n
        assert r["unique_adjectives"] <= r["adjectives_count"] and r["unique_adverbs"] <= r["adverbs_count"]
        assert all(r[c] >= 0 for c in FE.FEATURE_COLUMNS)
        assert (r["sentence_count"] == 0) == (r["avg_sentence_length"] == 0) or n == 0
