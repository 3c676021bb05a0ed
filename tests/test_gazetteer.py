"""Gazetteer matching against brute force, long entities and odd input included; learned annotators in the feature path."""
import random

from paths import SF_SMALL

from slantspark.operators import features as FE
from slantspark.operators import gazetteer as G
from slantspark.operators import sequence_tagger as ST


def brute(texts, entries):
    labels = {}
    for entity, label in entries:
        if entity is not None and entity.split():
            key = " ".join(entity.split(" "))
            labels[key] = min(labels.get(key, label), label)
    out = []
    for key, toks in texts:
        toks, i = toks or [], 0
        while i < len(toks):
            best = None
            for n in range(1, len(toks) - i + 1):
                if None in toks[i: i + n]:
                    break
                if " ".join(toks[i: i + n]) in labels:
                    best = n
            if best:
                name = " ".join(toks[i: i + best])
                out.append((key, i, best, name, labels[name]))
            i += best or 1
    return sorted(out, key=str)


def spans(spark, texts, entries):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts], "k long, toks array<string>, n int, entity string").repartition(3)
    gaz = spark.createDataFrame(entries, "entity string, label string")
    return sorted((tuple(r) for r in G.entity_spans(docs, "k", "toks", gaz).collect()), key=str)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh")
    texts = [(n, [word() for _ in range(rng.randint(0, 80))]) for n in range(40)]
    entries = [(" ".join(word() for _ in range(rng.randint(1, 4))), rng.choice(["X", "Y"])) for _ in range(60)]
    for _ in range(30):                                       # entities that do occur, up to 40 words, and one word off
        key, toks = rng.choice([t for t in texts if len(t[1]) > 45])
        n = rng.randint(5, 40)
        i = rng.randint(0, len(toks) - n)
        entries.append((" ".join(toks[i: i + n]), "LONG"))
        entries.append((" ".join([*toks[i: i + n - 1], "zz"]), "NEVER"))
    assert spans(spark, texts, entries) == brute(texts, entries)


def test_nulls_labels_repeats_and_empty(spark):
    texts = [(1, ["new", "york", None, "york"]), (1, ["york"]), (None, ["new", "york"]), (2, None), (3, [])]
    entries = [("new york", "B"), ("new york", "A"), ("york", "C"), (None, "N"), ("", "E"), ("new york none york", "D")]
    assert spans(spark, texts, entries) == brute(texts, entries)
    assert spans(spark, texts, []) == [] and spans(spark, [], entries) == []


def test_no_ngrams_of_texts_leave_the_scan(spark):
    """A text without a plausible start sends nothing on, however long the entities are."""
    starts = G.Starts(*(G._bit_table(spark.createDataFrame([(k,) for k in keys], "key string")) for keys in (["alone"], ["new"], ["new york"])))
    seen = {}
    assert starts.plausible("new jersey york new york alone new".split(), seen) == [3, 5]
    rows = spark.createDataFrame([(1, ["a", "b", "c"] * 100), (2, ["new", "york", "c"])], "_row long, _toks array<string>")
    assert [tuple(r) for r in G._windows(rows, starts).collect()] == [(2, 0, ["new", "york", "c"])]


def test_features_with_tagger_and_gazetteer(spark):
    texts = ["The red dog ran home. New York sleeps.", "", "red red quickly"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "article_id long, article_text string")
    tagged = spark.createDataFrame([(0, p, w, t) for p, (w, t) in enumerate(
        [("the", "DT"), ("red", "JJ"), ("dog", "NN"), ("ran", "VBD"), ("home", "RB"), (".", "."), ("new", "NNP"), ("york", "NNP"), ("sleeps", "VBZ"), (".", ".")])]
        + [(1, p, w, t) for p, (w, t) in enumerate([("red", "JJ"), ("red", "JJ"), ("quickly", "RB")])], "s long, pos int, tok string, tag string")
    model = ST.fit(tagged, ["s"])
    gaz = spark.createDataFrame([("new york", "GPE"), ("dog", "PET")], "entity string, label string")
    plain = {r["article_id"]: r for r in FE.feature_table(df).collect()}
    got = {r["article_id"]: r for r in FE.feature_table(df, tagger=model, gazetteer=gaz).collect()}
    assert FE.feature_table(df, tagger=model, gazetteer=gaz).columns == FE.feature_table(df).columns
    one = got[0]
    assert (one["verbs_count"], one["adjectives_count"], one["adverbs_count"], one["nouns_count"]) == (2, 1, 1, 3)
    assert (one["noun_phrases_count"], one["avg_noun_phrase_length"]) == (2, (11 + 8) / 2)
    assert (one["entities_count"], one["avg_entity_length"]) == (2, 5.5)
    assert (got[2]["adjectives_count"], got[2]["unique_adjectives"], got[2]["unique_adverbs"]) == (2, 1, 1)
    learned = set(FE.TAGGER_FEATURES + FE.GAZETTEER_FEATURES)
    for n in got:
        assert all(got[n][c] == plain[n][c] for c in FE.FEATURE_COLUMNS if c not in learned)
    assert all(got[1][c] == 0 for c in FE.FEATURE_COLUMNS)


def test_tagger_beats_the_word_lexicon_on_held_out_text(spark):
    """Case of words from context: better than each word's most frequent tag."""
    from pyspark.sql import functions as F

    from slantspark.operators import annotate as K
    from slantspark.plans import tagging as TG
    rows = TG.case_tags(spark, SF_SMALL).cache()
    test = rows.where("bucket < 20")
    model = ST.fit(rows.where("bucket >= 20"), ["doc_id", "sent"])
    found = ST.tag_tokens(test, model, ["doc_id", "sent"]).drop("tok")
    lexicon = K.fit_tagger(rows.where("bucket >= 20").select("tok", "tag")).select("tok", F.col("tag").alias("frequent"))
    both = test.join(found, ["doc_id", "sent", "pos"]).join(lexicon, "tok", "left")
    r = both.agg(F.avg((F.col("tag") == F.col("predicted")).cast("int")).alias("hmm"),
                 F.avg((F.col("tag") == F.coalesce("frequent", F.lit("L"))).cast("int")).alias("word"), F.count("*").alias("n")).first()
    assert r["n"] == test.count() and r["hmm"] > max(0.9, r["word"])


def test_frequent_runs_equal_brute_force_and_only_matches_leave_the_pass(spark):
    from pyspark.sql import functions as F
    rng = random.Random(3)
    texts = [[rng.choice("abcdé") if rng.random() < 0.5 else f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 60))] for _ in range(60)] + [None, [], ["a"]]
    df = spark.createDataFrame([(t,) for t in texts], "w array<string>").repartition(3)
    counts = {}
    for t in texts:
        for n in (2, 3, 4):
            for i in range(len(t or []) - n + 1):
                counts[" ".join(t[i: i + n])] = counts.get(" ".join(t[i: i + n]), 0) + 1
    got = {r["entity"]: r["cnt"] for r in G.frequent_runs(df, "w", 2, 4, 5).collect()}
    assert got == {g: c for g, c in counts.items() if c >= 5} and got
    listed = spark.createDataFrame([("x y", 2, ["x", "y"])], "entity string, n int, words array<string>")
    rows = spark.createDataFrame([(1, ["x", "y", "z"] * 50)], "_row long, _toks array<string>")
    grams = G._grams(rows, G._starts(listed), G._bit_table(listed.select(F.col("entity").alias("key"))), [2])
    assert [r["n"] for r in grams.collect()] == [2] * 50
