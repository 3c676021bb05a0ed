"""The sentence model on text with abbreviations, against plain formulas, and on odd input."""
import math
import random
from collections import Counter

import pytest

from slantspark.operators import sentence_model as SM

RNG = random.Random(4)
NOUNS = ["economy", "senate", "market", "army", "paper", "river", "minister", "budget", "treaty", "harbour"]
VERBS = ["grew", "met", "fell", "left", "rose", "slept", "spoke", "failed"]


def corpus():
    out = []
    for n in range(400):
        noun, verb = RNG.choice(NOUNS), RNG.choice(VERBS)
        out.append(RNG.choice([f"The U.S. {noun} {verb}.", f"However the {noun} {verb}.", f"Dr. Smith saw the {noun}.", f"The {noun} {verb} on Jan. 5 again!",
                               f"Then Mr. Jones {verb}?", f"The price of the {noun} rose 3.5 points and {verb}."]))
    return [(i, " ".join(out[i: i + 8])) for i in range(0, 400, 8)]


@pytest.fixture(scope="module")
def learned(spark):
    texts = spark.createDataFrame(corpus(), "k long, text string").repartition(4)
    return texts, SM.fit(texts)


def test_abbreviations_are_found(learned):
    found = {r["typ"] for r in learned[1].abbreviations.collect()}
    assert {"u.s", "dr", "mr", "jan"} <= found and not found & set(NOUNS + VERBS + ["again", "points"])


def test_scores_equal_plain_formulas(learned):
    texts, model = learned
    n, k = Counter(), Counter()
    for r in texts.collect():
        for w in r["text"].lower().split():
            typ = w.rstrip("!?")
            typ = typ[:-1] if typ.endswith(".") else typ
            typ = "##number##" if typ[0].isdigit() else typ
            n[typ] += 1
            k[typ] += w.endswith(".")
    p = sum(k.values()) / sum(n.values())
    got = {r["typ"]: (r["n"], r["n_period"], r["score"]) for r in model.types.collect()}
    assert set(got) == {t for t in n if k[t] and t != "##number##"}
    for t, (a, b, score) in got.items():
        ratio = -2 * (b * math.log(p) + (a - b) * math.log(1 - p) - b * math.log(0.99) - (a - b) * math.log(0.01))
        inner = t.count(".")
        letters = len(t) - inner
        assert (a, b) == (n[t], k[t]) and score == pytest.approx(ratio * math.exp(-letters) * (inner + 1) * letters ** -(a - b), abs=1e-6)


def test_sentences_of_fixtures(spark, learned):
    _, model = learned
    texts = {1: "The U.S. economy grew.", 2: "Dr. Smith met the senate. The market fell! Then it rose?", 3: "the army left on Jan. 5 again", 4: "The U.S. However the army met.",
             5: "", 6: None, 7: " ... ", 8: "(The paper fell.) \"The budget grew.\"", 9: "one"}
    found = {r["k"]: r["sentence_count"] for r in SM.sentence_counts(spark.createDataFrame(list(texts.items()), "k long, text string"), "k", "text", model).collect()}
    assert found == {1: 1, 2: 3, 3: 1, 4: 2, 8: 2, 9: 1}


def test_counts_of_the_corpus_equal_its_making(learned):
    texts, model = learned
    assert {r["sentence_count"] for r in SM.sentence_counts(texts, "k", "text", model).collect()} == {8}


def test_nothing_to_learn_from(spark):
    empty = SM.fit(spark.createDataFrame([], "k long, text string"))
    assert empty.types.count() == 0
    one = spark.createDataFrame([(1, "a b. c d. e", 3)], "k long, text string, typ int")
    assert [r["sentence_count"] for r in SM.sentence_counts(one, "k", "text", empty).collect()] == [3]
    assert SM.sentence_counts(one.where("false"), "k", "text", SM.fit(one)).count() == 0


def test_features_with_the_sentence_model(spark, learned):
    from slantspark.operators import features as FE
    df = spark.createDataFrame([(1, "The U.S. economy grew. Dr. Smith slept!"), (2, "")], "article_id long, article_text string")
    got = {r["article_id"]: r for r in FE.feature_table(df, sentences=learned[1]).collect()}
    plain = {r["article_id"]: r for r in FE.feature_table(df).collect()}
    assert got[1]["sentence_count"] == 2 and plain[1]["sentence_count"] > 2
    assert got[1]["avg_sentence_length"] == got[1]["word_count"] / 2 and got[2]["sentence_count"] == 0 == got[2]["avg_sentence_length"]
    assert all(got[n][c] == plain[n][c] for n in got for c in FE.FEATURE_COLUMNS if c not in FE.SENTENCE_FEATURES)
