"""The chunk grammar against hand-tagged phrases, and its single pass against brute-force leftmost-longest matching."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from slantspark.operators import chunk_grammar as CG
from slantspark.operators import features as FE

G = CG.NOUN_PHRASES
TAG_OF = {x: tags[0] for x, tags in G.tags} | {"o": "VBD", "Q": "''", "S": "NN"}
TOKEN_OF = {"Q": "'", "S": "s"}


def accepted(symbols):
    """Can the whole sequence be walked to an accepting state?"""
    state = CG.START
    for x in symbols:
        state = G.move(state, x)
        if state is None:
            return False
    return state in G.accepting


def brute(symbols):
    """Leftmost longest chunks, every start and end tried."""
    out, at = [], 0
    while at < len(symbols):
        stop = next((e for e in range(len(symbols), at, -1) if accepted(symbols[at:e])), None)
        if stop:
            out.append((at, stop))
        at = stop or at + 1
    return out


def rows_of(spark, cases):
    rows = [(n, [TOKEN_OF.get(x, "w" * (1 + i % 4)) for i, x in enumerate(c)], [TAG_OF[x] for x in c]) for n, c in enumerate(cases)]
    return spark.createDataFrame(rows, "k int, toks array<string>, tags array<string>")


def test_equals_brute_force(spark):
    letters = "ADCJRXZNPGQSo"
    rng = random.Random(7)
    cases = ["".join(c) for n in range(4) for c in itertools.product(letters, repeat=n)]
    cases += ["".join(rng.choices(letters, [1, 3, 1, 4, 2, 2, 1, 6, 1, 2, 2, 2, 1], k=rng.randint(4, 40))) for _ in range(3000)]
    df = rows_of(spark, cases)
    got = {r["k"]: tuple(r["s"]) for r in df.select("k", CG.chunk_stats(F.col("toks"), F.col("tags")).alias("s")).collect()}
    toks = {r["k"]: r["toks"] for r in df.collect()}
    for n, c in enumerate(cases):
        spans = brute(c)
        assert got[n] == (len(spans), sum(len(" ".join(toks[n][a:b])) for a, b in spans), sum(b - a for a, b in spans)), c


@pytest.mark.parametrize("words, tags, phrases", [
    ("all the king 's men ran", "PDT DT NN POS NNS VBD", ["all the king 's men"]),                      # nested determiners, possessive
    ("all the king ' s horses", "PDT DT NN '' NN NNS", ["all the king ' s horses"]),
    ("the kings ' men said no", "DT NNS '' NNS VBD UH", ["the kings ' men"]),
    ("red and very blue cars", "JJ CC RB JJ NNS", ["red and very blue cars"]),                          # coordination inside
    ("cats and dogs", "NNS CC NNS", ["cats", "dogs"]),                                                  # and between phrases
    ("the big , old , grey house", "DT JJ , JJ , JJ NN", ["the big , old , grey house"]),
    ("she saw my two very small dogs", "PRP VBD PRP$ CD RB JJ NNS", ["she", "my two very small dogs"]),
    ("the very", "DT RB", []), ("the the dog", "DT DT NN", ["the dog"]), ("very dogs", "RB NNS", ["dogs"]),
    ("king 's the dog", "NN POS DT NN", ["king", "the dog"]), ("", "", []),
])
def test_phrases(spark, words, tags, phrases):
    df = spark.createDataFrame([(words.split(), tags.split())], "toks array<string>, tags array<string>")
    s = df.select(CG.chunk_stats(F.col("toks"), F.col("tags")).alias("s")).first()["s"]
    assert (s["chunks"], s["chars"], s["words"]) == (len(phrases), sum(map(len, phrases)), sum(len(p.split()) for p in phrases))


def test_a_grammar_of_ones_own(spark):
    verbs = CG.ChunkGrammar(tags=(("M", ("MD",)), ("V", ("VB",))), words=(("T", ("to",)),),
                            moves={CG.START: {"MT": "before", "V": "verb"}, "before": {"V": "verb"}, "verb": {"V": "verb"}}, accepting=("verb",))
    df = spark.createDataFrame([("they will go to go see".split(), "PRP MD VB TO VB VB".split())], "toks array<string>, tags array<string>")
    assert tuple(df.select(CG.chunk_stats(F.col("toks"), F.col("tags"), verbs).alias("s")).first()["s"]) == (2, 16, 5)


def test_tables_that_one_pass_cannot_follow_are_refused():
    tags = (("A", ("a",)), ("B", ("b",)), ("C", ("c",)))
    with pytest.raises(ValueError, match="end inside"):       # "B" alone is a chunk, but "A B" waits for "C"
        CG.ChunkGrammar(tags, (), {CG.START: {"A": "one", "B": "done"}, "one": {"B": "two"}, "two": {"C": "done"}, "done": {}}, ("done",))
    with pytest.raises(ValueError, match="begin before"):     # "A A B" fails at B, though "A B" begins at the second A
        CG.ChunkGrammar(tags, (), {CG.START: {"A": "one"}, "one": {"A": "two", "B": "done"}, "two": {"C": "done"}, "done": {}}, ("done",))
    with pytest.raises(ValueError, match="without moves"):
        CG.ChunkGrammar(tags, (), {CG.START: {"A": "gone"}}, ())


def test_feature_path_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "The king's men and the very old dog ran."), (2, ""), (3, None), (4, "dog " * 20_000)], "k int, article_text string")
    plain = {r["k"]: r for r in FE.extract_features(df, keep=["k"]).collect()}
    got = {r["k"]: r for r in FE.extract_features(df, keep=["k"], chunks=G).collect()}
    assert {k: got[k]["noun_phrases_count"] for k in got} == {1: 2, 2: 0, 3: 0, 4: 1}
    assert got[1]["avg_noun_phrase_length"] == (len("the king ' s men") + len("the very old dog")) / 2
    assert got[4]["avg_noun_phrase_length"] == len("dog " * 20_000) - 1
    same = [c for c in FE.FEATURE_COLUMNS if c not in FE.CHUNK_FEATURES]
    assert all(got[k][c] == plain[k][c] for k in got for c in same)


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "a dog")], "k int, article_text string")
    plan = FE.extract_features(df, keep=["k"], chunks=G)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
