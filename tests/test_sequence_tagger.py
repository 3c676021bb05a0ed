"""The sequence tagger against brute force: counts and costs by hand, paths by trying every tag sequence."""
import itertools
import math
from collections import Counter

import numpy as np
import pytest

from slantspark.operators import sequence_tagger as ST

# A small hand-tagged text; "saw", "run" and "light" are ambiguous.
HAND = """
the/DT dog/NN saw/VBD the/DT cat/NN ./.
a/DT saw/NN cuts/VBZ wood/NN ./.
dogs/NNS run/VBP fast/RB ./.
the/DT run/NN was/VBD long/JJ ./.
they/PRP run/VBP and/CC we/PRP walk/VBP ./.
the/DT light/NN was/VBD red/JJ ./.
a/DT light/JJ meal/NN helps/VBZ ./.
we/PRP saw/VBD the/DT red/JJ light/NN ./.
birds/NNS sing/VBP softly/RB ./.
she/PRP sadly/RB walked/VBD home/NN ./.
"""
SENTENCES = [[tuple(w.rsplit("/", 1)) for w in line.split()] for line in HAND.strip().splitlines()]
ROWS = [(s, p, tok, tag) for s, line in enumerate(SENTENCES) for p, (tok, tag) in enumerate(line)]
SCHEMA = "sent long, pos int, tok string, tag string"


def plain_model(rows):
    """Counts and whole-number costs, computed in plain Python."""
    by_sentence = {}
    for s, p, tok, tag in rows:
        by_sentence.setdefault(s, {})[p] = (tok, tag)
    tag_n = Counter(tag for *_, tag in rows)
    names, total = sorted(tag_n), len(rows)
    trans = Counter()
    for line in by_sentence.values():
        tags = [line[p][1] for p in sorted(line)]
        trans.update(zip(["^", *tags], [*tags, "$"]))
    micro = lambda p: round(-math.log(p) * 1e6)
    cost = {}
    for prev in [*names, "^"]:
        of_prev = sum(trans[prev, t] for t in [*names, "$"])
        for t in [*names, "$"]:
            cost[prev, t] = micro((trans[prev, t] + 1) / (of_prev + len(names) + 1))
    words = Counter((tok, tag) for _, _, tok, tag in rows)
    totals = Counter(tok for _, _, tok, _ in rows)
    endings = Counter()
    for (tok, tag), n in words.items():
        if totals[tok] <= 10 and len(tok) > 3:
            endings[tok[-3:], tag] += n
    end_totals = Counter()
    for (form, _), n in endings.items():
        end_totals[form] += n

    def emit(tok, tag):
        share = tag_n[tag] / total
        for form, counts, sums in ((tok, words, totals), (tok[-3:] if len(tok) > 3 else None, endings, end_totals)):
            if sums[form]:
                n = counts[form, tag]
                return micro((n + share) / ((sums[form] + 1) * share)) if n else -micro(sums[form] + 1.0)
        return 0

    return names, trans, cost, emit


def plain_best(model, toks):
    names, _, cost, emit = model
    best = None
    for tags in itertools.product(names, repeat=len(toks)):
        total = sum(cost[a, b] for a, b in zip(["^", *tags], [*tags, "$"])) + sum(emit(w, t) for w, t in zip(toks, tags))
        best = min(best, total) if best is not None else total
    return best


def cost_of(model, toks, tags):
    _, _, cost, emit = model
    return sum(cost[a, b] for a, b in zip(["^", *tags], [*tags, "$"])) + sum(emit(w, t) for w, t in zip(toks, tags))


@pytest.fixture(scope="module")
def fitted(spark):
    return ST.fit(spark.createDataFrame(ROWS, SCHEMA).repartition(5), ["sent"])


def test_transitions_equal_plain_counts(fitted):
    names, trans, cost, _ = plain_model(ROWS)
    found = {(r["prev"], r["tag"]): (r["n"], r["cost"]) for r in fitted.transitions.collect()}
    assert fitted.names == names and len(found) == (len(names) + 1) ** 2
    assert found == {k: (trans[k], v) for k, v in cost.items()}


def test_emissions_equal_plain_costs(fitted):
    names, _, _, emit = plain_model(ROWS)
    for r in fitted.forms.where("kind = 'word'").collect():
        costs = {names[t]: c for t, c in zip(r["tags"], r["costs"])}
        assert [costs.get(t, r["rest"]) for t in names] == [emit(r["form"], t) for t in names]


def test_paths_equal_brute_force(spark, fitted):
    """Few tags, all tag sequences tried: seen words, unseen words with a known ending, words of which nothing is known."""
    rows = [r for r in ROWS if r[3] in ("DT", "NN", "VBD", "JJ", "PRP")]
    rows = [(s, n, tok, tag) for s, line in itertools.groupby(rows, key=lambda r: r[0]) for n, (_, _, tok, tag) in enumerate(line)]
    model = ST.fit(spark.createDataFrame(rows, SCHEMA), ["sent"])
    plain = plain_model(rows)
    texts = ["the light saw the dog", "we talked", "xx", "the saw saw", "she saw a red run home", "the the the", "q w e r"]
    tokens = spark.createDataFrame([(n, p, w) for n, t in enumerate(texts) for p, w in enumerate(t.split())], "sent long, pos int, tok string")
    found = {r["sent"]: r for r in ST.tag_sequences(tokens, model, ["sent"]).collect()}
    for n, t in enumerate(texts):
        assert found[n]["tok"] == t.split() and found[n]["pos"] == list(range(len(t.split())))
        assert cost_of(plain, t.split(), found[n]["tags"]) == plain_best(plain, t.split())


def test_context_decides(spark, fitted):
    texts = {0: "a saw was red .", 1: "we saw wood .", 2: "the run was long .", 3: "we run fast ."}
    tokens = spark.createDataFrame([(n, p, w) for n, t in texts.items() for p, w in enumerate(t.split())], "sent long, pos int, tok string")
    tags = {r["sent"]: dict(zip(r["tok"], r["tags"])) for r in ST.tag_sequences(tokens, fitted, ["sent"]).collect()}
    assert (tags[0]["saw"], tags[1]["saw"], tags[2]["run"], tags[3]["run"]) == ("NN", "VBD", "NN", "VBP")


def test_batches_of_sequences_equal_single_ones():
    rng = np.random.default_rng(0)
    matrix = rng.integers(0, 50, (5, 5))                     # small whole numbers: many ties
    lengths = rng.integers(0, 9, 40)
    emission = rng.integers(0, 50, (lengths.sum(), 4))
    together = ST.best_paths(emission, lengths, matrix)
    at = 0
    for n in lengths:
        alone = ST.best_paths(emission[at: at + n], np.array([n]), matrix)
        assert together[at: at + n].tolist() == alone.tolist()
        at += n


def test_nulls_gaps_repeats_empty_and_clashing_names(spark, fitted):
    odd = ROWS + [(None, 0, "x", "NN"), (99, None, "x", "NN"), (99, 0, None, "NN"), (99, 0, "x", None)]
    again = ST.fit(spark.createDataFrame([(*r, 1, 2) for r in odd], SCHEMA + ", place int, n int"), ["sent"])
    assert sorted(map(tuple, again.transitions.collect())) == sorted(map(tuple, fitted.transitions.collect()))
    # a gap ends one stretch and starts another; a repeated position teaches its first tag only once in the transitions
    model = ST.fit(spark.createDataFrame([(1, 0, "a", "A"), (1, 5, "b", "B"), (2, 0, "a", "A"), (2, 0, "a", "B"), (2, 1, "b", "B")], SCHEMA), ["sent"])
    counts = {(r["prev"], r["tag"]): r["n"] for r in model.transitions.where("n > 0").collect()}
    assert counts == {("^", "A"): 2, ("A", "$"): 1, ("^", "B"): 1, ("B", "$"): 2, ("A", "B"): 1}
    tokens = spark.createDataFrame([(1, 0, "a", 7), (None, 0, "b", 7), (1, 1, None, 7)], "sent long, pos int, tok string, rest int")
    got = {r["sent"]: r for r in ST.tag_sequences(tokens, model, ["sent"]).collect()}
    assert got[1]["tok"] == ["a", None] and None not in got[1]["tags"] and got[None]["tags"] == ["B"]
    nothing = ST.fit(spark.createDataFrame([], SCHEMA), ["sent"])
    assert [r["tags"] for r in ST.tag_sequences(tokens, nothing, ["sent"]).collect()].count([None]) == 1
    assert ST.tag_sequences(tokens.where("false"), model, ["sent"]).count() == 0


def test_saved_model_tags_alike(spark, fitted, tmp_path):
    opened = ST.SequenceTagger.open(spark, fitted.save(str(tmp_path / "tagger")))
    tokens = spark.createDataFrame(ROWS, SCHEMA)
    a, b = (sorted(map(str, ST.tag_tokens(tokens, m, ["sent"]).collect())) for m in (fitted, opened))
    assert a == b and len(a) == len(ROWS)


def test_long_sequence_and_many_batches(spark, fitted):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = "we saw the red light .".split() * 50
        tokens = spark.createDataFrame([(s, p, w) for s in range(3) for p, w in enumerate(words)], "sent long, pos int, tok string")
        found = ST.tag_sequences(tokens, fitted, ["sent"]).collect()
        assert len(found) == 3 and all(r["tok"] == words and r["tags"] == found[0]["tags"] for r in found)
        assert found[0]["tags"][:6] == ["PRP", "VBD", "DT", "JJ", "NN", "."]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
