import random
import zlib

import numpy as np
import pytest

from slantspark.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    bad = ["vile", "scumbag", "rotten", "louse"]
    word = lambda: "w" + str(int(rng.paretovariate(0.7)) % 2000)
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 300))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "!!", "."]))
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark, docs_of, case):
    rows, labels = case
    docs, given = docs_of(rows).withColumnRenamed("lang", "toxic"), spark.createDataFrame(labels, LABELS)
    known = {i for i, _, _ in labels[:500]}
    model = toxicity.train(docs, given.where("doc_id < 500"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 600 and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    test = [(got[i].predicted, t) for i, _, t in labels if held(i) or i not in known]
    assert np.mean([p == t for p, t in test]) > 0.95


def test_only_training_labels_matter(spark, docs_of, case):
    rows, labels = case
    flipped = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    docs = docs_of(rows)
    a, b = (toxicity.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert a["prior"] == b["prior"] and (a["curve"]["beta"] == b["curve"]["beta"]).all()


def test_no_words_no_labels_one_class(spark, docs_of, case):
    rows, labels = case
    docs = docs_of([(1, None), (2, ""), (3, "?!"), (None, "vile louse"), (4, "w1 " * 30_000)])
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[1].score == got[2].score == got[3].score == model["prior"] < 0.5
    assert got[None].held_out is False and got[None].predicted == 1 and got[4].predicted == 0
    for given, value in (([], 0.0), ([(1, 0, 0), (4, 0, None)], 0.0), ([(2, 0, 1)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(given, LABELS))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {value}
    assert toxicity.score(docs_of([]), model).count() == 0


def test_filter_agrees_with_the_score(spark, docs_of, case):
    rows, labels = case
    docs = docs_of(rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}


def test_class_models_are_distributions():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 30, (400, 2)), axis=0).astype(np.uint64)
    counts = [rng.integers(0, 4, len(pairs)), rng.integers(0, 2, len(pairs))]
    used = counts[0] + counts[1] > 0
    model = toxicity.build(pairs[used, 0], pairs[used, 1], [c[used] for c in counts])
    for k in (0, 1):
        unseen = model["unknown"][k]
        assert model["lower"][k].sum() + unseen == pytest.approx(1.0, abs=0.02)
