import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from slantspark.llm import ngram_lm
from slantspark.llm.common import heldout


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute(rows):
    texts = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    c, pairs = collections.Counter(), collections.Counter()
    for i, w in texts:
        if not held(i):
            c.update(w)
            pairs.update(zip([b""] + w, w))
    n, v = sum(c.values()), len(c)
    after = collections.Counter(h for h, _ in pairs)
    base = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(h, w):
        return base(w) if not c[h] else max(pairs[h, w] - 0.75, 0) / c[h] + 0.75 * after[h] / c[h] * base(w)

    return [(i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(base(x)) for x in w),
             sum(math.log10(p(h, x)) for h, x in zip([b""] + w, w))) for i, w in texts]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "W" + str(int(rng.paretovariate(0.6)) % 900)
    out = [(i, rng.choice([" ", "\t", "\x0b"]).join(word() for _ in range(rng.randint(0, 150)))) for i in range(150)]
    return out + [(900, None), (901, ""), (None, "the the W1"), (902, "é x É"), (3, "the the"), (903, "the " * 9000)]


@pytest.mark.parametrize("batch", [8 << 20, 2000])
def test_scores_equal_brute_force(spark, docs_of, rows, monkeypatch, batch):
    monkeypatch.setattr(ngram_lm, "BATCH_BYTES", batch)
    docs = docs_of(rows).withColumnRenamed("lang", "data").withColumnRenamed("source", "shard").repartition(3)
    got = ngram_lm.fit_and_score(docs, ~heldout(F.col("doc_id"), 1)).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], abs=0.05 * b[2])  # the quantised probabilities


def test_probabilities_sum_to_one(spark, docs_of, monkeypatch):
    """Scoring every possible next word after a context gives a distribution, but for the quantisation."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(25)]
    train = {i: " ".join(rng.choice(vocabulary[:20]) for _ in range(60)) for i in range(40)}
    probes = {1000 + k: f"w3 {w}" for k, w in enumerate([*vocabulary[:20], "never"])} | {2000: "w3"}
    docs = docs_of(train | probes)
    got = {r.doc_id: r for r in ngram_lm.fit_and_score(docs, F.col("doc_id") < 1000).collect()}
    alone = brute([(i, t) for i, t in train.items()])
    assert alone
    # p(w | w3) for all known words, the end and one unknown word, from differences of scores
    counts = collections.Counter(x for t in train.values() for x in t.split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    pairs, after = collections.Counter(), collections.defaultdict(set)
    for t in train.values():
        w = [*t.split(), ""]
        for a, b in zip(["", *w], w):
            pairs[a, b] += 1
            after[a].add(b)
    total = sum(max(pairs["w3", w] - 0.75, 0) / counts["w3"] for w in [*counts, ""]) + 0.75 * len(after["w3"]) / counts["w3"]
    assert total == pytest.approx(1.0)
    assert got[1020].n_known == 2 and got[2000].n_tokens == 2 and n > v


def test_no_training_rows_and_empty_table(spark, docs_of):
    rows = ngram_lm.fit_and_score(docs_of({1: "a b", 2: ""}), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in sorted(rows)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert ngram_lm.fit_and_score(docs_of([]), F.lit(True)).count() == 0


def test_hot_contexts_are_split(spark, docs_of):
    """One word is nearly every context: its successors lie in several shards and still sum up."""
    rng = random.Random(1)
    rows = [(i, " ".join("hot " + f"w{rng.randint(0, 300)}" for _ in range(80))) for i in range(60)]
    got = sorted(map(tuple, ngram_lm.fit_and_score(docs_of(rows), ~heldout(F.col("doc_id"), 1)).collect()))
    for a, b in zip(got, sorted(brute(rows)), strict=True):
        assert a[:5] == b[:5] and a[6] == pytest.approx(b[6], abs=0.03 * b[2])


def test_higher_score_on_seen_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [r for r in ngram_lm.fit_and_score(docs, ~heldout(F.col("doc_id"), 1)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)
