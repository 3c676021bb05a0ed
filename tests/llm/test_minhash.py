import itertools
import random

import numpy as np
import pytest

from slantspark.llm import minhash_dedup
from slantspark.llm.components import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def reach(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = reach(sorted(sets), edges)
    return {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}, edges


@pytest.fixture(scope="module")
def corpus():
    """Groups around one base, where members link to the base, to each other or to nothing, plus plain texts."""
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randint(0, 400))
    rows, n = [], 0
    for size, length in ((60, 80), (40, 30), (8, 200), (5, 6), (12, 12)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, length // 12])):
                w[rng.randrange(length)] = word()
            rows.append((n * 7 % 1009, " ".join(w)))
            n += 1
    for _ in range(60):
        rows.append((n * 7 % 1009, " ".join(word() for _ in range(rng.randint(1, 60)))))
        n += 1
    return rows + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2004, "one"), (2005, "one two"), (2006, "ONE  two"), (2007, "x " * 20_000)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, docs_of, corpus, k, percent):
    table = docs_of(corpus).withColumnRenamed("lang", "rep").withColumnRenamed("source", "bands")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(table, k=k, percent=percent).collect()}
    want, edges = brute(corpus, k, percent)
    assert len(edges) > 200 and got == want


def test_blocks_of_one_bucket_meet(spark, docs_of, corpus, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "ROW_BYTES", minhash_dedup.BLOCK_BYTES // 3)  # three rows a block
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(corpus), k=3, percent=85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(corpus, 3, 85)[0].items()}


def test_shuffle_joins_beyond_the_broadcast_bound(spark, docs_of, corpus, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BROADCAST_IDS", -1)
    kept = minhash_dedup.keep_representatives(docs_of(corpus), k=5, percent=80)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, _, k) in brute(corpus, 5, 80)[0].items() if k}


def test_null_and_shared_ids_and_empty_table(spark, docs_of):
    text = " ".join(map(str, range(30)))
    got = minhash_dedup.near_duplicates(docs_of([(None, text), (5, text), (5, "other words here"), (9, "other words here"), (7, text)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == \
        sorted([(None, None, True), (5, 5, True), (5, 5, True), (9, 5, False), (7, 5, False)], key=repr)
    assert minhash_dedup.near_duplicates(docs_of([])).count() == 0


def test_signature_estimates_similarity_and_fills_empty_bins():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    a, b = np.unique(base[:3600]), np.unique(base[400:])
    same = np.mean([(minhash_dedup.one_permutation(a, 120, s) == minhash_dedup.one_permutation(b, 120, s)).mean() for s in range(1, 40)])
    assert abs(same - 3200 / 4000) < 0.03
    small = minhash_dedup.one_permutation(base[:3])
    assert set(small.tolist()) <= set(minhash_dedup._mix(base[:3] + np.uint64(1)).tolist())
    assert minhash_dedup.band_length(0.85) == 5 and minhash_dedup.band_length(0.8) == 4


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 3), (5000, 5000)], "a long, b long"), "a", "b").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = reach(sorted(nodes), edges) if all(a in nodes and b in nodes for a, b in edges) else reach(sorted(nodes), [e for e in edges if e[0] != e[1]])
    assert got == want


def test_representatives_of_a_table_with_a_clashing_column(spark):
    a = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a, 9), (2, a, 9), (3, "other words", 9)], "doc_id long, text string, dropped_id int")
    kept = minhash_dedup.keep_representatives(docs)
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == [1, 3]
