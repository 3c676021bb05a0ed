import hashlib
import random
import re

import numpy as np
import pytest

from slantspark.llm import winnow

ITEMS = "item_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, item in items:
            v = words(item)
            n = min(10, len(v))
            windows = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n and i is not None else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(i))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["Ünder", "naïve", "X9"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ",", "'s"]) for _ in range(n))
    items = [(k, text(rng.randint(10, 40))) for k in range(30)] + [(100, "tiny item"), (101, ""), (102, None), (103, "a a a a a a a a a a a a"), (None, "no id")]
    docs = []
    for d in range(120):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            v = words(rng.choice(items[:30])[1])
            a = rng.randint(0, len(v) - 5)
            parts += [" ".join(v[a:a + rng.randint(5, 20)]).upper(), text(5)]
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "a " * 5000), (503, "the tiny item!"), (504, "a a a")]
    return docs, items


@pytest.mark.parametrize("bound", [64 << 20, -1])
def test_both_ways_equal_brute_force(spark, docs_of, case, bound):
    docs, items = case
    table = docs_of(docs).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "n_hit")
    got = winnow.decontaminate(table, spark.createDataFrame(items, ITEMS), broadcast_bytes=bound).collect()
    want = brute(docs, items)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("bound", [64 << 20, -1])
def test_cleaning_removes_hit_documents_only(spark, docs_of, case, bound):
    docs, items = case
    kept = winnow.decontaminate(docs_of(docs), spark.createDataFrame(items, ITEMS), broadcast_bytes=bound, clean=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(docs, items) if not r[5]}


@pytest.mark.parametrize("bound", [64 << 20, -1])
def test_empty_tables(spark, docs_of, bound):
    none = spark.createDataFrame([], ITEMS)
    assert winnow.decontaminate(docs_of([]), none, broadcast_bytes=bound).count() == 0
    rows = winnow.decontaminate(docs_of({1: "a b"}), none, broadcast_bytes=bound).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in rows] == [(1, 2, 0, False)]


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(3)
    for n in (6, 7, 30, 500):
        grams = rng.integers(0, 50, n).astype(np.uint64)
        kept = set(winnow.kept_positions(grams, 6).tolist())
        assert all(kept & {k for k in range(a, a + 6) if grams[k] == grams[a:a + 6].min()} for a in range(n - 5))


@pytest.mark.parametrize("bound", [64 << 20, -1])
def test_null_and_shared_ids_and_clashing_columns_on_both_ways(spark, bound):
    """Each row is judged by its own text, whatever its id; no column name of the table clashes."""
    leak = " ".join(f"w{i}" for i in range(40))
    rows = [(None, leak), (None, "fine words here"), (5, "x " + leak), (5, "clean"), (5, None), (6, leak), (6, leak), (7, "w1 w2")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, bad_key int, key string")
    items = spark.createDataFrame([(1, leak)], ITEMS)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in winnow.decontaminate(docs, items, broadcast_bytes=bound).collect()), key=repr)
    want = sorted(((i, len((t or "").split()), 40 * (leak in (t or "")), int(leak in (t or "")), leak in (t or "")) for i, t in rows), key=repr)
    assert got == want
    kept = winnow.decontaminate(docs, items, broadcast_bytes=bound, clean=True)
    assert kept.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(i, t) for i, t in rows if leak not in (t or "")], key=repr)
