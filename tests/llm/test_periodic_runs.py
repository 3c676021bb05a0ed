"""Runs against brute force over all periods and starts; grammar extensions against plain comparison."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from slantspark.llm import periodic_runs as P
from slantspark.llm.queries import REGISTRY


def plain_runs(words):
    """Every maximal stretch for every period, kept if its smallest period is that one and it is long enough."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            smaller = any(all(words[x] == words[x + r] for x in range(s, e - r)) for r in range(1, q))
            if e - s >= max(6, 4 * q) and not smaller:
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def some_texts(seed, count, most=120):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words = []
        while len(words) < rng.randint(0, most):
            piece = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
            words += piece * rng.choice([1, 1, 3, 4, 5, 9])
            if rng.random() < 0.3:
                words.append(rng.choice("xyz"))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("points", [1 << 20, 7])
def test_runs_equal_brute_force(points):
    texts = some_texts(1, 150)
    words, lengths = P.split_words(pa.array(texts))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    text, start, length, q = P.find_runs(codes, lengths, points)
    for n, t in enumerate(texts):
        here = text == n
        assert list(zip(start[here].tolist(), length[here].tolist(), q[here].tolist())) == plain_runs(t.split()), t


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(4)
    for size, kinds in [(2, 1), (50, 1), (300, 2), (400, 3), (2000, 2)]:
        body = rng.integers(0, kinds, size)
        if size == 2000:
            body = np.tile(body[:37], 60)[:size]
        seq = np.concatenate([[kinds], body, [kinds + 1]])
        grammar = P.Grammar(seq)
        i, j = rng.integers(1, size + 1, (2, 500))
        i, j = i[i != j], j[i != j]
        right, left = grammar.extend(i, j), grammar.extend_left(i, j)
        for a, b, r, l in zip(i, j, right, left):
            x = 0
            while seq[a + x] == seq[b + x]:
                x += 1
            y = 0
            while seq[a - 1 - y] == seq[b - 1 - y]:
                y += 1
            assert (x, y) == (r, l)


def test_levels_shrink():
    seq = np.concatenate([[9], np.random.default_rng(0).integers(0, 3, 5000), [10]])
    sizes = [len(level.symbols) for level in P.Grammar(seq).levels]
    assert sizes[-1] == 1 and len(sizes) < 80 and sum(sizes) < 8 * len(seq)


def test_words_split_as_the_contract_says():
    texts = ["", None, "  a \t b\n", "x", "\x0b\x0c\r", "a\x1cb\x85c d e f", "\x00 é"]
    words, lengths = P.split_words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and words.to_pylist() == [w for line in want for w in line]


def test_rows_equal_brute_force(spark):
    texts = some_texts(2, 60) + ["", None, "one", "a a a a a", "a a a a a a", "ab ab ab", " \n ", "p q " * 4, "é é é é é é\t\té"]
    ids = list(range(len(texts) - 3)) + [5, 5, None]
    rows = [(i, t, 1, "z", 2) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string, start int").repartition(3)
    found = P.run_digests(P.periodic_runs(P.repeated_texts(docs)))
    key = lambda r: tuple((x is None, x if x is not None else 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted((plain_row(i, t) for i, t in zip(ids, texts)), key=key)


def test_long_text_that_repeats(spark):
    text = " ".join((["a", "b"] * 30_000) + [f"w{i}" for i in range(50)] * 2000)
    docs = spark.createDataFrame([(3, text), (4, "k " * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[3]["runs"]] == [(0, 60_000, 2), (60_000, 100_000, 50)]
    assert got[3]["collapsed"] == " ".join(["a", "b"] + [f"w{i}" for i in range(50)])
    assert [tuple(r) for r in got[4]["runs"]] == [(0, 200_000, 1)] and got[4]["collapsed"] == "k"


def test_empty_table(spark):
    assert P.run_digests(P.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = REGISTRY["op12_recompression_runs"](spark, sf).collect()
    assert len(found) == len(docs)
    short = [r for r in found if len((docs[r["doc_id"]] or "").split()) < 400]
    assert len(short) > 50 and any(r["n_runs"] for r in short)
    for r in short:
        assert tuple(r) == plain_row(r["doc_id"], docs[r["doc_id"]])
