import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slantspark.llm.elias_fano import EliasFano
from slantspark.llm.ngram_lm import Trie, pack, unpack


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_round_trip_select_and_runs(values, a, b):
    values = np.array(sorted(values), np.uint64)
    ef = EliasFano.from_buffer(EliasFano.encode(values))
    assert ef.n == len(values)
    assert (ef.values() == values).all()
    if len(values):
        assert (ef.select(np.arange(len(values))) == values).all()
    a, b = min(a, b), max(a, b)
    assert (ef.values(a, b) == values[a:b]).all()


def test_near_minimal_space():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20_000)).astype(np.uint64)
    assert len(EliasFano.encode(values)) * 8 / len(values) < 2 + np.log2(1000) + 1.5  # 64 bits each in a plain table


def test_packed_arrays():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 1 << k, n).astype(np.uint64) for k, n in ((1, 5), (9, 0), (33, 1000), (63, 7))]
    back = unpack(pack(*arrays))
    assert len(back) == len(arrays) and all((x == y).all() for x, y in zip(arrays, back))


@pytest.fixture
def pairs():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 300, 200_000) * 100_000 + rng.integers(0, 5000, 200_000))
    return (keys // 100_000 * 7 + 1).astype(np.uint64), (keys % 100_000 * 3 + 1).astype(np.uint64), -rng.random(len(keys)) * 6


def test_trie_finds_exactly_its_pairs(pairs, tmp_path):
    context, word, logs = pairs
    data = Trie.build(context, word, logs)
    assert len(data) / len(word) < 5  # a plain table of (context, word, probability) takes 20
    (tmp_path / "t").write_bytes(data)
    for trie in (Trie(data), Trie.open(str(tmp_path / "t"))):
        codes = trie.lookup(context, word)
        assert (codes > 0).all()
        assert np.abs(trie.codebook[codes] - logs).max() < 0.05
        assert not trie.lookup(context, word + np.uint64(1)).any()
        assert not trie.lookup(context + np.uint64(1), word).any()
        heads, counts = np.unique(context, return_counts=True)
        assert (trie.successors(heads) == counts).all() and not trie.successors(heads + np.uint64(1)).any()


def test_empty_trie():
    none = np.zeros(0, np.uint64)
    trie = Trie(Trie.build(none, none, np.zeros(0)))
    assert not trie.lookup(np.array([1], np.uint64), np.array([2], np.uint64)).any()
    assert not trie.successors(np.array([1], np.uint64)).any()
