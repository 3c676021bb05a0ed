"""The token features of whole batches of texts: each different token is judged once, all else is counting in NumPy.

The same rules as ``annotate.rule_code`` and ``annotate.token_flags`` (array lambdas judge every token anew, a hundred nodes of an
expression each).  Texts are taken a slice of about ``SLICE_TOKENS`` tokens at a time, a longer one alone; nothing moves.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from slantspark.functions import lexicon as L
from slantspark.operators import annotate as K

SLICE_TOKENS = 1 << 20
GROUPS = {"verbs": "V", "adjectives": "J", "adverbs": "R", "pronouns": "MKW", "conjunctions": "C", "nouns": "N"}
FLAGS = {"stops": K.FLAG_STOP, "puncts": K.FLAG_PUNCT, "digits": K.FLAG_DIGIT, "entity_tokens": K.FLAG_ENTITY}
FIELDS = ["tokens", "unique_tokens", "letters", *GROUPS, *FLAGS, "entity_runs", "entity_letters", "chunks", "chunk_chars",
          "unique_adjectives", "unique_adverbs"]

_LEXICON: dict[str, str] = {}
for _word, _tag in L.word_tag_pairs():
    _LEXICON.setdefault(_word, K.tag_group(_tag))
_PUNCT = {w: K.tag_group(t) for w, t in L.PUNCT_TAGS.items()}
_SUFFIXES = {last: [(s, K.tag_group(t)) for s, t in rules] for last, rules in K.suffix_groups().items()}
_STOP, _ENTITY = frozenset(L.STOP_WORDS), frozenset(L.ENTITY_WORDS) | frozenset(L.ENTITY_SIGNS)


def group(token: str) -> str:
    """``annotate.rule_code`` of one token."""
    found = _LEXICON.get(token)
    if found is not None:
        return found
    if "0" <= token[:1] <= "9":
        return K.tag_group("CD")
    if token in _PUNCT:
        return _PUNCT[token]
    if len(token) == 1 and token != "_" and unicodedata.category(token)[0] not in "LN":
        return K.tag_group("SYM")
    if len(token) >= 3:
        for suffix, letter in _SUFFIXES.get(token[-1], ()):
            if token.endswith(suffix) and len(token) >= len(suffix) + 2:
                return letter
    return K.tag_group("NN")


def flags(token: str) -> int:
    """The bits of ``annotate.token_flags`` of one token."""
    punct = (len(token) == 1 or token[:1] == "_") and all(unicodedata.category(c)[0] == "P" for c in token)
    entity = "0" <= token[:1] <= "9" or token in _ENTITY
    return K.FLAG_STOP * (token in _STOP) + K.FLAG_PUNCT * punct + K.FLAG_DIGIT * token.isdecimal() + K.FLAG_ENTITY * entity


def slices(tokens: pa.Array) -> Iterator[pa.Array]:
    """The lists in pieces of about ``SLICE_TOKENS`` entries, a longer list alone."""
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(tokens):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_TOKENS, side="right")))
        yield tokens.slice(at, stop - at)
        at = stop


def _runs(inside: np.ndarray, text: np.ndarray) -> np.ndarray:
    """First places of the runs of ``inside`` tokens within one text."""
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
    return np.flatnonzero(first)


def _counted(tokens: pa.Array) -> dict[str, np.ndarray]:
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    letters = np.array([group(w) for w in words], dtype="U1")
    bits = np.array([flags(w) for w in words], dtype=np.int64)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    n, text = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)

    def total(of_word: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_word[at], dtype=np.int64)])
        return sums[ends] - sums[ends - sizes]

    out = {"tokens": sizes, "letters": total(lengths)}
    out |= {name: total(np.isin(letters, list(of))) for name, of in GROUPS.items()}
    out |= {name: total(bits & bit > 0) for name, bit in FLAGS.items()}
    entity = bits & K.FLAG_ENTITY > 0
    out["entity_runs"] = np.bincount(text[_runs(entity[at], text)], minlength=n)
    out["entity_letters"] = total(lengths * entity)

    within, head = (letters >= K.NP_FIRST) & (letters <= K.NP_LAST), (letters >= K.NP_HEAD_FIRST) & (letters <= K.NP_LAST)
    inside = within[at]
    first = _runs(inside, text)
    chunk_text, chars = text[first], np.zeros(0)
    if len(first):
        place = np.cumsum(inside)[first] - 1                   # where each run begins among the tokens inside
        chars = np.add.reduceat((lengths[at] + 1)[inside], place) - 1
        real = np.logical_or.reduceat(head[at][inside], place)
        chunk_text, chars = chunk_text[real], chars[real]
    out["chunks"] = np.bincount(chunk_text, minlength=n)
    out["chunk_chars"] = np.bincount(chunk_text, weights=chars, minlength=n).astype(np.int64)

    pairs = pa.array(text * max(len(words), 1) + at).unique().to_numpy()  # the different tokens of each text
    whose, word = np.divmod(pairs, max(len(words), 1))
    out["unique_tokens"] = np.bincount(whose, minlength=n)
    for name, letter in (("unique_adjectives", "J"), ("unique_adverbs", "R")):
        out[name] = np.bincount(whose[(letters == letter)[word]] if len(words) else whose, minlength=n)
    return out


def count_batch(tokens: pa.Array) -> pa.Array:
    """One struct of ``FIELDS`` for each list of tokens; null for null."""
    parts = [_counted(part) for part in slices(tokens)]
    columns = [pa.array(np.concatenate([p[name] for p in parts]) if parts else np.zeros(0), pa.int32()) for name in FIELDS]
    return pa.StructArray.from_arrays(columns, names=FIELDS, mask=tokens.is_null())


def token_stats(tokens: Column) -> Column:
    """The struct of ``FIELDS`` of a token array."""
    return F.arrow_udf(count_batch, ", ".join(f"{name} int" for name in FIELDS))(tokens)
