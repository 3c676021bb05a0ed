"""Benchmark decontamination by winnowing: keep the least k-gram hash of every window, join, extend the hits.

With k-grams of 5 words and windows of 6 k-grams, every shared span of 10 words shares a kept k-gram with its position, so
no occurrence of a 10-word item window is missed.  Items shorter than 10 words are one window; for each such length the
k-gram is that many words and every one is kept.  A kept k-gram found on both sides is extended: each 10-word window of the
item that holds it is compared at its place in the document, and the words of equal windows are hit.

Two ways give the same rows.  While the benchmark's kept k-grams take at most ``broadcast_bytes`` (measured), they go to
every task and each document is settled in one narrow pass.  Beyond that, document and item fingerprints are joined by a
shuffle on the hash, and candidate (document, item) pairs are extended and merged per document.

Words are compared by 64-bit hashes (xxh64).  Defined results: a null or empty text has no words; an item without words never occurs; equal
items each count by their id; repeated documents each give their row in the narrow way.  Very long texts are read whole.
Only id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, fresh_name, map_arrow, per_worker, slices, sliding_min, word_table

WORDS = word_table(True)
CACHED_WORDS = 150_000
SLICE_BYTES = 4 << 20


class _Hashes(dict):
    """Word -> 64-bit hash, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def known_hashes() -> _Hashes:
    """The worker's one cache of word hashes, shared by all operators that run in it."""
    return per_worker(("word-hashes",), _Hashes)


def word_hashes(text: bytes, known: _Hashes) -> np.ndarray:
    return np.array([known[w] for w in text.translate(WORDS).split()], np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash per k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j: j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def kept_positions(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of grams that are the least of some window of ``window`` grams (ties all kept); all of a shorter text."""
    n = len(grams)
    if n <= window:
        return np.flatnonzero(grams == grams.min()) if n else np.zeros(0, np.int64)
    low = sliding_min(grams, window)
    reach = np.zeros(n, np.uint64)  # the largest window minimum over the windows that hold a position
    for j in range(window):
        np.maximum(reach[j: j + len(low)], low, out=reach[j: j + len(low)])
    return np.flatnonzero(grams == reach)


class Plan:
    """Gram length and window for items of a given number of words."""

    def __init__(self, span: int, k: int):
        self.span, self.k = span, k

    def of(self, n_words: int) -> tuple[int, int, int]:
        """(class, k, window): the class is the span an occurrence has."""
        return (self.span, self.k, self.span - self.k + 1) if n_words >= self.span else (n_words, n_words, 1)


class Fingerprints:
    """Kept grams of the benchmark items, sorted by hash for look-ups, with the items' word hashes."""

    def __init__(self, items: list[tuple[object, np.ndarray]], plan: Plan):
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(w) for _, w in items], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        self.plan, self.tables = plan, {}
        parts: dict[int, list] = {}
        for number, (_, w) in enumerate(items):
            if len(w):
                span, k, window = plan.of(len(w))
                grams = gram_hashes(w, k)
                at = kept_positions(grams, window)
                parts.setdefault(span, []).append((grams[at], np.full(len(at), number), at))
        for span, found in parts.items():
            h, number, at = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            self.tables[span] = (h[order], number[order], at[order])

    def hits(self, doc: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item number, starts of its windows' occurrences) with the span of each item: every occurrence in the document."""
        out = []
        for span, (h, number, at) in self.tables.items():
            k, window = (self.plan.k, span - self.plan.k + 1) if span == self.plan.span else (span, 1)
            grams = gram_hashes(doc, k)
            # An occurrence lies inside one run of document words, so windows over the document keep a gram of each.
            where = kept_positions(grams, window) if len(grams) >= window else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(h, grams[where], side="left"), np.searchsorted(h, grams[where], side="right")
            some = hi > lo
            if not some.any():
                continue
            where, lo, hi = where[some], lo[some], hi[some]
            seen: dict[tuple[int, int], list[int]] = {}
            for w, a, b in zip(where.tolist(), lo.tolist(), hi.tolist()):
                for j in range(a, b):
                    seen.setdefault((int(number[j]), w - int(at[j])), []).append(w)
            by_item: dict[int, set[int]] = {}
            for (item, shift), places in seen.items():
                words = self.words[self.first[item]: self.first[item + 1]]
                starts = np.unique(np.concatenate([np.arange(w + k - span, w + 1) for w in places]))
                starts = starts[(starts >= 0) & (starts + span <= len(doc)) & (starts >= shift) & (starts - shift + span <= len(words))]
                if len(starts):
                    steps = np.arange(span)
                    equal = (doc[starts[:, None] + steps] == words[starts[:, None] - shift + steps]).all(axis=1)
                    by_item.setdefault(item, set()).update(starts[equal].tolist())
            out += [(item, span, np.array(sorted(found), np.int64)) for item, found in by_item.items() if found]
        return out


def _covered(n: int, found: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    for _, span, starts in found:
        np.add.at(change, starts, 1)
        np.add.at(change, starts + span, -1)
    return np.cumsum(change[:-1]) > 0


def _items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _read_items(items: DataFrame, id_col: str, text_col: str) -> list[tuple[str, np.ndarray]]:
    known = _Hashes()
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toArrow()
    return [(i, word_hashes(t, known)) for i, t in zip(rows.column(0).to_pylist(), binary_texts(rows.column(1).combine_chunks())) if i is not None]


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", span: int = 10, k: int = 5, broadcast_bytes: int = 64 << 20, clean: bool = False) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    With ``clean``, the documents come back instead, with all their columns, those with a hit removed.
    """
    size = items.agg(F.sum(F.octet_length(F.col(item_text))).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:
        return _narrow(docs, items, id_col, text_col, item_id, item_text, Plan(span, k), clean)
    return _shuffled(docs, items, id_col, text_col, item_id, item_text, Plan(span, k), clean)


def _narrow(docs, items, id_col, text_col, item_id, item_text, plan, clean) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_read_items(items, item_id, item_text))  # at most broadcast_bytes of text
    state = []

    def settle(texts: pa.Array):
        if not state:
            state.append(Fingerprints(shared.value, plan))
        listed, known = state[0], known_hashes()
        for text in binary_texts(texts):
            words = word_hashes(text, known)
            found = listed.hits(words)
            yield len(words), int(_covered(len(words), found).sum()), sorted({listed.ids[i] for i, _, _ in found})

    if clean:
        schema = docs.schema
        place = docs.columns.index(text_col)

        def keep(batches):
            for batch in batches:
                for part in slices(batch, place, SLICE_BYTES):
                    yield part.filter(pa.array([hit == 0 for _, hit, _ in settle(part.column(place))], pa.bool_()))

        return docs.mapInArrow(keep, schema)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, 1, SLICE_BYTES):
            n, hit, ids = (list(x) for x in zip(*settle(part.column(1))))
            yield {"doc_id": part.column(0), "n_words": n, "n_hit": hit, "n_items": [len(x) for x in ids],
                   "items_sha256": [_items_digest(x) for x in ids], "contaminated": [x > 0 for x in hit]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, RESULT)


def fingerprints(df: DataFrame, key: str, text_col: str, plan: Plan, spans: list[int], as_items: bool) -> DataFrame:
    """(key, span, fp): the distinct kept grams of each text, for each span an item may have."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known = known_hashes()
        keys, kinds, fps = [], [], []
        for row, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
            words = word_hashes(text, known)
            for span in ([plan.of(len(words))[0]] if as_items else spans):
                k, window = (plan.k, span - plan.k + 1) if span == plan.span else (span, 1)
                grams = gram_hashes(words, k) if span else np.zeros(0, np.uint64)
                got = np.unique(grams[kept_positions(grams, window)]) if len(grams) >= window else grams[:0]
                keys += [row] * len(got)
                kinds += [span] * len(got)
                fps.append(got)
        yield {"k": pa.array(keys, batch.schema.field(0).type), "span": kinds, "fp": np.concatenate(fps).view(np.int64) if fps else []}

    kind = dict(df.dtypes)[key]
    return map_arrow(df.select(key, text_col), run, f"k {kind}, span long, fp long").withColumnRenamed("k", key)


def text_key(text) -> Column:
    """128 bits of a text as a string; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text)))


def _shuffled(docs, items, id_col, text_col, item_id, item_text, plan, clean) -> DataFrame:
    # What is found depends on the text alone, so equal texts are one key, whatever their ids.
    key = text_key(F.col(text_col))
    docs_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    texts = docs_in.select("key", "text").dropDuplicates(["key"])
    listed = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("item_text")).where(F.col("item").isNotNull())
    item_fps = fingerprints(listed, "item", "item_text", plan, [], True)
    spans = [r["span"] for r in item_fps.select("span").distinct().collect()]  # at most ``span`` numbers
    doc_fps = fingerprints(docs_in.select("key", "text"), "key", "text", plan, spans, False).withColumnRenamed("k", "key")
    pairs = doc_fps.join(item_fps, ["span", "fp"]).select("key", "item").distinct()

    def extend(batch: pa.RecordBatch) -> Iterator[dict]:
        known = known_hashes()
        out = {"key": [], "item": [], "spans": []}
        for d, item, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_texts(batch.column(2)), binary_texts(batch.column(3))):
            found = Fingerprints([(item, word_hashes(b, known))], plan).hits(word_hashes(a, known))
            if found:
                out["key"].append(d)
                out["item"].append(item)
                out["spans"].append([[int(s), int(s) + span] for _, span, starts in found for s in starts])
        yield out

    matched = map_arrow(pairs.join(listed, "item").join(texts, "key").select("key", "item", "text", "item_text"), extend,
                        "key string, item string, spans array<array<long>>")
    marked = (matched.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("ids"), F.flatten(F.collect_list("spans")).alias("spans")))

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        n = [len(t.translate(WORDS).split()) for t in binary_texts(batch.column(1))]
        hits = []
        for size, spans_ in zip(n, batch.column(3).to_pylist()):
            change = np.zeros(size + 1, np.int64)
            for a, b in spans_ or []:
                change[a] += 1
                change[b] -= 1
            hits.append(int((np.cumsum(change[:-1]) > 0).sum()))
        ids = [x or [] for x in batch.column(2).to_pylist()]
        yield {"doc_id": batch.column(0), "n_words": n, "n_hit": hits, "n_items": [len(x) for x in ids],
               "items_sha256": [_items_digest(x) for x in ids], "contaminated": [h > 0 for h in hits]}

    if clean:
        bad = fresh_name(docs, "bad_key")
        return docs.join(marked.select(F.col("key").alias(bad)), key == F.col(bad), "left_anti")
    return map_arrow(docs_in.join(marked, "key", "left").select("doc_id", "text", "ids", "spans"), count, RESULT)
