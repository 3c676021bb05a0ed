"""Bigram language model in Elias-Fano tries, counted and queried by one exchange.

Model: interpolated absolute discounting.  p(w|h) = max(c(hw) - D, 0) / c(h) + D * N1+(h.) / c(h) * p1(w), and
p1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)); a text is begun by the end token of the text before.

Trie of one shard of contexts: the sorted contexts (Elias-Fano); pointers to each context's successors (Elias-Fano, monotone by
nature); successor ids, made monotone by adding the last value of the range before (Elias-Fano); one quantised
log-probability byte per successor with a codebook of 255 equal-frequency bins.  A query finds its context, takes the
range's base from the value before it and searches the successor of base + word inside the range, block by block, so
only one block is decoded at a time.  ``Trie.open`` maps a written trie into memory; a shard task views its buffer.

On the cluster: the texts are cut into batches of bounded bytes.  A batch asks the word shards for (id, count) of its distinct
words, sending its training counts along; then it asks the context shards for the codes of its distinct bigrams, again
with its training counts.  A shard sums the counts of all batches, builds its part of the model and answers every packet in
order.  So every count covers all training texts, a hot word or bigram costs one entry per batch, contexts that hold much
of the corpus are split over shards by successor (their N1+ are summed), and no task holds the model or a group of rows.
Exchanged arrays are sorted and compressed.

Words are told apart by 64-bit hashes.  Defined results: a null or empty text has the end token only; a null id is never
held out; repeated rows count and are scored each; texts are read whole; without training rows every probability is 1.
Only the id, text and training columns are read.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, cut_lineage, partitions_for, release_memory
from .elias_fano import EliasFano

DISCOUNT = 0.75
BATCH_BYTES = 8 << 20
BLOCK = 1 << 16
END_HASH = 0  # the end token's place among word hashes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as byte planes, compressed; each is narrowed to the bytes its largest value needs."""
    out = []
    for a in arrays:
        a = np.asarray(a, np.uint64)
        width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
        out.append(struct.pack("<QB", len(a), width) + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<QB", raw, at)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(full.view("<u8").ravel())
        at += 9 + n * width
    return out


class Trie:
    """Levels of one shard over any buffer."""

    def __init__(self, buffer):
        sizes = struct.unpack_from("<IIII", buffer, 0)
        at = [16]
        for s in sizes:
            at.append(at[-1] + s)
        self.contexts, self.pointers, self.words = (EliasFano.from_buffer(buffer, a) for a in at[:3])
        self.codes = np.frombuffer(buffer, np.uint8, self.words.n, at[3])
        self.codebook = np.frombuffer(buffer, "<f4", 256, at[4])

    @classmethod
    def open(cls, path: str) -> "Trie":
        """Map a written trie into memory; its levels stay on disk until touched."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, log_prob: np.ndarray) -> bytes:
        """``context`` and ``word`` sorted and distinct as pairs; log10 probabilities beside them."""
        heads, first = np.unique(context, return_index=True)
        ends = np.append(first[1:], len(context)) if len(context) else np.zeros(0, np.int64)
        last = word[ends - 1].astype(np.uint64) + np.uint64(1) if len(context) else np.zeros(0, np.uint64)
        base = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.uint64) if len(heads) else np.zeros(0, np.uint64)
        rising = word.astype(np.uint64) + np.repeat(base, ends - first)
        order = np.argsort(log_prob, kind="stable")
        bins = np.minimum(np.arange(len(order)) * 255 // max(len(order), 1), 254)
        edges = log_prob[order[np.searchsorted(bins, np.arange(255), side="left").clip(0, max(len(order) - 1, 0))]] if len(order) else np.zeros(255)
        edges = np.unique(edges)
        codes = (np.searchsorted(edges, log_prob, side="right") - 1).clip(0).astype(np.uint8) + np.uint8(1)
        total = np.bincount(codes, weights=log_prob, minlength=256)
        book = (total / np.maximum(np.bincount(codes, minlength=256), 1)).astype("<f4")
        parts = [EliasFano.encode(heads), EliasFano.encode(np.append(first, len(context))), EliasFano.encode(rising), codes.tobytes()]
        return struct.pack("<IIII", *map(len, parts)) + b"".join(parts) + book.tobytes()

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of sorted (context, word) queries; 0 where the pair is not in the trie."""
        out = np.zeros(len(context), np.uint8)
        if not self.words.n or not len(context):
            return out
        heads = self.contexts.values()
        at = np.minimum(np.searchsorted(heads, context), len(heads) - 1)
        pointers = self.pointers.values().astype(np.int64)
        starts, stops = pointers[at], pointers[at + 1]
        used = np.unique(starts[starts > 0])
        before = self.words.select(used - 1) if len(used) else np.zeros(0, np.uint64)
        base = np.zeros(len(context), np.uint64)
        base[starts > 0] = before[np.searchsorted(used, starts[starts > 0])] + np.uint64(1)
        target = base + word.astype(np.uint64)
        stays = heads[at] == context
        for a in range(0, self.words.n, BLOCK):
            block = self.words.values(a, a + BLOCK)
            some = np.flatnonzero(stays & (starts < a + BLOCK) & (stops > a) & (target >= block[0]) & (target <= block[-1]))
            if len(some):
                place = np.searchsorted(block, target[some])
                good = (block[place] == target[some]) & (place + a >= starts[some]) & (place + a < stops[some])
                out[some[good]] = self.codes[a + place[good]]
        return out

    def successors(self, context: np.ndarray) -> np.ndarray:
        """How many different words follow each context."""
        heads = self.contexts.values()
        if not len(heads):
            return np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(heads, context), len(heads) - 1)
        pointers = self.pointers.values().astype(np.int64)
        return np.where(heads[at] == context, pointers[at + 1] - pointers[at], 0)


def _batches(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of a batch: shard -1 holds its texts as word numbers, shard s the hashes and training counts of its words there."""

    def run(batches):
        from pyspark import TaskContext

        task, number, size = TaskContext.get().partitionId(), 0, 0
        ids, nulls, train, lengths, tokens, known = [], [], [], [], [], {b"": 0}

        def flush():
            words = np.concatenate(tokens)
            flags = np.repeat(np.array(train, bool), lengths)
            hashes = np.array([END_HASH, *map(xxhash.xxh64_intdigest, list(known)[1:])], np.uint64)
            counts = np.bincount(words[flags], minlength=len(known))
            shard = hashes % np.uint64(shards)
            order = np.lexsort((hashes, shard))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            rank = np.argsort(np.argsort(-np.bincount(words, minlength=len(known)), kind="stable"), kind="stable")
            by_rank = np.empty(len(rank), np.int64)
            by_rank[rank] = place  # frequent words get small numbers, which compress
            key = (task << 32) | number
            yield key, -1, pack(np.array(ids, np.int64).view(np.uint64), np.array(nulls), np.array(train), np.array(lengths), rank[words], by_rank)
            cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            for s in np.flatnonzero(np.diff(cuts)):
                some = order[cuts[s]: cuts[s + 1]]
                yield key, int(s), pack(np.diff(hashes[some], prepend=np.uint64(0)), counts[some])

        def rows(found):
            key, shard, data = zip(*found)
            return pa.RecordBatch.from_pydict({"batch": pa.array(key, pa.int64()), "shard": pa.array(shard, pa.int32()), "data": pa.array(data, pa.binary())})

        for batch in batches:
            flags = batch.column(2).to_pylist()
            for n, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)))):
                found = text.lower().split()
                ids.append(doc or 0)
                nulls.append(doc is None)
                train.append(bool(flags[n]))
                lengths.append(len(found) + 1)
                new = known.setdefault
                tokens.append(np.array([new(w, len(known)) for w in found] + [0], np.int64))
                size += len(text) + 64
                if size >= BATCH_BYTES:
                    yield rows(flush())
                    release_memory()
                    ids, nulls, train, lengths, tokens, known, size, number = [], [], [], [], [], {b"": 0}, 0, number + 1
        if ids:
            yield rows(flush())

    return docs.mapInArrow(run, "batch long, shard int, data binary")


def _by_shard(packets: DataFrame, answer, parts: int) -> DataFrame:
    """Answer the packets of one shard together: ``answer(shard, datas) -> (replies, totals)``; a row per packet, and one per
    shard (batch -1) with its totals."""
    dealt = packets.repartition(parts, "shard").sortWithinPartitions("shard", "batch")

    def run(batches):
        shard, keys, datas = None, [], []

        def settle():
            replies, totals = answer(shard, datas)
            n = len(keys)
            return pa.RecordBatch.from_pydict({
                "batch": pa.array([*keys, -1], pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int32()),
                "data": pa.array([*replies, None], pa.binary()),
                "n": pa.array([None] * n + [totals[0]], pa.int64()), "v": pa.array([None] * n + [totals[1]], pa.int64())})

        for batch in batches:
            for key, s, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if s != shard and keys:
                    yield settle()
                    keys, datas = [], []
                    release_memory()
                shard = s
                keys.append(key)
                datas.append(data)
        if keys:
            yield settle()

    return dealt.mapInArrow(run, "batch long, shard int, data binary, n long, v long")


def _answer_words(shards: int):
    def answer(shard, datas):
        asked = [unpack(d) for d in datas]
        hashes = [np.cumsum(h, dtype=np.uint64) for h, _ in asked]
        every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c for _, c in asked]).astype(np.float64), minlength=len(every)).astype(np.int64)
        known = total > 0
        number = np.where(known, (np.cumsum(known) - 1) * shards + shard + 1, 0)  # 0: not in training
        replies, at = [], 0
        for h in hashes:
            some = inverse[at: at + len(h)]
            at += len(h)
            replies.append(pack(number[some], total[some]))
        return replies, (int(total.sum()), int(known.sum()))

    return answer


def _answer_pairs(shard, datas):
    """Sum the training counts of the shard's bigrams, build its trie and answer codes and successor counts."""
    heads_of, parts = [], []
    for d in datas:
        heads, sizes, word, count, total = unpack(d)
        sizes = sizes.astype(np.int64)
        heads_of.append(heads)
        parts.append((np.repeat(heads, sizes), word, count.astype(np.uint32), np.repeat(total, sizes)))
    pair_cuts, head_cuts = np.cumsum([0, *[len(p[1]) for p in parts]]), np.cumsum([0, *map(len, heads_of)])
    context, word, count, total = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((word, context))
    context, word, count, total = context[order], word[order], count[order], total[order]
    differs = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]) if len(context) else np.zeros(0, bool)
    start = np.flatnonzero(differs)
    sums = np.add.reduceat(count.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    seen = sums > 0
    c, w, n = context[start][seen], word[start][seen], total[start][seen].astype(np.float64)
    trie = Trie(Trie.build(c, w, np.log10((sums[seen] - DISCOUNT) / np.maximum(n, 1))))
    # One search for all packets: the distinct pairs in order, then back to each packet's places.
    codes = np.empty(len(order), np.uint8)
    codes[order] = trie.lookup(context[start], word[start])[np.cumsum(differs) - 1]
    heads, place = np.unique(np.concatenate(heads_of), return_inverse=True)
    after = trie.successors(heads)[place]
    book = trie.codebook.tobytes()
    replies = [struct.pack("<I", len(book)) + book + pack(codes[a:b], after[x:y])
               for a, b, x, y in zip(pair_cuts, pair_cuts[1:], head_cuts, head_cuts[1:])]
    return replies, (int(sums.sum()), int(seen.sum()))


def _gathered(replies: DataFrame, name: str) -> DataFrame:
    """One row per batch with its answers in shard order; a batch's answers are bounded by the batch."""
    return replies.where("batch >= 0").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("shard", "data"))).alias(name))


def _texts_of(data: bytes):
    ids, nulls, train, lengths, ranks, by_rank = unpack(data)
    return ids.view(np.int64), nulls.astype(bool), train.astype(bool), lengths.astype(np.int64), by_rank.astype(np.int64)[ranks.astype(np.int64)]


def _words_of(packets) -> tuple[np.ndarray, np.ndarray]:
    """(id, training count) of the batch's words; words are numbered in (shard, hash) order, as the answers come."""
    got = [unpack(p["data"]) for p in packets]
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)


def _pairs_of(words: np.ndarray, lengths: np.ndarray, number: np.ndarray):
    """Distinct bigrams of known words: (context word, word) sorted by ids, and the pair (or -1) of every token."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(lengths) - lengths] = words[lengths[0] - 1]  # the end token
    both = (number[before] > 0) & (number[words] > 0)
    rank = np.argsort(np.argsort(number, kind="stable"), kind="stable").astype(np.int64)
    back = np.argsort(rank)
    keys, inverse = np.unique(rank[before[both]] * len(number) + rank[words[both]], return_inverse=True)
    pair = np.full(len(words), -1, np.int64)
    pair[both] = inverse
    return back[keys // len(number)], back[keys % len(number)], pair, before


def _packets(number, count, before, first, second, total: int, shards: int):
    """Per context shard: (shard, contexts asked for, pairs asked for, pairs per context).

    A context that fills more than a quarter of a shard is split over several by its successors; each of them is asked for
    its part of the context's successors, whether or not the batch has a pair there.
    """
    split = np.clip(np.ceil(count * 4.0 * shards / max(total, 1)), 1, shards).astype(np.int64)
    home = ((number * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(31)) % np.uint64(shards)).astype(np.int64)
    used = np.unique(before)
    used = used[number[used] > 0]
    used = used[np.argsort(number[used], kind="stable")]
    heads = np.repeat(used, split[used])
    part = np.arange(len(heads)) - np.repeat(np.cumsum(split[used]) - split[used], split[used])
    head_shard = (home[heads] + part) % shards
    spread = ((number[second] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % split[first].astype(np.uint64)).astype(np.int64)
    pair_shard = (home[first] + spread) % shards
    by_head, by_pair = np.argsort(head_shard, kind="stable"), np.argsort(pair_shard, kind="stable")
    head_cuts = np.searchsorted(head_shard[by_head], np.arange(shards + 1))
    pair_cuts = np.searchsorted(pair_shard[by_pair], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(head_cuts)).tolist():
        h, p = heads[by_head[head_cuts[s]: head_cuts[s + 1]]], by_pair[pair_cuts[s]: pair_cuts[s + 1]]
        owner = number[first[p]]
        yield s, h, p, np.searchsorted(owner, number[h], side="right") - np.searchsorted(owner, number[h], side="left")


def _ask_pairs(batches: DataFrame, total: int, shards: int) -> DataFrame:
    def run(rows):
        for batch in rows:
            for key, data, packets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                _, _, train, lengths, words = _texts_of(data)
                number, count = _words_of(packets.as_py())
                first, second, pair, before = _pairs_of(words, lengths, number)
                flags = np.repeat(train, lengths) & (pair >= 0)
                times = np.bincount(pair[flags], minlength=len(first))
                found = [(s, pack(number[h], sizes, number[second[p]], times[p], count[h]))
                         for s, h, p, sizes in _packets(number, count, before, first, second, total, shards)]
                yield pa.RecordBatch.from_pydict({"batch": pa.array([key] * len(found), pa.int64()), "shard": pa.array([s for s, _ in found], pa.int32()),
                                                  "data": pa.array([d for _, d in found], pa.binary())})
                del first, second, pair, before, words, found
                release_memory()

    return batches.mapInArrow(run, "batch long, shard int, data binary")


RESULT = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _score(batches: DataFrame, total: int, distinct: int, shards: int) -> DataFrame:
    def run(rows):
        for batch in rows:
            for data, packets, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids, nulls, train, lengths, words = _texts_of(data)
                number, count = _words_of(packets.as_py())
                first, second, pair, before = _pairs_of(words, lengths, number)
                replies = {a["shard"]: a["data"] for a in answers.as_py() or []}
                seen, after = np.zeros(len(first)), np.zeros(len(number), np.int64)
                for s, h, p, _ in _packets(number, count, before, first, second, total, shards):
                    size = struct.unpack_from("<I", replies[s])[0]
                    book = np.frombuffer(replies[s], "<f4", size // 4, 4).astype(np.float64)
                    codes, successors = unpack(replies[s][4 + size:])
                    seen[p] = np.where(codes > 0, 10.0 ** book[codes.astype(np.int64)], 0.0)
                    after[h] += successors.astype(np.int64)  # a context stands once in a packet
                lower = (count + 0.5) / (total + 0.5 * (distinct + 1))
                weight = np.where(count > 0, DISCOUNT * after / np.maximum(count, 1), 1.0)
                p = lower[words] * weight[before]
                p[pair >= 0] += seen[pair[pair >= 0]]
                starts = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, mask=nulls), "train": pa.array(train), "n_tokens": pa.array(lengths),
                    "n_known": pa.array(np.add.reduceat((count[words] > 0).astype(np.int64), starts)),
                    "base_score": pa.array(np.add.reduceat(np.log10(lower)[words], starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts))})
                del first, second, pair, before, words, replies, seen, p
                release_memory()

    return batches.mapInArrow(run, RESULT)


def fit_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows where ``train``."""
    shards = parts = partitions_for(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    batches = cut_lineage(_batches(texts, shards), "lm-batches")
    held = batches.where("shard = -1").select("batch", "data")
    words = cut_lineage(_by_shard(batches.where("shard >= 0"), _answer_words(shards), parts), "lm-words")
    facts = words.where("batch = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    total, distinct = int(facts["n"]), int(facts["v"])
    joined = held.join(_gathered(words, "words"), "batch")
    pairs = _by_shard(_ask_pairs(joined.select("batch", "data", "words"), total, shards), _answer_pairs, parts)
    pairs = cut_lineage(pairs.drop("n", "v"), "lm-pairs")
    scored = _score(joined.join(_gathered(pairs, "pairs"), "batch", "left").select("data", "words", "pairs"), total, distinct, shards)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score")
