"""K4 with a gazetteer: longest non-overlapping matches through a trie kept as tables, a few depths at a time.

The trie of all entities is never in one place.  Its first two depths are bit tables (a megabyte each, whatever the gazetteer's
size): first words, pairs of first words, and entities of one word, by a checksum.  One narrow pass over the texts tests each
position against them, and from a plausible start the words of each length of up to ``WINDOW`` against a bit table of the whole
entities (``MOST_BITS`` bits at most).  Only runs of words that pass are rows, and these are joined with the entities.
Entities with more words hang below nodes at depth ``WINDOW``, twice that, and so on: from their own plausible starts ``WINDOW`` words are
let out, and the starts whose words equal such a node (a join) are the only ones for which more words are fetched.  A bit that
two keys share costs a row, never a result.

So texts do not move and no n-grams of theirs are made; what moves follows the matches, and a long entity costs nothing at
positions that do not begin like it.  Spark broadcasts a table of entities by its bytes, else both sides are shuffled on the words.

``frequent_runs`` counts runs of words the same way: pairs by their hashes first, then only runs whose pairs are all frequent.

Defined results: a null entity or one without words matches nothing; an entity listed with several labels gives the first in
sorted order; null token arrays and null tokens match nothing; each row is a text of its own, whatever its key.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantspark.operators.token_stats import slices
from slantspark.session import cut_lineage

WINDOW = 8
BITS = 1 << 23
MOST_BITS = 1 << 26


def _bits_of(places: DataFrame, size: int) -> np.ndarray:
    """A table of ``size`` bits with each ``place`` set; the driver gets size / 64 numbers at most."""
    words = (places.select(F.floor(F.col("place") / 64).alias("word"), F.pmod("place", F.lit(64)).cast("int").alias("at"))
             .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits")).collect())
    out = np.zeros(size // 64, np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _bit_table(keys: DataFrame, size: int = BITS) -> np.ndarray:
    """A table of ``size`` bits with the checksums of ``key`` set."""
    return _bits_of(keys.select(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(size)).alias("place")), size)


def _bits_for(n: int) -> int:
    """Bits for n keys, 16 each as long as that is not more than ``MOST_BITS``: fewer bits let more rows out, no result changes."""
    size = BITS
    while size < min(16 * n, MOST_BITS):
        size *= 2
    return size


def _checksum(key: str) -> int:
    return zlib.crc32(key.encode()) % BITS


class Starts:
    """The first two depths of the trie as bits, and the test of all positions of a batch."""

    def __init__(self, single: np.ndarray, first: np.ndarray, pair: np.ndarray):
        self.single, self.first, self.pair = (np.packbits(b) for b in (single, first, pair))

    @staticmethod
    def _has(bits: np.ndarray, place: int) -> bool:
        return bool(bits[place >> 3] >> (7 - (place & 7)) & 1)

    def plausible(self, words: list[str | None], seen: dict[str, int]) -> list[int]:
        """Positions at which an entity may start; ``seen`` remembers the words of a batch (2 alone, 1 as first word)."""
        kind = []
        for w in words:
            k = seen.get(w)
            if k is None:
                place = _checksum(w) if w is not None else None
                k = 0 if w is None else 2 * self._has(self.single, place) + self._has(self.first, place)
                seen[w] = k
            kind.append(k)
        last = len(words) - 1
        return [i for i, k in enumerate(kind) if k >= 2 or (k == 1 and i < last and words[i + 1] is not None
                                                            and self._has(self.pair, _checksum(f"{words[i]} {words[i + 1]}")))]


def _grams(rows: DataFrame, starts: Starts, whole: np.ndarray, lengths: list[int]) -> DataFrame:
    """(_row, start, n, entity): the runs of words from plausible starts whose checksum is that of an entity."""
    size, whole = len(whole), np.packbits(whole)

    def run(batches):
        for batch in batches:
            seen: dict = {}
            out = ([], [], [], [])
            for row, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in starts.plausible(toks or [], seen):
                    words = _unbroken(toks[i: i + lengths[-1]])
                    check, done = 0, 0
                    for n in lengths:
                        if n > len(words):
                            break
                        more = " ".join(words[done:n])
                        check, done = zlib.crc32((f" {more}" if done else more).encode(), check), n
                        if Starts._has(whole, check % size):
                            for column, value in zip(out, (row, i, n, " ".join(words[:n]))):
                                column.append(value)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["_row", "start", "n", "entity"])

    return rows.select("_row", "_toks").mapInArrow(run, "_row long, start int, n int, entity string")


def _starts(entities: DataFrame) -> Starts:
    """The first two depths of these entities' trie."""
    return Starts(_bit_table(entities.where("n = 1").select(F.col("entity").alias("key"))),
                  _bit_table(entities.where("n > 1").select(F.element_at("words", 1).alias("key"))),
                  _bit_table(entities.where("n > 1").select(F.array_join(F.slice("words", 1, 2), " ").alias("key"))))


def _windows(rows: DataFrame, starts: Starts) -> DataFrame:
    """(_row, start, words): the words from each plausible start, WINDOW at most."""
    def run(batches):
        for batch in batches:
            seen: dict = {}
            out = ([], [], [])
            for row, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in starts.plausible(toks or [], seen):
                    out[0].append(row)
                    out[1].append(i)
                    out[2].append(_unbroken(toks[i: i + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.string()))],
                                             ["_row", "start", "words"])

    return rows.select("_row", "_toks").mapInArrow(run, "_row long, start int, words array<string>")


def _unbroken(words: list) -> list:
    return words[: words.index(None)] if None in words else words


def _longer(rows: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """(_row, start, words) with ``width`` words at most, for the (_row, start) still followed."""
    lists = starts.groupBy("_row").agg(F.collect_list("start").alias("starts"))

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for row, toks, places in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for i in places:
                    out[0].append(row)
                    out[1].append(i)
                    out[2].append(_unbroken(toks[i: i + width]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.string()))],
                                             ["_row", "start", "words"])

    return rows.join(lists, "_row").select("_row", "_toks", "starts").mapInArrow(run, "_row long, start int, words array<string>")


def _matches(windows: DataFrame, entities: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(_row, start, n, entity, label) of the entities of ``shortest`` to ``longest`` words at the given starts."""
    grams = F.transform(F.sequence(F.lit(shortest), F.least(F.size("words"), F.lit(longest))),
                        lambda n: F.struct(n.alias("n"), F.array_join(F.slice("words", F.lit(1), n), " ").alias("entity")))
    rows = windows.where(F.size("words") >= shortest).select("_row", "start", F.explode(grams).alias("g")).select("_row", "start", "g.*")
    return rows.join(entities.where(F.col("n").between(shortest, longest)).select("entity", "label"), "entity").select("_row", "start", "n", "entity", "label")


def entity_matches(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """All matches (_row, start, n, entity, label), overlapping ones too, of a stored table ``rows`` (_row, _toks)."""
    words = F.filter(F.split("entity", " "), lambda w: w != "")
    listed = cut_lineage(gazetteer.where(F.col("entity").isNotNull()).select(words.alias("words"), F.array_join(words, " ").alias("entity"), "label")
                         .where(F.size("words") > 0).groupBy("entity").agg(F.any_value("words").alias("words"), F.min("label").alias("label"))
                         .select("entity", "label", "words", F.size("words").alias("n")), "gazetteer-entities")
    sizes = {r["n"]: r["count"] for r in listed.groupBy(F.least("n", F.lit(WINDOW + 1)).alias("n")).count().collect()}
    longest = (listed.agg(F.max("n").alias("n")).first()["n"] or 0) if WINDOW + 1 in sizes else max(sizes, default=0)
    short, width = listed.where(F.col("n") <= WINDOW), WINDOW
    lengths = sorted(n for n in sizes if n <= WINDOW) or [1]
    whole = _bit_table(short.select(F.col("entity").alias("key")), _bits_for(sum(sizes[n] for n in sizes if n <= WINDOW)))
    found = (_grams(rows, _starts(short), whole, lengths).join(short.select("entity", "label"), "entity")
             .select("_row", "start", "n", "entity", "label"))
    if longest > WINDOW:
        windows = cut_lineage(_windows(rows, _starts(listed.where(F.col("n") > WINDOW))), "gazetteer-starts")
    while width < longest:
        node = F.array_join(F.slice("words", 1, width), " ")
        nodes = listed.where(F.col("n") > width).select(node.alias("node")).distinct()
        alive = windows.where(F.size("words") >= width).select("_row", "start", node.alias("node")).join(nodes, "node", "leftsemi")
        windows = cut_lineage(_longer(rows, alive, 2 * width), "gazetteer-starts")
        found = found.unionByName(_matches(windows, listed, width + 1, 2 * width))
        width *= 2
    return found


def entity_spans(docs: DataFrame, key: str, tokens_col: str, gazetteer: DataFrame) -> DataFrame:
    """K4: (key, start, n, entity, label) for the longest non-overlapping matches, scanning each text left to right."""
    rows = docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(tokens_col).alias("_toks"))
    rows = cut_lineage(rows, "gazetteer-texts")
    picked = pick_longest(entity_matches(rows.select("_row", "_toks"), gazetteer))
    return (rows.select("_key", "_row").join(picked, "_row").select(F.col("_key").alias(key), "start", "n", "entity", "label"))


def pick_longest(matches: DataFrame) -> DataFrame:
    """(_row, start, n, entity, label): from left to right the longest match at each place that no picked one covers."""
    ordered = (matches.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("neg_n"), "entity", "label"))).alias("m")))

    def pick(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for row, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                free = 0
                for m in found:
                    if m["start"] >= free:
                        for column, value in zip(out, (row, m["start"], -m["neg_n"], m["entity"], m["label"])):
                            column.append(value)
                        free = m["start"] - m["neg_n"]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["_row", "start", "n", "entity", "label"])

    return ordered.mapInArrow(pick, "_row long, start int, n int, entity string, label string")


def _paired(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text of each word, hash of each word and the next, whether both lie in one text) of a slice of word lists."""
    sizes = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = texts.flatten()
    coded = words.dictionary_encode()
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = h[coded.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(sizes)), sizes)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(1))
    return words, text, (pair ^ (pair >> np.uint64(29))).view(np.int64), text[1:] == text[:-1]


def frequent_runs(texts: DataFrame, words_col: str, shortest: int, longest: int, count: int) -> DataFrame:
    """(entity, cnt): the runs of ``shortest`` (2 or more) to ``longest`` words, none null, that occur ``count`` times or more.

    A run is at most as frequent as each pair of words in it.  Pairs are counted by hash (8 bytes each, whatever the words), the
    frequent ones become a bit table, and only runs all of whose pairs are in it are counted by their words.
    """
    rows = texts.select(words_col)

    def pairs(batches):
        for batch in batches:
            for part in slices(batch.column(0)):
                _, _, pair, same = _paired(part)
                keys, n = np.unique(pair[same], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    frequent = cut_lineage(rows.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                           .where(F.col("n") >= count).select("pair"), "frequent-pairs")
    size = _bits_for(frequent.count())
    bits = np.packbits(_bits_of(frequent.select(F.pmod("pair", F.lit(size)).alias("place")), size))

    def runs(batches):
        for batch in batches:
            for part in slices(batch.column(0)):
                words, _, pair, same = _paired(part)
                place = pair & (size - 1)
                ok = same & (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                for n in range(shortest, longest + 1):
                    whole = ok[:max(len(ok) - n + 2, 0)].copy()
                    for k in range(1, n - 1):
                        whole &= ok[k: k + len(whole)]
                    at = np.flatnonzero(whole)
                    found = pc.binary_join_element_wise(*[words.take(pa.array(at + k)) for k in range(n)], " ").value_counts()
                    yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["entity", "n"])

    return (rows.mapInArrow(runs, "entity string, n long").groupBy("entity").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= count))
