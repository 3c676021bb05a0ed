"""Token-ID files: one concatenated id array with Elias-Fano document boundaries.

Format: a Parquet folder whose rows are blocks, written by Spark's committed writer (a lost executor's task is written
again, never half).  ``shard`` ranges follow ascending doc_id, and so do the part files; inside a shard, ``block`` counts up.  A block holds
``n_docs``, ``doc_ids`` (little-endian int64), ``bounds`` (Elias-Fano ends of its documents in its id array) and ``ids``
(the id array, little-endian unsigned 16-bit where the vocabulary allows, else 32-bit; ``width`` says which).  Document i
of a block lies between ``select(i - 1)`` and ``select(i)``; no table of 64-bit offsets is stored.

Defined results: a null text is empty and gives only the end id.  Rows with a null doc_id come first.  Rows with one
doc_id keep all their rows, in the order of their id arrays.  An empty table writes no block.  Documents are never split, so a block
holds at least one whole document, however long.  Only the id and text columns are read.  The text of a special token of the
file is spelt out in pieces; with ``special_ids`` it gives that token's one id, as is the library's own default.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, partitions_for, per_worker, scratch_path, slices
from .elias_fano import EliasFano

BLOCK_IDS = 1 << 20
CACHED_WORDS = 300_000
SLICE_BYTES = 8 << 20


# A space that white space or the end follows.
_GLUED = " ([\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"


class ByteBpe:
    """Whole-text encoding with a ``tokenizers`` file, caching the ids of space-separated words.

    The byte-level pre-tokeniser always starts a token at a single space that a non-space follows, whatever stands before,
    so the text may be cut there and equal pieces share one encoding; texts with a space before white space or the end,
    and texts that hold an added token, are encoded whole.  Pieces of many texts are numbered at once and their ids gathered by arrays.  New pieces are encoded many to a line; as the tokens of a line spell its bytes, the pieces' ends
    are found again by adding up token lengths.
    """

    def __init__(self, definition: bytes, end_id: int, dtype: str, special_ids: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.tokenizer.encode_special_tokens = not special_ids
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if special_ids or not x.special]
        self.added = "|".join(map(re.escape, added))
        self.line = 1 if any(" " in x for x in added) else 200  # words of different texts must not spell an added token
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # one character of a byte-level token stands for one byte
        self.dtype, self.end = dtype, np.array([end_id], dtype).tobytes()
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        width = np.dtype(self.dtype).itemsize
        step = self.line
        lines = [(b" " + b" ".join(new[a: a + step])).decode() for a in range(0, len(new), step)]
        for a, line in zip(range(0, len(new), step), self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(line.ids, self.dtype)
            ends = np.cumsum([len(p) + 1 for p in new[a: a + step]])
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="left") + 1
            raw, start = ids.tobytes(), 0
            for p, cut in zip(new[a: a + step], (cuts * width).tolist()):
                self.cache[p] = raw[start:cut]
                start = cut

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that follow a space, from the cache or learnt."""
        if len(self.cache) > CACHED_WORDS:  # two generations: words still in use come back from the older one
            self.cache, self.older = {}, self.cache
        known, older = self.cache, self.older
        found = list(map(known.get, words))
        if None in found:
            new = []
            for p in [p for p, ids in zip(words, found) if ids is None]:
                ids = older.get(p)
                if ids is None:
                    new.append(p)
                else:
                    known[p] = ids
            self._learn(new)
            found = [known[p] if ids is None else ids for p, ids in zip(words, found)]
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids and end id of every text (null: empty), as packed integers."""
        n, dtype = len(texts), np.dtype(self.dtype)
        texts = pc.fill_null(texts, "")
        glued = pc.match_substring_regex(texts, _GLUED)
        if self.added:
            glued = pc.or_(glued, pc.match_substring_regex(texts, self.added))
        parts = pc.split_pattern(pc.if_else(glued, "", texts), " ")
        rows = parts.offsets.to_numpy().astype(np.int64)
        pieces = parts.values.dictionary_encode()
        codes, words = pieces.indices.to_numpy(), pieces.dictionary.cast(pa.binary()).to_pylist()
        # Units: a text's first piece (no space before it), its words, the end id.
        first = parts.values.take(pa.array(rows[:-1])).to_pylist()
        whole = [t if g else f for t, g, f in zip(pc.if_else(glued, texts, "").to_pylist(), glued.to_pylist(), first)]
        heads = [np.array(e.ids, dtype).tobytes() for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        used = np.zeros(len(words), bool)
        body = np.ones(len(codes), bool)
        body[rows[:-1]] = False
        used[codes[body]] = True
        asked = np.flatnonzero(used).tolist()
        ids = [b""] * len(words)
        for k, x in zip(asked, self._ids_of([words[k] for k in asked])):
            ids[k] = x
        ids += [*heads, self.end]
        units = np.empty(len(codes) + n, np.int32)
        units[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(rows))] = codes
        units[rows[:-1] + np.arange(n)] = len(words) + np.arange(n)
        units[rows[1:] + np.arange(n)] = len(words) + n
        sizes = np.array([len(x) // dtype.itemsize for x in ids], np.int32)
        count = sizes[units]
        ends = np.cumsum(count, dtype=np.int64)
        shift = (np.cumsum(sizes, dtype=np.int64) - sizes)[units] - (ends - count)
        place = np.repeat(shift, count)
        place += np.arange(len(place))
        out = np.frombuffer(b"".join(ids), dtype)[place]
        offsets = np.concatenate([[0], ends[rows[1:] + np.arange(n)]]) * dtype.itemsize
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def encode_documents(docs: DataFrame, definition: bytes, end_id: int, width: int, limits: list[int], id_col: str = "doc_id",
                     text_col: str = "text", special_ids: bool = False) -> DataFrame:
    """(shard, doc_id, ids): each whole text's ids and the end id as packed little-endian integers of ``width`` bytes;
    shard counts the ``limits`` below the doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one tokenizer file, a few MB
    edges = np.array(sorted(set(limits)), np.int64)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        coder = per_worker(("byte-bpe", zlib.crc32(shared.value), end_id, width, special_ids),
                           lambda: ByteBpe(shared.value, end_id, f"<u{width}", special_ids))
        for part in slices(batch, 1, SLICE_BYTES):
            ids = part.column(0)
            shard = np.searchsorted(edges, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left")
            yield {"shard": shard.astype(np.int32), "doc_id": ids, "ids": coder.encode(part.column(1))}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
                     "shard int, doc_id long, ids binary")


BLOCK_SCHEMA = ("shard int, block long, n_docs long, n_null long, n_ids long, width int, doc_ids binary, bounds binary, ids binary")


def _pack_blocks(width: int) -> Callable:
    def run(batches):
        shard, at, size, ids, docs = None, 0, 0, [], []

        def block():
            ends = np.cumsum([len(x) // width for x in ids])
            row = {"shard": shard, "block": at, "n_docs": len(ids), "n_null": sum(d is None for d in docs), "n_ids": int(ends[-1]),
                   "width": width, "doc_ids": np.array([0 if d is None else d for d in docs], "<i8").tobytes(),
                   "bounds": EliasFano.encode(ends), "ids": b"".join(ids)}
            kinds = {"shard": pa.int32(), "width": pa.int32(), "doc_ids": pa.binary(), "bounds": pa.binary(), "ids": pa.binary()}
            return pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})

        for batch in batches:
            for s, d, x in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ids and (s != shard or size >= BLOCK_IDS * width):
                    yield block()
                    at, size, ids, docs = (at + 1 if s == shard else 0), 0, [], []
                shard = s
                ids.append(x)
                docs.append(d)
                size += len(x)
        if ids:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, definition: bytes, end_id: int, vocabulary: int, id_col: str = "doc_id",
                      text_col: str = "text", special_ids: bool = False) -> None:
    """Encode every text and write the blocks under ``path`` in ascending doc_id order.

    Shard limits are approximate quantiles of doc_id (a few numbers a shuffle partition on the driver), read from the id
    column alone, so each text is encoded once and only packed ids are moved, once.
    """
    parts = partitions_for(docs)
    found = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [k / (2 * parts) for k in range(1, 2 * parts)], 20_000).alias("q")).first()["q"]
    width = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4
    encoded = encode_documents(docs, definition, end_id, width, found or [], id_col, text_col, special_ids)
    place = F.floor(F.col("shard") * parts / (len(set(found or [])) + 1)).cast("int")  # equal runs of shards, in order
    (encoded.repartitionById(parts, place).sortWithinPartitions("shard", "doc_id", "ids")
     .mapInArrow(_pack_blocks(width), BLOCK_SCHEMA).write.parquet(path))


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): one row per document, decoded from the files.

    ``start`` counts the ids of all documents before it: shard totals are summed over the few shards, block totals inside
    each shard, and the boundary of the document before is selected from the block's structure.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = sizes.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_start"))
    inside = blocks.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("block_start"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for r in batch.to_pylist():
            bounds = EliasFano.from_buffer(r["bounds"])
            ends = bounds.select(np.arange(r["n_docs"])).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            ids = np.frombuffer(r["ids"], f"<u{r['width']}")
            doc = np.frombuffer(r["doc_ids"], "<i8")
            yield {"shard": np.full(len(ends), r["shard"], np.int32), "block": np.full(len(ends), r["block"]),
                   "doc_id": pa.array(doc, mask=np.arange(len(doc)) < r["n_null"]), "at": starts, "n_tokens": ends - starts,
                   "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]}

    rows = map_arrow(blocks.select("shard", "block", "n_docs", "n_null", "width", "doc_ids", "bounds", "ids"), run,
                     "shard int, block long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (rows.join(inside, ["shard", "block"]).join(before, "shard")
            .select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def token_output(docs: DataFrame, definition: bytes, end_id: int, vocabulary: int, path: str | None = None,
                 special_ids: bool = False) -> DataFrame:
    """Write ``docs`` as token files (under the shared scratch folder unless ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, path, definition, end_id, vocabulary, special_ids=special_ids)
    return read_token_files(spark, path)
