"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidate edges.

1. Each document's distinct k-word shingles (64-bit hashes) are thrown into ``bins`` bins by one hash; a bin keeps its
   least value, and an empty bin copies a bin chosen by a hash of its own number (optimal densification).  Documents with
   equal sets form one class, whose least id stands for it from here on; a third of all rows being copies costs one row.
2. Runs of bins are hashed to bucket keys.  Bands are as long as they can be while a pair at the threshold meets in some
   bucket but for ``miss`` (1e-6) of cases.
3. In each bucket one hub, the document that meets most others over all buckets, is paired with every member: as many
   candidate edges as members.  Distinct edges are confirmed on whole shingle sets, and components are formed.
4. A bucket whose members then lie in several components may hide a link that no hub has.  Its members' sets are compared
   inside tasks, in blocks of bounded bytes, and only edges that join components leave the task.  So no link found by the
   buckets is lost, and no pairs of a group are emitted.

Defined results: null or empty texts have no shingles and link with nothing; a text shorter than k words is one shingle of
all its words; texts are read whole.  A row with a null id has a null component and is kept.  Rows that share an id are one
document with the links of all of them.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_texts, cut_lineage, fresh_name, map_arrow, partitions_for, release_memory, row_ranks, slices
from .components import components
from .winnow import SLICE_BYTES, _Hashes, gram_hashes, known_hashes

BINS = 120
BLOCK_BYTES = 4 << 20
ROW_BYTES = 8 << 10  # a member weighs at least this in a block
BROADCAST_IDS = 2_000_000


def band_length(threshold: float, bins: int = BINS, miss: float = 1e-6) -> int:
    """The most bins per band such that a pair at the threshold misses every bucket with at most ``miss``."""
    return max((r for r in range(1, 13) if (1 - threshold ** r) ** (bins // r) <= miss), default=1)


def shingle_set(text: bytes, k: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles (A-Z lower-cased, words parted by ASCII white space)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(np.array([known[w] for w in words], np.uint64), min(k, len(words))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def one_permutation(shingles: np.ndarray, bins: int = BINS, seed: int = 1) -> np.ndarray:
    """The densified signature of a non-empty set."""
    h = np.sort(_mix(shingles + np.uint64(seed)))[::-1]
    at = (h % np.uint64(bins)).astype(np.int64)
    out = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    out[at] = h  # the least value of a bin is written last
    full[at] = True
    empty = np.flatnonzero(~full)
    attempt = 1
    while len(empty):
        picked = (_mix(empty.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt * 7919)) % np.uint64(bins)).astype(np.int64)
        good = full[picked]
        out[empty[good]] = out[picked[good]]
        empty, attempt = empty[~good], attempt + 1
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = len(signature) // rows
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        key = _mix(key ^ signature[j: bands * rows: rows])
    return key


def _signatures(docs: DataFrame, k: int, rows: int) -> DataFrame:

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known = known_hashes()
        for part in slices(batch, 1, SLICE_BYTES):
            n, h1, h2, bands = [], [], [], []
            for text in binary_texts(part.column(1)):
                s = shingle_set(text, k, known)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                bands.append(band_keys(one_permutation(s), rows).view(np.int64) if len(s) else None)
            yield {"doc_id": part.column(0), "n_shingles": n, "h1": h1, "h2": h2, "bands": pa.array(bands, pa.list_(pa.int64()))}

    return map_arrow(docs, run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known = known_hashes()
        for part in slices(batch, 1, SLICE_BYTES):
            yield {"rep": part.column(0), "shingles": pa.array([shingle_set(t, k, known).view(np.int64) for t in binary_texts(part.column(1))], pa.list_(pa.int64()))}

    return map_arrow(docs, run, "rep long, shingles array<long>")


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids, broadcast only if it is counted to be small (16 bytes a row)."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def block_edges(reps: list[int], comps: list[int], sets: list[np.ndarray], side: list[bool] | None, percent: int) -> list[tuple[int, int]]:
    """Links between different components inside a block (with ``side``: from one side to the other), as few as join them."""
    m = len(reps)
    sizes = np.array([len(s) for s in sets], np.int64)
    code = np.unique(np.array(comps), return_inverse=True)[1]
    common = np.bincount(code).argmax()
    rows = np.flatnonzero(code != common)
    if not len(rows):
        return []
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    often = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[often] = np.arange(len(often))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(rows), m), np.float32)  # counts below 2**24 are exact
    for c in range(0, len(often), 1024):
        a, b = np.searchsorted(column, [c, c + 1024])
        part = np.zeros((m, min(1024, len(often) - c)), np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        shared += part[rows] @ part.T
    # 100 * shared >= percent * (|a| + |b| - shared), in integers
    both = shared.astype(np.int64)
    both *= 100 + percent
    ok = both >= percent * (sizes[rows][:, None] + sizes[None, :])
    ok &= code[rows][:, None] != code[None, :]
    if side is not None:
        s = np.array(side)
        ok &= s[rows][:, None] != s[None, :]
    parent = list(range(int(code.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
        p, q = root(int(code[rows[i]])), root(int(code[j]))
        if p != q:
            parent[p] = q
            out.append((reps[rows[i]], reps[j]))
    return out


def _hidden_links(members: DataFrame, percent: int) -> DataFrame:
    """Edges between components inside buckets; ``members``: key, rep, comp, shingles."""
    weight = F.greatest(F.size("shingles") * 8, F.lit(ROW_BYTES))
    block = F.floor((F.sum(weight).over(Window.partitionBy("key").orderBy("rep")) - weight) / BLOCK_BYTES).cast("int")
    cut = members.withColumn("block", block).withColumn("blocks", F.max("block").over(Window.partitionBy("key")) + 1)
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = (cut.withColumn("pair", F.explode(with_each)).select("key", "pair.i", "pair.j", "block", "rep", "comp", "shingles")
             .repartition(partitions_for(members), "key", "i", "j").sortWithinPartitions("key", "i", "j"))

    def run(batches):
        group, rows = None, []

        def settle():
            (_, i, j), sides = group, [r[0] == group[1] for r in rows]
            edges = block_edges([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], sides if i != j else None, percent)
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})

        for batch in batches:
            heads = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            blocks, reps, comps = (batch.column(k).to_pylist() for k in (3, 4, 5))
            for n, head in enumerate(heads):
                if head != group:
                    if rows:
                        yield settle()
                    group, rows = head, []
                rows.append((blocks[n], reps[n], comps[n], batch.column(6)[n].values.to_numpy()))
            release_memory()
        if rows:
            yield settle()

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept); links are Jaccard similarities of ``percent`` or more."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = band_length(percent / 100)
    signed = cut_lineage(_signatures(texts, k, rows), "signatures")
    least = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = signed.join(least, ["h1", "h2"]).where("doc_id = rep").select("rep", F.explode("bands").alias("key"))
    per_key = Window.partitionBy("key")
    buckets = cut_lineage(reps.withColumn("size", F.count("*").over(per_key)).where("size > 1").select("key", "rep", "size"), "buckets")

    central = buckets.groupBy("rep").agg(F.sum("size").alias("met"))
    hubs = (buckets.join(central, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("low"))).alias("top"))
            .select("key", (-F.col("top.low")).alias("hub")))
    stars = (buckets.join(hubs, "key").where("rep <> hub")
             .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())

    active = _few(buckets.select(F.col("rep").alias("doc_id")).distinct())
    sets = cut_lineage(_sets(texts.join(active, "doc_id", "left_semi").select("doc_id", "text"), k), "sets")
    sized = sets.withColumn("n", F.size("shingles"))
    shared = F.size(F.array_intersect("x.shingles", "y.shingles"))
    confirmed = (stars.join(sized.alias("x"), F.col("a") == F.col("x.rep")).join(sized.alias("y"), F.col("b") == F.col("y.rep"))
                 .where(F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
                 .withColumn("shared", shared).where(F.col("shared") * 100 >= (F.col("x.n") + F.col("y.n") - F.col("shared")) * percent)
                 .select("a", "b"))
    confirmed = cut_lineage(confirmed, "links")
    first = components(confirmed, "a", "b")

    placed = buckets.join(first, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    hidden = _hidden_links(placed.join(mixed, "key").join(sets, "rep").select("key", "rep", "comp", "shingles"), percent)
    all_links = confirmed.unionByName(hidden)
    final = components(all_links, "a", "b")

    return (signed.join(least, ["h1", "h2"], "left").join(final, F.col("rep") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without those that are not the least of their component."""
    hashes = [F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[h.alias(n) for h, n in zip(hashes, ("h1", "h2"))])
    ranks = row_ranks(rows.where("doc_id IS NOT NULL").select("doc_id", "h1", "h2"))
    name, first, second = (fresh_name(docs, n) for n in ("dropped_id", "dropped_h1", "dropped_h2"))
    same = F.col(id_col).cast("long") == F.col(name)
    if ranks is None:
        dropped = near_duplicates(docs, id_col, text_col, k, percent).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    else:                                                         # some id has several texts: each different row gets a number of its own
        keyed = cut_lineage(rows.join(ranks, ["doc_id", "h1", "h2"]).dropDuplicates(["key"]).select("key", "text"), "keyed-texts")
        gone = near_duplicates(keyed, "key", "text", k, percent).where("NOT kept").select(F.col("doc_id").alias("key"))
        dropped = gone.join(ranks, "key").select(F.col("doc_id").alias(name), F.col("h1").alias(first), F.col("h2").alias(second))
        same &= (hashes[0] == F.col(first)) & (hashes[1] == F.col(second))
    return docs.join(_few(cut_lineage(dropped, "dropped")), same, "left_anti")
