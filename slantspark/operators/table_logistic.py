"""M15 core: multinomial logistic regression on all words, its coefficients a table and never a vector on one machine.

Rows are TF-IDF vectors of unit length over the whole vocabulary (no hashing, no cut), packed in blocks of up to about
``BLOCK_ENTRIES`` entries.  Every vector of the optimiser (coefficients, gradients, steps) is a combination of the rows, so it is kept by what
it gives on the rows: its margins, a few numbers a row, in place of a number a word.  A pass takes the residuals R of all rows to the words
(X'R, one partial sum a word and block, added up in shards of up to ``SHARD`` words) and back to the rows (XX'R, the margins of the gradient).
Besides these (block, word) sums nothing moves: blocks, margins and residuals are bucketed tables of one layout and are joined in place.

The optimiser is L-BFGS in its vector-free form: an inner product of two such vectors is a sum over rows, so only small sums reach the driver,
where they give the next direction as a combination of the vectors of the last ``MEMORY`` steps.  Losses at several step lengths follow
from margins alone.  The residuals of all passes are kept, K numbers a row each; at the end their combination is taken to the words once, which gives the
coefficients.  As residuals sum to 0 over the classes, so do all vectors, and the last class is left out of what is stored and moved.

Every table is written in the shared folder; a state is deleted once its successor stands, residuals at the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantspark.session import cut_lineage, drop_scratch, scratch_path

BLOCK_ENTRIES = 1 << 22                 # a block's upper size; a word costs a pass one sum a block that holds it
FINE_ENTRIES = 1 << 18                  # smaller tables: blocks of this size, up to one a core
MEMORY = 5
SHARD_BITS = 12                         # words of one shard of the coefficient table: ids that agree above these bits
SHARD = 1 << SHARD_BITS
VECTORS = 2 + 2 * MEMORY
BIAS = -SHARD                           # the intercept is a word that every row has, in a shard of its own
LOSS = -10                              # the shard that carries losses, no coefficients
FIRST_STEPS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 0.25, 0.0625)
STEPS = (1.0, 0.5, 0.25, 0.0625, 0.015625, 2.0, 4.0)


def word_counts(rows: DataFrame, row: str = "_row", words: str = "words") -> DataFrame:
    """(_row, word, tf) of every row's distinct words; a row's words are counted where the row lies."""
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            place, code = pc.list_parent_indices(lists).to_numpy().astype(np.int64), coded.indices
            real = code.is_valid().to_numpy(zero_copy_only=False)
            size = max(len(coded.dictionary), 1)
            key, n = np.unique(place[real] * size + code.fill_null(0).to_numpy()[real], return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(key // size)), coded.dictionary.take(pa.array(key % size)), pa.array(n, pa.int64())],
                                             ["_row", "word", "tf"])

    return rows.select(F.col(row).cast("long").alias("_row"), F.col(words).alias("words")).mapInArrow(run, "_row long, word string, tf long")


@dataclass
class Blocks:
    """Packed rows by block with the block's words, and the numbers of rows, classes and blocks."""
    data: DataFrame
    rows: int
    classes: int
    parts: int

    @property
    def asks(self) -> DataFrame:
        """(shard, asker, at): the packed words each block asks of each shard."""
        def ask(batches):
            for batch in batches:
                for block, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(words.as_buffer(), np.int64)
                    shard, cuts = _shards(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([block] * len(shard), pa.int32()),
                                                      pa.array([_packed((ids[x:y] & (SHARD - 1)).astype(np.int32)) for x, y in cuts], pa.binary())], ["shard", "asker", "at"])

        return self.data.select("block", "words").mapInArrow(ask, "shard long, asker int, at binary")


def _packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _shards(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The shards of sorted ids, and where each one's ids lie."""
    shard = ids >> SHARD_BITS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)
    return shard[cuts[:-1]], list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def bucketed(df: DataFrame, name: str, parts: int) -> tuple[DataFrame, str]:
    """``df`` (block, ...) written as ``parts`` buckets by block, so that such tables are joined in place; with its path."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.bucketBy(parts, "block").option("path", path).format("parquet").saveAsTable(_table_name(path))
    return spark.table(_table_name(path)), path


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def _forget(table: tuple[DataFrame, str]) -> None:
    """Delete a bucketed table."""
    df, path = table
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    drop_scratch(spark, path)


def encode(rows: DataFrame, vocabulary: DataFrame, classes: int) -> Blocks:
    """``rows`` (_row, words, label), ``vocabulary`` (word, id, idf); all rows, also those without words."""
    spark = rows.sparkSession
    entries = F.coalesce(F.size(F.array_distinct("words")), F.lit(0))
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(entries > 0, entries).otherwise(0) + 1), F.lit(0)).alias("entries")).first()
    parts = max(1, math.ceil(size["entries"] / BLOCK_ENTRIES), min(math.ceil(size["entries"] / FINE_ENTRIES), spark.sparkContext.defaultParallelism))
    # Numbers of blocks such that Spark's buckets hold one each.
    numbers = spark.range(parts * (parts.bit_length() + 8)).select(F.col("id").cast("int").alias("n"))
    numbers = [r["n"] for r in numbers.groupBy(F.pmod(F.hash("n"), F.lit(parts))).agg(F.min("n").alias("n")).orderBy("n").collect()]
    block = F.element_at(F.lit(numbers).cast("array<int>"), (F.pmod(F.xxhash64("_row"), F.lit(len(numbers))) + 1).cast("int")).alias("block")

    def pack(table: pa.Table) -> pa.Table:
        """One row a block: labels, entries a row, places of the entries among the block's words (the intercept first), values, words."""
        row, ids, x = (table.column(c).to_numpy() for c in ("_row", "id", "x"))
        order = np.lexsort((ids, row))                                       # a row's own line, which holds its label, comes first
        ids, x = ids[order], x[order]
        own = ids == BIAS
        row = np.cumsum(own) - 1
        label, row, ids, x = x[own], row[~own], ids[~own], x[~own]
        x = x / np.sqrt(np.bincount(row, x * x, len(label)))[row]
        words, place = np.unique(np.append(ids, BIAS), return_inverse=True)
        blobs = [_packed(label.astype(np.int32)), _packed(np.bincount(row, minlength=len(label)).astype(np.int32)), _packed(place[:-1].astype(np.int32)), _packed(x), _packed(words)]
        return pa.table({"block": table.column("block").slice(0, 1), **{n: pa.array([v], pa.binary()) for n, v in zip(("label", "sizes", "place", "x", "words"), blobs)}})

    held = word_counts(rows).join(vocabulary, "word").select("_row", "id", (F.col("tf") * F.col("idf")).alias("x")).where("x > 0")
    lines = held.unionByName(rows.select("_row", F.lit(BIAS).cast("long").alias("id"), F.col("label").cast("double").alias("x")))
    packed = lines.select(block, "_row", "id", "x").groupBy("block").applyInArrow(pack, "block int, label binary, sizes binary, place binary, x binary, words binary")
    return Blocks(bucketed(packed, "logistic_blocks", parts)[0], size["rows"], classes, parts)


def _softmax_loss(z: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return float((np.log(total[:, 0]) + top[:, 0] - z[np.arange(len(z)), label]).sum()), e / total


def answers(blocks: Blocks, state: DataFrame, delta: np.ndarray) -> DataFrame:
    """(asker, shard, at, wd): the coefficients w and the direction d (``delta`` combines the vectors) of the asked words, shard by shard."""
    classes, size = blocks.classes, len(delta)

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            v = np.frombuffer(table.column("vecs")[0].as_buffer(), np.float64).reshape(-1, size, classes)
            wd = np.stack([v[:, 0], np.einsum("nvk,v->nk", v, delta)], axis=1)
            out = [_packed(wd[np.frombuffer(at.as_buffer(), np.int32)]) for at in asked.column("at")]
        return pa.table({"asker": asked.column("asker").slice(0, len(out)), "shard": asked.column("shard").slice(0, len(out)),
                         "at": asked.column("at").slice(0, len(out)), "wd": pa.array(out, pa.binary())})

    return state.groupBy("shard").cogroup(blocks.asks.groupBy("shard")).applyInArrow(run, "asker int, shard long, at binary, wd binary")


def evaluate(blocks: Blocks, state: DataFrame, delta: np.ndarray, steps: tuple[float, ...], at: float) -> DataFrame:
    """(shard, at, g): each block's share of the gradient of the mean loss at w + ``at`` d, and rows of shard LOSS with the losses at ``steps``.

    ``state`` may hold any coefficients, word by word; ``Fit`` itself stays with the rows.
    """
    classes, n = blocks.classes, blocks.rows

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("shard")                                       # words of a block lie by shard, then place
        counts = [len(b) // 4 for b in asked.column("at").to_pylist()]
        wd = np.frombuffer(b"".join(asked.column("wd").to_pylist()), np.float64).reshape(-1, 2, classes)
        w, d = np.ascontiguousarray(wd[:, 0]), np.ascontiguousarray(wd[:, 1])
        label, sizes, place = (np.frombuffer(data.column(c)[0].as_buffer(), np.int32) for c in ("label", "sizes", "place"))
        x = np.frombuffer(data.column("x")[0].as_buffer(), np.float64)
        row = np.repeat(np.arange(len(sizes)), sizes)

        def margins(v):                                                      # the intercept is the first word
            return np.stack([np.bincount(row, x * v[place, k], len(sizes)) + v[0, k] for k in range(classes)], axis=1)

        zw = margins(w)
        zd = margins(d) if d.any() else np.zeros_like(zw)
        losses = np.array([_softmax_loss(zw + t * zd, label)[0] for t in steps])
        rest = _softmax_loss(zw + at * zd, label)[1]
        rest[np.arange(len(label)), label] -= 1
        gradient = np.stack([np.bincount(place, x * rest[row, k], len(w)) for k in range(classes)], axis=1)
        gradient[0] = rest.sum(axis=0)
        ends = np.cumsum(counts)
        return pa.table({"shard": pa.array([*asked.column("shard").to_pylist(), LOSS], pa.int64()), "at": pa.array([*asked.column("at").to_pylist(), b""], pa.binary()),
                         "g": pa.array([*(_packed(gradient[e - c: e] / n) for c, e in zip(counts, ends)), _packed(losses / n)], pa.binary())})

    return blocks.data.groupBy("block").cogroup(answers(blocks, state, delta).groupBy("asker")).applyInArrow(run, "shard long, at binary, g binary")


def _direction(gram: np.ndarray, pairs: int) -> np.ndarray:
    """L-BFGS two-loop recursion on inner products: the weights of (w, g, s_1.., y_1..) in the next direction, newest pair last."""
    delta = np.zeros(len(gram))
    delta[1] = -1.0
    first = len(gram) // 2 + 1
    s, y = [2 + n for n in range(pairs)], [first + n for n in range(pairs)]
    alpha = {}
    for n in reversed(range(pairs)):
        alpha[n] = gram[s[n]] @ delta / gram[s[n], y[n]]
        delta[y[n]] -= alpha[n]
    if pairs:
        delta *= gram[s[-1], y[-1]] / gram[y[-1], y[-1]]
    for n in range(pairs):
        delta[s[n]] += alpha[n] - gram[y[n]] @ delta / gram[s[n], y[n]]
    return delta


def _all_classes(v: np.ndarray) -> np.ndarray:
    """With the last class, which takes the sum over the classes to 0."""
    return np.concatenate([v, -v.sum(axis=-1, keepdims=True)], axis=-1)


def _floats(column, n: int = 0) -> np.ndarray:
    return np.frombuffer(column[n].as_buffer(), np.float64)


def to_words(blocks: Blocks, values: DataFrame) -> DataFrame:
    """(shard, block, at, g): each block's sums over its rows of ``values`` (block, r) times the rows' words, shard by shard."""
    size = blocks.classes - 1

    def run(data: pa.Table) -> pa.Table:
        sizes, place = (np.frombuffer(data.column(c)[0].as_buffer(), np.int32) for c in ("sizes", "place"))
        x, ids = _floats(data.column("x")), np.frombuffer(data.column("words")[0].as_buffer(), np.int64)
        r, row = _floats(data.column("r")).reshape(-1, size), np.repeat(np.arange(len(sizes)), sizes)
        g = np.stack([np.bincount(place, x * r[row, k], len(ids)) for k in range(size)], axis=1)[1:]
        shard, cuts = _shards(ids[1:])                                       # the first word is the intercept
        at = (ids[1:] & (SHARD - 1)).astype(np.uint16)
        return pa.table({"shard": pa.array(shard, pa.int64()), "asker": pa.array([data.column("block")[0].as_py()] * len(cuts), pa.int32()),
                         "at": pa.array([_packed(at[a:b]) for a, b in cuts], pa.binary()), "g": pa.array([_packed(g[a:b]) for a, b in cuts], pa.binary())})

    joined = blocks.data.select("block", "sizes", "place", "x", "words").join(values.select("block", "r"), "block")
    return joined.groupBy("block").applyInArrow(run, "shard long, asker int, at binary, g binary")


def _shard_total(parts: pa.Table, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums of a shard's words over all blocks, and the words of each block (a word stands once in a block)."""
    total, places = np.zeros((SHARD, size)), []
    for at, g in zip(parts.column("at"), parts.column("g")):
        places.append(np.frombuffer(at.as_buffer(), np.uint16))
        total[places[-1]] += np.frombuffer(g.as_buffer(), np.float64).reshape(-1, size)
    return total, places


def from_words(sums: DataFrame, size: int) -> DataFrame:
    """(asker, shard, u): for each block of ``to_words`` the sums over all blocks, in the order of its words."""
    def run(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("asker")                                       # one order of addition
        total, places = _shard_total(parts, size)
        return pa.table({"asker": parts.column("asker"), "shard": parts.column("shard"), "u": pa.array([_packed(total[at]) for at in places], pa.binary())})

    return sums.groupBy("shard").applyInArrow(run, "asker int, shard long, u binary")


class Fit:
    """The optimiser's state: a table (block, label, m: the rows' margins of w, g, s_1.., y_1.. without the intercept) and, on the driver, these
    vectors' inner products without the intercept (``free``), their intercepts (``bias``) and their shares of the residuals kept so far (``shares``)."""

    def __init__(self, blocks: Blocks, vocabulary: DataFrame, reg: float):
        self.blocks, self.vocabulary, self.reg, self.spark = blocks, vocabulary, reg, vocabulary.sparkSession
        self.size, self.pairs, self.kept = blocks.classes - 1, 0, []
        self.free, self.bias, self.shares = np.zeros((1, 1)), np.zeros((1, self.size)), np.zeros((1, 0))
        size = self.size

        def zeros(batches):
            for batch in batches:
                m = [bytes(len(v.as_buffer()) // 4 * size * 8) for v in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m, pa.binary()), pa.array([b""] * len(m), pa.binary())], ["block", "label", "m", "sums"])

        self.state = bucketed(blocks.data.select("block", "label").mapInArrow(zeros, "block int, label binary, m binary, sums binary"), "logistic_state", blocks.parts)
        done = self._residuals(np.zeros(1), (0.0,), 0.0)
        self.loss = done[1][0]
        self._advance(np.zeros(1), 0.0, done)

    @property
    def gram(self) -> np.ndarray:
        bias = _all_classes(self.bias)
        return self.free + bias @ bias.T

    def _residuals(self, delta: np.ndarray, steps: tuple[float, ...], at: float) -> tuple[tuple[DataFrame, str], list[float]]:
        """The rows' residuals at w + ``at`` d as a table (block, r, losses), and the losses at ``steps``; d combines the vectors by ``delta``."""
        vectors, size, n, bias = len(delta), self.size, self.blocks.rows, self.bias

        def run(batches):
            for batch in batches:
                out = {"block": batch.column(0), "r": [], "losses": []}
                for label, m in zip(batch.column(1), batch.column(2)):
                    label = np.frombuffer(label.as_buffer(), np.int32)
                    m = np.frombuffer(m.as_buffer(), np.float64).reshape(vectors, -1, size)
                    w, d = _all_classes(m[0] + bias[0]), _all_classes(np.tensordot(delta, m, 1) + delta @ bias)
                    out["losses"].append(_packed(np.array([_softmax_loss(w + t * d, label)[0] for t in steps]) / n))
                    r = _softmax_loss(w + at * d, label)[1]
                    r[np.arange(len(label)), label] -= 1
                    out["r"].append(_packed(r[:, :-1] / n))
                yield pa.RecordBatch.from_arrays([out["block"], pa.array(out["r"], pa.binary()), pa.array(out["losses"], pa.binary())], ["block", "r", "losses"])

        table = bucketed(self.state[0].select("block", "label", "m").mapInArrow(run, "block int, r binary, losses binary"), "logistic_residuals", self.blocks.parts)
        parts = [np.frombuffer(r["losses"], np.float64) for r in table[0].select("block", "losses").orderBy("block").collect()]      # one row a block
        losses = np.sum(parts, axis=0) if parts else np.zeros(len(steps))
        return table, [float(v) + self._penalty(delta, t) for v, t in zip(losses, steps)]

    def _penalty(self, delta: np.ndarray, step: float) -> float:
        move = step * delta
        move[0] += 1.0                                                   # w + step d as a combination of the vectors
        return 0.5 * self.reg * float(move @ self.free @ move)

    def next_state(self, residuals: DataFrame, move: np.ndarray, change: np.ndarray) -> DataFrame:
        """The state after a step: ``move`` gives the new w, ``change`` the new vectors from the old ones and the new gradient.  ``sums`` holds the
        products of the residuals with the old vectors and the new gradient, and their plain sums."""
        vectors, size, reg = len(move), self.size, self.reg

        def run(data: pa.Table, told: pa.Table) -> pa.Table:
            sizes, place = (np.frombuffer(data.column(c)[0].as_buffer(), np.int32) for c in ("sizes", "place"))
            x, row = _floats(data.column("x")), np.repeat(np.arange(len(sizes)), sizes)
            r, m = _floats(data.column("r")).reshape(-1, size), _floats(data.column("m")).reshape(vectors, -1, size)
            u = [np.zeros((1, size)), *(np.frombuffer(v.as_buffer(), np.float64).reshape(-1, size) for v in told.sort_by("shard").column("u"))]
            u = np.concatenate(u)                                            # the words lie by shard, then place, the intercept before all
            q = np.stack([np.bincount(row, x * u[place, k], len(sizes)) for k in range(size)], axis=1)
            m = np.concatenate([m, (q + reg * np.tensordot(move, m, 1))[None]])
            sums = np.concatenate([(_all_classes(m) * _all_classes(r)).sum(axis=(1, 2)), r.sum(axis=0)])
            return pa.table({"block": data.column("block"), "label": data.column("label"), "m": pa.array([_packed(np.tensordot(change, m, 1))], pa.binary()),
                             "sums": pa.array([_packed(sums)], pa.binary())})

        told = from_words(to_words(self.blocks, residuals), size)
        here = (self.blocks.data.select("block", "sizes", "place", "x").join(self.state[0].select("block", "label", "m"), "block").join(residuals.select("block", "r"), "block"))
        return here.groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(run, "block int, label binary, m binary, sums binary")

    def _advance(self, delta: np.ndarray, step: float, done: tuple[tuple[DataFrame, str], list[float]]) -> None:
        """w += step d; the new gradient comes from the residuals, the pair (s, y) enters the history, inner products follow."""
        old, pairs = len(delta), self.pairs
        unit = np.eye(old + 1)
        moved = np.append(step * delta, 0.0)
        move = moved + unit[0]
        change = [move, unit[old]]
        if old > 1:
            keep = range(max(0, pairs - MEMORY + 1), pairs)
            change += [*(unit[2 + n] for n in keep), moved, *(unit[2 + pairs + n] for n in keep), unit[old] - unit[1]]
            self.pairs = min(pairs + 1, MEMORY)
        change, move = np.array(change), move[:-1]
        new = bucketed(self.next_state(done[0][0], move, change), "logistic_state", self.blocks.parts)
        # A few numbers a block.
        sums = np.sum([np.zeros(old + 1 + self.size), *(np.frombuffer(r["sums"], np.float64) for r in new[0].select("block", "sums").orderBy("block").collect())], axis=0)
        _forget(self.state)
        self.state = new
        self.kept.append(done[0])
        # The new gradient is X'(residuals) + reg w but for the intercept.
        with_old = sums[:old] + self.reg * (self.free @ move)
        own = sums[old] + self.reg * float(move @ with_old)
        free = np.block([[self.free, with_old[:, None]], [with_old[None], np.array([[own]])]])
        shares = np.hstack([self.shares, np.zeros((old, 1))])
        share = self.reg * (move @ shares)
        share[-1] += 1.0
        self.free = change @ free @ change.T
        self.bias = change @ np.vstack([self.bias, sums[old + 1:]])
        self.shares = change @ np.vstack([shares, share])

    def minimise(self, max_iter: int, tolerance: float) -> None:
        for turn in range(max_iter):
            gram = self.gram
            s, y = [2 + n for n in range(self.pairs)], [2 + self.pairs + n for n in range(self.pairs)]
            usable = all(gram[a, b] > 1e-12 * max(gram[a, a], 1e-300) for a, b in zip(s, y))
            delta = _direction(gram, self.pairs if usable else 0)
            slope = float(delta @ gram[1])
            if slope >= -1e-12:
                return
            steps = STEPS if self.pairs else FIRST_STEPS
            done = self._residuals(delta, steps, 1.0)
            losses, step = done[1], 1.0
            if not self.pairs or losses[0] > self.loss + 1e-4 * slope:
                step = steps[int(np.argmin(losses))]
            new = losses[steps.index(step)]
            if new >= self.loss:
                _forget(done[0])
                return
            if step != 1.0:
                _forget(done[0])
                done = self._residuals(delta, (step,), step)
            self._advance(delta, step, done)
            improved, self.loss = self.loss - new, new
            if improved <= tolerance * max(1.0, abs(new)):
                return

    def coefficients(self) -> DataFrame:
        """(id, w) of every word of the vocabulary; the intercept has the id BIAS."""
        size = self.size

        def combine(table: pa.Table) -> pa.Table:
            table = table.sort_by("turn")
            shares = table.column("share").to_numpy()
            total = sum(c * _floats(table.column("r"), n) for n, c in enumerate(shares))
            return pa.table({"block": table.column("block").slice(0, 1), "r": pa.array([_packed(total)], pa.binary())})

        def spread(parts: pa.Table) -> pa.Table:
            total, places = _shard_total(parts.sort_by("asker"), size)
            at = np.unique(np.concatenate(places))
            w = _all_classes(total[at])
            ids = (parts.column("shard")[0].as_py() << SHARD_BITS) + at.astype(np.int64)
            return pa.table({"id": pa.array(ids), "w": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (size + 1), pa.int32()), pa.array(w.ravel()))})

        kept = [t[0].select("block", "r", F.lit(n).alias("turn"), F.lit(float(c)).alias("share")) for n, (t, c) in enumerate(zip(self.kept, self.shares[0]))]
        every = kept[0]
        for more in kept[1:]:
            every = every.unionByName(more)
        values = bucketed(every.groupBy("block").applyInArrow(combine, "block int, r binary"), "logistic_duals", self.blocks.parts)
        found = to_words(self.blocks, values[0]).groupBy("shard").applyInArrow(spread, "id long, w array<double>")
        none = F.array(*[F.lit(0.0)] * (size + 1))
        words = self.vocabulary.select("id").join(found, "id", "left").select("id", F.coalesce("w", none).alias("w"))   # none: a word of weight 0
        bias = self.spark.createDataFrame([(BIAS, _all_classes(self.bias[0]).tolist())], "id long, w array<double>").coalesce(1)
        out = cut_lineage(words.unionByName(bias), "logistic-coefficients")
        for table in [*self.kept, values, self.state]:
            _forget(table)
        return out


def fit(rows: DataFrame, vocabulary: DataFrame, classes: int, max_iter: int = 30, reg: float = 0.0, tolerance: float = 1e-4) -> tuple[DataFrame, float]:
    """Coefficients (id, w) with the intercept at ``BIAS``, and the final loss; ``rows`` (_row, words, label), ``vocabulary`` (word, id >= 0, idf)."""
    state = Fit(encode(rows, vocabulary, classes), vocabulary, reg)
    state.minimise(max_iter, tolerance)
    return state.coefficients(), state.loss


def margins(rows: DataFrame, coefficients: DataFrame, intercepts: list[float]) -> DataFrame:
    """(_row, z): class margins of ``rows`` (_row, words); ``coefficients`` (word, idf, w).  Rows without known words have no row here."""
    x = F.col("tf") * F.col("idf")
    hits = word_counts(rows).join(coefficients, "word").withColumn("x", x)
    sums = hits.groupBy("_row").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *[F.sum(F.col("x") * F.col("w")[k]).alias(f"z{k}") for k in range(len(intercepts))])
    return sums.where("norm > 0").select("_row", F.array(*[F.col(f"z{k}") / F.col("norm") + F.lit(b) for k, b in enumerate(intercepts)]).alias("z"))


def softmax(z):
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
