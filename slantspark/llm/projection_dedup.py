"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Unit vectors are projected on ``m`` random Gaussian directions.  For two vectors at distance d each projection differs by a
normal value of deviation d, so a window of 2.5 deviations around the query holds a linked vector with a known chance; the
collision count that a linked pair reaches but for ``miss`` of cases is the threshold.  Pairs that pass it are verified by
cosine in double precision.

On the cluster: equal vectors of one label form a class (its size is a weight).  Classes are cut, per label and vector
length, into cells of the first projection and blocks of bounded rows; only blocks whose cells lie within a wider window
(5 deviations) meet.  Inside a task, each of the other projections is sorted, query windows are found by binary search and
collisions counted, first on a few projections, then on all for the pairs left.  Linked pairs do not leave the task: each
class gets its number of links and the links are reduced to those that join components, so a hot group costs rows, not
pairs.  Work inside one label still grows with the square of its window; blocks bound what one task holds.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component, and rows without label,
link with nothing; vectors of different length never link.  Rows with a null id link with nothing and have a null
component.  Repeated rows are vectors of their own.  Only the id, vector and label columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, partitions_for
from .components import components

WINDOW, CELL_WINDOW, CELLS_PER_WINDOW = 2.5, 5.0, 4
FIRST, ALL = 8, 24
BLOCK_ROWS = 4096


def collision_threshold(m: int, window: float = WINDOW, miss: float = 1e-6) -> int:
    """The most collisions of ``m`` that a pair at the linking distance reaches but for ``miss`` of cases."""
    p = math.erf(window / math.sqrt(2))
    below, best = 0.0, 0
    for count in range(m):
        below += math.comb(m, count) * p ** count * (1 - p) ** (m - count)
        if below > miss:
            break
        best = count + 1
    return best


def directions(size: int, m: int = ALL, seed: int = 42) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, m))


def _counted(queries: np.ndarray, targets: np.ndarray, width: float) -> np.ndarray:
    """Collisions of each (query, target): per projection, sort the targets and take the ranks in the query's window."""
    count = np.zeros((len(queries), len(targets)), np.uint8)
    for k in range(targets.shape[1]):
        order = np.argsort(targets[:, k], kind="stable")
        rank = np.empty(len(order), np.int16)
        rank[order] = np.arange(len(order))
        line = targets[order, k]
        lo = np.searchsorted(line, queries[:, k] - width, side="left").astype(np.int16)
        hi = np.searchsorted(line, queries[:, k] + width, side="right").astype(np.int16)
        # rank in [lo, hi) as one unsigned comparison
        count += (rank[None, :] - lo[:, None]).view(np.uint16) < (hi - lo).view(np.uint16)[:, None]
    return count


def linked_pairs(a: np.ndarray, b: np.ndarray, cosine: float, same: bool):
    """Yield (row, column) index arrays of linked pairs of two blocks; with ``same``, only row < column."""
    dirs = directions(a.shape[1])
    unit_a, unit_b = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for x in (a, b))
    pa_, pb = unit_a @ dirs, unit_b @ dirs
    width = WINDOW * math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    few, enough = collision_threshold(FIRST), collision_threshold(ALL)
    norm_a, norm_b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b))
    for s in range(0, len(a), 512):
        first = _counted(pa_[s: s + 512, :FIRST], pb[:, :FIRST], width)
        i, j = np.nonzero(first >= few)
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        total = first[i - s, j].astype(np.int64)
        for k in range(FIRST, ALL):
            total += np.abs(pa_[i, k] - pb[j, k]) <= width
            if k % 4 == 3:
                left = total + (ALL - 1 - k) >= enough
                i, j, total = i[left], j[left], total[left]
        for c in range(0, len(i), 100_000):
            x, y = i[c: c + 100_000], j[c: c + 100_000]
            ok = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= cosine
            if ok.any():
                yield x[ok], y[ok]


def _settle(rows_a, rows_b, cosine: float) -> list[tuple[int, int | None, int]]:
    """(rep, other, links) of one block pair: links per class (other null), and joining links (links 0)."""
    ids_a, weight_a, a = rows_a
    ids_b, weight_b, b = rows_b
    same = rows_a is rows_b
    degree_a, degree_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in linked_pairs(a, b, cosine, same):
        np.add.at(degree_a, i, weight_b[j])
        np.add.at(degree_a if same else degree_b, j, weight_a[i])
        for x, y in zip(ids_a[i].tolist(), ids_b[j].tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                out.append((x, y, 0))
    for ids, degree in [(ids_a, degree_a)] + ([] if same else [(ids_b, degree_b)]):
        some = np.flatnonzero(degree)
        out += [(int(ids[k]), None, int(degree[k])) for k in some]
    return out


def _first_projection(df: DataFrame, cell: float) -> DataFrame:
    """Adds the cell number of the first projection."""

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index("embedding")
            vectors = batch.column(place)
            cells = np.zeros(batch.num_rows, np.int32)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = flat[at[rows][:, None] + np.arange(size)]
                cells[rows] = np.floor(x @ directions(int(size))[:, 0] / np.sqrt((x * x).sum(axis=1)) / cell).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", cell int"
    return df.mapInArrow(run, schema)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                           cosine: float = 0.98) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept)."""
    v = F.col("embedding")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
            .withColumn("fit", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
                F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)))
            .withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding")))
    keyed = cut_lineage(rows.select("vec_id", "label", "fit", "h1", "h2"), "vector-keys")
    classes = (rows.where("fit").groupBy("label", "h1", "h2")
               .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("embedding").alias("embedding"))
               .select("rep", "weight", "label", F.size("embedding").alias("dims"), "embedding"))
    distance = math.sqrt(max(0.0, 2 - 2 * cosine))
    cell = max(CELL_WINDOW * distance / CELLS_PER_WINDOW, 1e-6)
    block = F.floor((F.row_number().over(Window.partitionBy("label", "dims", "cell").orderBy("rep")) - 1) / BLOCK_ROWS).cast("int")
    placed = cut_lineage(_first_projection(classes, cell).withColumn("block", block), "vector-blocks")

    blocks = placed.select("label", "dims", "cell", "block").distinct()
    other = blocks.select("label", "dims", F.col("cell").alias("cell2"), F.col("block").alias("block2"))
    near = F.explode(F.sequence(F.col("cell"), F.col("cell") + CELLS_PER_WINDOW))
    meets = (blocks.withColumn("cell2", near).join(other, ["label", "dims", "cell2"])
             .where("cell2 > cell OR block2 >= block"))
    pair = F.struct("cell", "block", "cell2", "block2")
    first = meets.select("label", "dims", "cell", "block", pair.alias("pair"), F.lit(0).alias("side"))
    second = (meets.where("cell2 > cell OR block2 > block")
              .select("label", "dims", F.col("cell2").alias("cell"), F.col("block2").alias("block"), pair.alias("pair"), F.lit(1).alias("side")))
    dealt = (placed.join(first.unionByName(second), ["label", "dims", "cell", "block"])
             .select("label", "dims", F.col("pair.cell").alias("c1"), F.col("pair.block").alias("b1"), F.col("pair.cell2").alias("c2"),
                     F.col("pair.block2").alias("b2"), "side", "rep", "weight", "embedding")
             .repartition(partitions_for(vectors), "label", "dims", "c1", "b1", "c2", "b2")
             .sortWithinPartitions("label", "dims", "c1", "b1", "c2", "b2"))

    def run(batches):
        group, parts = None, []

        def settle():
            side, reps, weights, flat = (np.concatenate(x) for x in zip(*parts))
            x = flat.reshape(len(reps), -1)
            a, b = (((reps[side == s], weights[side == s], x[side == s])) for s in (0, 1))
            out = _settle(a, b if len(b[0]) else a, cosine) if len(a[0]) else []
            cols = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("rep", "other", "links"), cols)})

        for batch in batches:
            heads = list(zip(*(batch.column(k).to_pylist() for k in range(6))))
            cuts = [0, *[n for n in range(1, len(heads)) if heads[n] != heads[n - 1]], len(heads)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if heads[a] != group:
                    if parts:
                        yield settle()
                    group, parts = heads[a], []
                part = batch.slice(a, b - a)
                parts.append((part.column(6).to_numpy(), part.column(7).to_numpy(), part.column(8).to_numpy(), part.column(9).flatten().to_numpy()))
        if parts:
            yield settle()

    found = cut_lineage(dealt.mapInArrow(run, "rep long, other long, links long"), "vector-links")
    links = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    final = components(found.where("other IS NOT NULL"), "rep", "other")
    reps = keyed.where("fit").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("fit", F.lit(True))
    return (keyed.join(reps, ["label", "h1", "h2", "fit"], "left").join(links, "rep", "left").join(final, F.col("rep") == F.col("node"), "left")
            .select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
                    F.coalesce("root", "rep", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
