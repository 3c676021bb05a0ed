"""Approximate nearest neighbours by largest inner product: hierarchical k-means tree, best bins first.

A tree of k-means splits is fitted on a bounded sample (``SAMPLE_ROWS`` distinct vectors, at most ``SAMPLE_BYTES``); every
vector is then dealt to the leaf of its nearest centroids.  A query walks the tree through a priority queue ordered by the
inner product with a node's centroid: the best node is opened, its children join the queue, leaves are visited in the order
in which they come off.  How many leaves a query visits is calibrated, not guessed: for ``PROBES`` query vectors the exact
neighbours among all rows are found once, and the visits are widened until ``recall`` of those neighbours lie in visited leaves.

On the cluster: equal vectors form a class, of which only the k + 1 smallest ids can ever be among k neighbours, so a vector
that a third of all rows share is one row of the index, and one search however many queries share it.  Leaves in tree order are
packed into bins of ``BIN_ROWS`` rows, and a larger leaf is cut into several; queries of a bin are dealt in blocks of
``BIN_QUERIES``.  A task compares one block with one bin, leaf by leaf.  The first round meets each query's best bin; the k-th
score found there is a floor, so that the second round (all other visited bins) sends only rows above it.

Scores are inner products in double precision of the original vectors, ties go to the smaller id.  Vectors that are null, empty,
all zero or hold a null or non-finite component take no part, nor do rows without id or vectors of another length than the most
common one (of equally common lengths the longest).  A row that repeats id and vector counts once; rows that share only the id
are queries and candidates of their own, and only a query's own row is no candidate.  With fewer than k candidates
all are returned; an empty table gives no row.  Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

SAMPLE_ROWS, SAMPLE_BYTES = 32_768, 32 << 20
BRANCHES, LEAF_SAMPLE = 8, 256
PROBES = 256
BIN_ROWS, BIN_QUERIES = 8192, 4096
OUTPUT = "query_id long, rank int, vec_id long, score double, leaves_visited int, calibrated_recall double"


# --- the tree -------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in an array; a node without children is a leaf, numbered in depth-first order."""
    centroids: list = field(default_factory=list)
    children: list = field(default_factory=list)
    leaf: list = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return max(1, sum(n >= 0 for n in self.leaf))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree, each time to the nearest centroid."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = _nearest(x[rows], np.array([self.centroids[c] for c in self.children[node]]))
            todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def visits(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first."""
        score = (queries @ np.array(self.centroids).T).tolist()
        out = []
        for s in score:
            queue, found = [(-s[0], 0)], []
            while queue and len(found) < most:
                node = heapq.heappop(queue)[1]
                if not self.children[node]:
                    found.append(self.leaf[node])
                for c in self.children[node]:
                    heapq.heappush(queue, (-s[c], c))
            out.append(found)
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * np.einsum("ij,ij->i", centroids, centroids)).argmax(axis=1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    """Group number of each row (Lloyd's rounds from k distinct random rows)."""
    start = np.unique(x[rng.choice(len(x), min(len(x), 4 * k), replace=False)], axis=0)
    centroids = start[rng.permutation(len(start))[:k]]
    group = np.zeros(len(x), int)
    for _ in range(rounds):
        new = _nearest(x, centroids)
        if (new == group).all() and _:
            break
        group = new
        for g in range(len(centroids)):
            if (group == g).any():
                centroids[g] = x[group == g].mean(axis=0)
    return group


def fit_tree(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE, seed: int = 42) -> Tree:
    """Split until a node holds ``leaf_rows`` sample rows at most, or rows that no split parts."""
    tree, rng, n_leaves = Tree(), np.random.default_rng(seed), 0
    todo = [(None, sample)]
    while todo:                                         # a stack, so leaves are numbered in depth-first order
        parent, x = todo.pop()
        node = len(tree.centroids)
        tree.centroids.append(x.mean(axis=0))
        tree.children.append([])
        tree.leaf.append(-1)
        if parent is not None:
            tree.children[parent].append(node)
        parts = []
        if len(x) > leaf_rows:
            group = _kmeans(x, branches, rng)
            parts = [x[group == g] for g in np.unique(group)]
        if len(parts) > 1:
            todo += [(node, p) for p in parts]
        else:
            tree.leaf[node] = n_leaves
            n_leaves += 1
    return tree


# --- rows -------------------------------------------------------------------------------------------

def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding, h1, h2) of the rows that take part, each once."""
    v = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                                                   & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(fit)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("embedding") == (common["d"] if common else 0))
            .withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding")))


def classes(rows: DataFrame, k: int, is_query: str) -> DataFrame:
    """(h1, h2, ids, asked, embedding): one row per distinct vector with its k + 1 smallest ids.

    The rank limit runs before the shuffle too, so a class of any size sends k + 1 rows a task.
    """
    asked = rows.where(is_query).select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    ids = rows.select("h1", "h2", "vec_id").distinct()
    few = (ids.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
           .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    vector = rows.groupBy("h1", "h2").agg(F.any_value("embedding").alias("embedding"))
    return few.join(vector, ["h1", "h2"]).join(asked, ["h1", "h2"], "left").select("h1", "h2", "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "embedding")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sample(index: DataFrame, total: int, want: int) -> np.ndarray:
    """About ``want`` vectors, chosen by their hash (all, if there are no more); never more than twice as many."""
    share = int(min(1.0, want / max(total, 1)) * 2 ** 20)
    rows = index.where(F.pmod(F.xxhash64(F.lit(11), "h1", "h2"), F.lit(2 ** 20)) < share).select("embedding").limit(2 * want).toArrow()
    return _matrix(rows.column("embedding").combine_chunks()) if rows.num_rows else np.zeros((0, 1))


def _placed(index: DataFrame, tree: Tree) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(_matrix(batch.column("embedding"))), pa.int32())],
                                             [*batch.schema.names, "leaf"])

    return index.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in index.dtypes) + ", leaf int")


def _first(found: tuple, k: int) -> tuple:
    """Of (query, score, id, ...) arrays, the first k entries of each query by falling score, then id."""
    order = np.lexsort((found[2], -found[1], found[0]))
    q = found[0][order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return tuple(x[order] for x in found)


@dataclass
class Block:
    """Rows of the index: vectors, their classes' ids (offsets into values) and leaves, in leaf order."""
    x: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    h1: np.ndarray
    leaf: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch) -> "Block":
        rows = rows.sort_by("leaf")
        ids = rows.column("ids")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        x = rows.column("embedding")
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
        return cls(_matrix(x), np.concatenate([[0], np.cumsum(sizes)]), ids.flatten().to_numpy(),
                   rows.column("h1").to_numpy(), rows.column("leaf").to_numpy())

    def best(self, queries: np.ndarray, who: np.ndarray, a: int, b: int, k: int, floor: np.ndarray) -> tuple:
        """(query, score, id, row) of the best k of rows a..b for each of ``queries[who]``, not below its floor."""
        parts = []
        for s in range(0, len(who), 256):
            some = who[s: s + 256]
            score = queries[some] @ self.x[a:b].T
            edge = np.partition(score, max(b - a - k, 0), axis=1)[:, max(b - a - k, 0)]     # ties at the edge stay
            low = np.maximum(edge, floor[some])
            q, c = np.nonzero(score >= (low - 1e-9 * np.abs(low))[:, None] if np.isfinite(low).all() else score >= edge[:, None])
            exact = np.einsum("ij,ij->i", queries[some[q]], self.x[a + c])                 # the same value in any block
            copies = self.first[a + c + 1] - self.first[a + c]
            at = np.repeat(self.first[a + c] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
            parts.append(_first((np.repeat(some[q], copies), np.repeat(exact, copies), self.ids[at], np.repeat(a + c, copies)), k))
        return tuple(np.concatenate(x) for x in zip(*parts))


# --- calibration ------------------------------------------------------------------------------------

def exact_neighbours(placed: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """(q, vec_id, score, leaf): the exact k best rows of each probe, one narrow pass and a ranked merge."""
    def run(batches):
        best = None
        for batch in batches:
            if batch.num_rows:
                block = Block.of(batch)
                found = block.best(queries, np.arange(len(queries)), 0, len(block.x), k, np.full(len(queries), -np.inf))
                found = (*found[:3], block.leaf[found[3]])
                best = found if best is None else _first(tuple(np.concatenate(x) for x in zip(best, found)), k)
        if best is not None:
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(
                ("q", "score", "vec_id", "leaf"), best, (pa.int32(), pa.float64(), pa.int64(), pa.int32()))})

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return (placed.select("embedding", "ids", "h1", "leaf").mapInArrow(run, "q int, score double, vec_id long, leaf int")
            .withColumn("rank", rank).where(F.col("rank") <= k))


def calibrate(placed: DataFrame, tree: Tree, total_asked: int, k: int, recall: float) -> tuple[int, float]:
    """The fewest leaf visits whose leaves hold ``recall`` of the probes' exact neighbours (without the probe's own class)."""
    probes = _sample(placed.where("asked"), total_asked, PROBES)
    if not len(probes) or tree.leaves == 1:
        return tree.leaves, 1.0
    own = tree.place(probes)
    order = tree.visits(probes, tree.leaves)
    place = [{leaf: n for n, leaf in enumerate(line)} for line in order]
    needed = []
    for r in exact_neighbours(placed, probes, k + 1).select("q", "leaf", "rank").collect():   # (k + 1) x PROBES rows
        if r["rank"] > 1 or r["leaf"] != own[r["q"]]:                                # the probe itself is no neighbour
            needed.append(place[r["q"]][r["leaf"]] + 1)
    needed = np.array(needed)
    visits = 1
    while visits < tree.leaves and (needed <= visits).mean() < recall:               # widen
        visits += 1
    return visits, float((needed <= visits).mean()) if len(needed) else 1.0


# --- search -----------------------------------------------------------------------------------------

def _bins(sizes: dict[int, int], leaves: int, bin_rows: int) -> list[tuple[int, int, int]]:
    """(leaf, bin, parts): small leaves share a bin in tree order; a leaf above ``bin_rows`` fills ``parts`` bins alone."""
    out, n, filled = [], 0, 0
    for leaf in range(leaves):
        size = sizes.get(leaf, 0)
        if filled and filled + size > bin_rows:
            n, filled = n + 1, 0
        parts = -(-size // bin_rows) if size > bin_rows else 1
        out.append((leaf, n, parts))
        filled += size
        if parts > 1:
            n, filled = n + parts, 0
    return out


FOUND = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("own", pa.bool_())]))


def _meet(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best rows of each (query class, bin, part): (h1, h2, found array of (score, vec_id, own class))."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            block, queries = Block.of(left), _matrix(right.column("embedding").combine_chunks())
            floor, q_h1 = right.column("floor").to_numpy(), right.column("h1").to_numpy()
            visits = right.column("visit").combine_chunks()
            who = np.repeat(np.arange(len(queries)), visits.value_lengths().to_numpy(zero_copy_only=False))
            leaf = visits.flatten().to_numpy()
            order = np.argsort(leaf, kind="stable")
            who, leaf = who[order], leaf[order]
            for v in np.unique(leaf):
                a, b = np.searchsorted(block.leaf, [v, v + 1])
                if a < b:
                    c, d = np.searchsorted(leaf, [v, v + 1])
                    parts.append(block.best(queries, who[c:d], a, b, k, floor))
                    if sum(len(p[0]) for p in parts) > 500_000:
                        parts = [_first(tuple(np.concatenate(x) for x in zip(*parts)), k)]
        if not parts:
            return pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "found": pa.array([], FOUND)})
        q, score, ids, row = _first(tuple(np.concatenate(x) for x in zip(*parts)), k)
        some, first = np.unique(q, return_index=True)
        entries = pa.StructArray.from_arrays([pa.array(score), pa.array(ids), pa.array(block.h1[row] == q_h1[q])], ["score", "vec_id", "own"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(q)), pa.int32()), entries)
        return pa.table({"h1": pa.array(q_h1[some]), "h2": right.column("h2").combine_chunks().take(pa.array(some)), "found": lists})

    keys = ["bin", "part", "block"]
    return (rows.groupBy(*keys).cogroup(asked.groupBy(*keys))
            .applyInArrow(run, "h1 long, h2 long, found array<struct<score: double, vec_id: long, own: boolean>>"))


def _ranked(found: DataFrame, most: int) -> DataFrame:
    rows = found.select("h1", "h2", F.inline("found"))
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("place", rank).where(F.col("place") <= most)


def nearest(vectors: DataFrame, is_query: str = "true", id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            recall: float = 0.95, leaf_sample: int = LEAF_SAMPLE, bin_rows: int = BIN_ROWS, bin_queries: int = BIN_QUERIES) -> DataFrame:
    """Each query's k nearest: ``OUTPUT``.  ``is_query`` is an SQL condition on ``vec_id`` (default: all rows are queries)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    index = cut_lineage(classes(rows, k, is_query), "ann-classes")
    totals = index.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.max(F.size("embedding")).alias("d")).first()
    if not totals["asked"]:
        return spark.createDataFrame([], OUTPUT)
    want = max(LEAF_SAMPLE, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * totals["d"])))
    sample = _sample(index, totals["n"], want)
    tree = fit_tree(sample if len(sample) else _sample(index, 0, 1), leaf_rows=leaf_sample)
    placed = cut_lineage(_placed(index, tree), "ann-index")
    visits, reached = calibrate(placed, tree, totals["asked"], k, recall)

    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}          # one row a leaf
    bins = spark.createDataFrame(_bins(sizes, tree.leaves, bin_rows), "leaf int, bin int, parts int")

    def walk(batches):
        for batch in batches:
            found = tree.visits(_matrix(batch.column("embedding")), visits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    asked = placed.where("asked").select("h1", "h2", "embedding")
    walked = asked.select("h1", "h2", "embedding").mapInArrow(walk, "h1 long, h2 long, embedding array<double>, leaves array<int>")
    by_bin = cut_lineage(walked.select("h1", "h2", "embedding", F.posexplode("leaves").alias("place", "leaf")).join(F.broadcast(bins), "leaf")
                         .groupBy("h1", "h2", "bin", "parts").agg(F.collect_list("leaf").alias("visit"), F.min("place").alias("place"), F.any_value("embedding").alias("embedding")),
                         "ann-visits")
    blocks = spark.createDataFrame([(r["bin"], r["first"], -(-r["n"] // bin_queries)) for r in by_bin.groupBy("bin", (F.col("place") == 0).alias("first"))
                                    .agg(F.count("*").alias("n")).collect()], "bin int, first boolean, blocks int")
    dealt = placed.select("h1", "leaf", "ids", "embedding").join(F.broadcast(bins), "leaf").withColumn("part", F.pmod(F.xxhash64(F.lit(13), "h1"), F.col("parts")).cast("int"))

    def round_of(first: bool, floors: DataFrame | None) -> DataFrame:
        here = F.broadcast(blocks.where(F.col("first") == first).drop("first"))
        queries = by_bin.where((F.col("place") == 0) == first)
        queries = queries.withColumn("floor", F.lit(float("-inf"))) if floors is None else queries.join(floors, ["h1", "h2"], "left").fillna(float("-inf"), ["floor"])
        queries = (queries.join(here, "bin").withColumn("block", F.pmod(F.xxhash64(F.lit(17), "h1", "h2"), F.col("blocks")).cast("int"))
                   .select("h1", "h2", "visit", "embedding", "floor", "bin", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
        targets = (dealt.join(here, "bin").select("h1", "leaf", "ids", "embedding", "bin", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
        return _meet(targets, queries, k + 1)

    near = cut_lineage(round_of(True, None), "ann-near")
    floors = _ranked(near, k + 1).where(F.col("place") == k + 1).select("h1", "h2", F.col("score").alias("floor"))
    far = round_of(False, floors)
    best = (_ranked(near.unionByName(far), k + 1).groupBy("h1", "h2")
            .agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "own"))).alias("found")))
    # Back to the query rows: a class shared by many queries was searched once; AQE splits the join of a hot class.
    others = F.filter("found", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id"))))
    out = (rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(best, ["h1", "h2"])
           .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "x")))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"),
                      F.lit(visits).alias("leaves_visited"), F.lit(reached).alias("calibrated_recall"))
