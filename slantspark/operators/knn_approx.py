"""Approximate mode of the k-nearest-neighbour classifier (M5): random-projection buckets, probed in order of their margins.

A forest of ``trees`` cuts the train rows into buckets: each node splits the rows of a bounded sample (``SAMPLE_ROWS``) at the median
of their projections on a random direction, so buckets are small where rows are dense.  A test row visits, in each tree, its own
bucket first and then the others in the order of the squared margins by which it lies on the wrong side of the cuts on their way (a
priority queue).  The number of visits is measured: the exact mode answers ``PROBE_ROWS`` test rows, and the visits are raised until ``recall`` of
these neighbours lie in a visited bucket of some tree.

Rows of a bucket meet the test rows that visit it in blocks of bounded size; distances are the exact mode's (features summed left to
right), a train row that several trees find counts once, ties go to the smallest train id.  A neighbour in no visited bucket is
missed; nothing else differs from the exact mode, and with all buckets visited nothing does.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slantspark.operators.knn import Neighbours, _k_smallest, majority
from slantspark.session import cut_lineage

SAMPLE_ROWS, PROBE_ROWS = 32_768, 256
FOUND = "row long, train_row long, train_id long, train_label string, dist double"


class Cuts:
    """One tree: inner nodes hold a direction, a limit and two children; leaves are numbered buckets."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, rng):
        self.direction, self.limit, self.children, self.bucket = [], [], [], []
        self.buckets = 0
        todo = [(None, 0, sample)]
        while todo:
            parent, side, x = todo.pop()
            node = len(self.limit)
            if parent is not None:
                self.children[parent][side] = node
            direction = rng.standard_normal(sample.shape[1])
            line = x @ direction
            limit = float(np.median(line)) if len(line) else 0.0
            left = line <= limit
            inner = len(x) > leaf_rows and 0 < left.sum() < len(x)
            self.direction.append(direction if inner else np.zeros(sample.shape[1]))
            self.limit.append(limit if inner else 0.0)
            self.children.append([None, None] if inner else None)
            self.bucket.append(-1 if inner else self.buckets)
            if inner:
                todo += [(node, 0, x[left]), (node, 1, x[~left])]
            else:
                self.buckets += 1
        self.direction, self.limit = np.array(self.direction), np.array(self.limit)

    def place(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.bucket[node]
            elif len(rows):
                left = x[rows] @ self.direction[node] <= self.limit[node]
                todo += [(self.children[node][0], rows[left]), (self.children[node][1], rows[~left])]
        return out

    def visits(self, x: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` buckets of each row, least margins first."""
        length = np.maximum(np.sqrt((self.direction ** 2).sum(axis=1)), 1e-300)
        over = ((x @ self.direction.T - self.limit) / length).tolist()       # above 0: on the right side
        out = []
        for margin in over:
            queue, found = [(0.0, 0)], []
            while queue and len(found) < most:
                cost, node = heapq.heappop(queue)
                if self.children[node] is None:
                    found.append(self.bucket[node])
                    continue
                m = margin[node]
                near, far = (self.children[node][::-1] if m > 0 else self.children[node])
                heapq.heappush(queue, (cost, near))
                heapq.heappush(queue, (cost + m * m, far))
            out.append(found)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(k: int):
    """k nearest train rows (ties: smallest train id, label, row) of every test row in one meeting."""
    def run(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "train_row", "train_id", "train_label", "dist"]
        if train.empty or test.empty:
            return pd.DataFrame({n: pd.Series([], dtype=t) for n, t in zip(names, ("int64", "int64", "int64", "object", "float64"))})
        train = train.sort_values(["id", "label", "train_row"], kind="stable")
        b, a = np.stack(train["f"].to_numpy()), np.stack(test["f"].to_numpy())
        out, step = [], max(1, 2_000_000 // len(train))
        for s in range(0, len(test), step):
            d = np.zeros((len(a[s: s + step]), len(b)))
            for j in range(b.shape[1]):                                       # left-to-right sum, like the exact mode
                diff = a[s: s + step, j][:, None] - b[:, j][None, :]
                d += diff * diff
            rows, cols = _k_smallest(d, min(k, len(b)))
            out.append(pd.DataFrame({"row": test["row"].to_numpy()[s: s + step][rows], "train_row": train["train_row"].to_numpy()[cols],
                                     "train_id": train["id"].to_numpy()[cols], "train_label": train["label"].to_numpy(object)[cols], "dist": d[rows, cols]}))
        return pd.concat(out, ignore_index=True)[names]
    return run


class ApproximateNeighbours:
    """The search over one train and one test table; ``visits`` buckets a tree, found by measuring unless given."""

    def __init__(self, train: DataFrame, test: DataFrame, features: list[str], id_col: str, label_col: str, k: int = 5, trees: int = 4,
                 recall: float = 0.97, visits: int | None = None, bucket_rows: int = 1024, group_rows: int = 2048, seed: int = 42):
        self.k, self.group_rows, self.bucket_rows = k, group_rows, bucket_rows
        vector = F.array(*[F.col(c).cast("double") for c in features])
        plain = [F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("f")]
        self.test = cut_lineage(test.select(*plain), "knn-test")
        rows = cut_lineage(train.select(*plain).withColumnRenamed("row", "train_row"), "knn-train")
        n = rows.count()
        share = int(min(1.0, SAMPLE_ROWS / max(n, 1)) * 2 ** 20)
        sample = rows.where(F.pmod(F.xxhash64("train_row"), F.lit(2 ** 20)) < share).select("f").limit(2 * SAMPLE_ROWS).toArrow()
        x = _matrix(sample.column("f").combine_chunks()) if sample.num_rows else np.zeros((0, len(features)))
        leaf = max(4, math.ceil(len(x) / max(1, math.ceil(n / bucket_rows))))
        rng = np.random.default_rng(seed)
        self.forest = [Cuts(x, leaf, rng) for _ in range(trees)]
        self.train = cut_lineage(self._placed(rows), "knn-buckets")
        self.buckets = max(t.buckets for t in self.forest)
        self.visits, self.recall = (visits, None) if visits is not None else self._measured(train, test, features, id_col, label_col, recall)

    def _placed(self, rows: DataFrame) -> DataFrame:
        forest = self.forest

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column(batch.schema.get_field_index("f")))
                places = np.stack([t.place(x) for t in forest], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(forest), pa.int32()), pa.array(places.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "places"])

        return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", places array<long>")

    def _visited(self, rows: DataFrame, most: int) -> DataFrame:
        """(row, f, tree, bucket, turn): the buckets a row visits."""
        forest = self.forest

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column(1))
                out = [(n, t, b, turn) for t, tree in enumerate(forest) for n, line in enumerate(tree.visits(x, most)) for turn, b in enumerate(line)]
                n, t, b, turn = (np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(n)), batch.column(1).take(pa.array(n)), pa.array(t), pa.array(b), pa.array(turn)],
                                                 ["row", "f", "tree", "bucket", "turn"])

        return rows.select("row", "f").mapInArrow(run, "row long, f array<double>, tree long, bucket long, turn long")

    def _measured(self, train, test, features, id_col, label_col, recall: float) -> tuple[int, float]:
        """The fewest visits that reach ``recall`` of the exact neighbours of the probes, and the recall reached."""
        n = self.test.count()
        share = int(min(1.0, PROBE_ROWS / max(n, 1)) * 2 ** 20)
        probes = self.test.where(F.pmod(F.xxhash64("row"), F.lit(2 ** 20)) < share).limit(2 * PROBE_ROWS)
        probes = cut_lineage(probes.select("id", "label", *[F.col("f")[j].alias(f"f{j}") for j in range(len(features))]), "knn-probes")
        known = self.train.select(F.col("train_row").alias("id"), "label", *[F.col("f")[j].alias(f"f{j}") for j in range(len(features))])
        exact = Neighbours(known, probes, [f"f{j}" for j in range(len(features))], "id", "label", self.k)
        truth = exact.candidates().select("row", F.col("train_id").alias("train_row"))
        asked = self._visited(exact.test.select("row", "f"), self.buckets).select("row", "tree", "bucket", "turn")
        true_places = truth.join(self.train.select("train_row", F.posexplode("places").alias("tree", "bucket")), "train_row")
        needed = (true_places.join(asked, ["row", "tree", "bucket"]).groupBy("row", "train_row").agg((F.min("turn") + 1).alias("needed"))
                  .groupBy("needed").count().orderBy("needed").collect())     # a row for each number of visits
        total, done = sum(r["count"] for r in needed), 0
        for r in needed:
            done += r["count"]
            if done >= recall * total:
                return int(r["needed"]), done / total
        return self.buckets, 1.0

    def candidates(self) -> DataFrame:
        """(row, train_row, train_id, train_label, dist): the k best found of each test row."""
        flat = self.train.select("train_row", "id", "label", "f", F.posexplode("places").alias("tree", "bucket"))
        sizes = flat.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / self.bucket_rows / 4).alias("parts"))
        asked = cut_lineage(self._visited(self.test, self.visits), "knn-visits")
        blocks = asked.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / self.group_rows).alias("blocks"))
        both = F.broadcast(sizes.join(blocks, ["tree", "bucket"]))            # a row a bucket, SAMPLE_ROWS a tree at most
        keys = ["tree", "bucket", "part", "block"]
        given = (flat.join(both, ["tree", "bucket"]).withColumn("part", F.pmod(F.xxhash64("train_row"), F.col("parts")))
                 .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("train_row", "id", "label", "f", *keys))
        taken = (asked.join(both, ["tree", "bucket"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
                 .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("row", "f", *keys))
        met = given.groupBy(*keys).cogroup(taken.groupBy(*keys)).applyInPandas(_nearest(self.k), FOUND)
        rank = F.row_number().over(Window.partitionBy("row").orderBy("dist", "train_id", "train_label", "train_row"))
        return met.distinct().withColumn("rank", rank).where(F.col("rank") <= self.k).drop("rank")

    def labels(self) -> DataFrame:
        """(id, label, votes): for every test row the labels of the k nearest train rows found (null without any)."""
        voted = self.candidates().groupBy("row").agg(F.sort_array(F.collect_list("train_label")).alias("votes"))
        return self.test.select("row", "id", "label").join(voted, "row", "left").select("id", "label", "votes")


def knn_predict_approx(train: DataFrame, test: DataFrame, features: list[str], id_col: str, label_col: str, k: int = 5, recall: float = 0.97) -> DataFrame:
    """(id, label, prediction) for every test row, in the approximate mode."""
    found = ApproximateNeighbours(train, test, features, id_col, label_col, k, recall=recall).labels()
    return found.select(F.col("id").alias(id_col), F.col("label").alias(label_col), majority(F.col("votes")).alias("prediction"))
