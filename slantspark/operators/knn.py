"""Exact k-nearest-neighbour classification (M5) as a pruned, distributed block join.

1. Train rows are cut into blocks of about ``block_rows`` along their Euclidean norm (limits from a quantile
   sketch); a block in which many norms are equal is cut further by hash.  Test rows are grouped along
   the same limits, at most ``group_rows`` to a group.  No size depends on the cluster.
2. Each test group meets the train block of its own norm range first.  The k-th distance found bounds each row's
   search: as norms of rows at distance d differ by at most d, only blocks whose range lies within it can hold a nearer row.
3. The groups meet just those blocks.  Inside a meeting, NumPy computes squared distances over Arrow batches (features
   summed left to right, so the SQL oracle gets the very same doubles) and keeps each row's k best, ties to the smallest train id.
4. A ranked window keeps the k best of all meetings per test row (spillable, nothing is gathered beyond k) and the k
   labels vote; vote ties go to the smallest label.  Test rows without any train row keep a null prediction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slantspark.session import cut_lineage

CANDIDATES = "row long, train_id long, train_label string, dist double"


def _empty_candidates() -> pd.DataFrame:
    return pd.DataFrame({"row": pd.Series([], dtype="int64"), "train_id": pd.Series([], dtype="int64"),
                         "train_label": pd.Series([], dtype="object"), "dist": pd.Series([], dtype="float64")})


def _k_smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of the k smallest entries of every row, ties broken
    by the lower column (columns are sorted by train id), in (distance, column) order.

    Linear time per row (``argpartition``) instead of a full sort: take every
    entry below the k-th smallest value, then the lowest columns among those
    equal to it.
    """
    n_rows = d.shape[0]
    kth = np.partition(d, k - 1, axis=1)[:, k - 1][:, None]
    lt = d < kth
    eq = d == kth
    need = k - lt.sum(axis=1, keepdims=True)
    sel = lt | (eq & (np.cumsum(eq, axis=1) <= need))          # exactly k per row
    r, c = np.nonzero(sel)                                      # row-major: columns ascending per row
    r, c = r.reshape(n_rows, k), c.reshape(n_rows, k)
    order = np.argsort(d[r, c], axis=1, kind="stable")          # by distance, column order on ties
    return np.take_along_axis(r, order, 1).reshape(-1), np.take_along_axis(c, order, 1).reshape(-1)


def _local_topk(k: int, n_feat: int):
    """k nearest train rows (ties: smallest train id) of every test row in one meeting."""
    def run(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        if train.empty or test.empty:
            return _empty_candidates()
        a = np.stack(test["f"].to_numpy()).astype(np.float64).reshape(len(test), n_feat)
        b = np.stack(train["f"].to_numpy()).astype(np.float64).reshape(len(train), n_feat)
        train_ids = train["id"].to_numpy(np.int64)
        order = np.lexsort((train["label"].to_numpy(object).astype(str), train_ids))
        b, train_ids = b[order], train_ids[order]
        labels = train["label"].to_numpy(object)[order]
        kk = min(k, len(train))
        out = []
        step = max(1, 4_000_000 // len(train))                  # bound the distance block in memory
        for s in range(0, len(test), step):
            blk = a[s:s + step]
            d = np.zeros((len(blk), len(train)), dtype=np.float64)
            for j in range(n_feat):                               # left-to-right sum, like the SQL
                diff = blk[:, j][:, None] - b[:, j][None, :]
                d += diff * diff
            rows, cols = _k_smallest(d, kk)
            out.append(pd.DataFrame({"row": test["row"].to_numpy(np.int64)[s:s + step][rows], "train_id": train_ids[cols],
                                     "train_label": labels[cols], "dist": d[rows, cols]}))
        return pd.concat(out, ignore_index=True)
    return run


def _limits(train: DataFrame, norm: Column, block_rows: int) -> list[float]:
    """Norm limits between blocks: one number a block on the driver."""
    blocks = math.ceil(train.count() / block_rows)
    if blocks < 2:
        return []
    found = train.agg(F.percentile_approx(norm, [i / blocks for i in range(1, blocks)], 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def _block_of(limits: list[float]):
    edges = np.array(limits, np.float64)

    @F.pandas_udf("long")
    def block(norm: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, norm.to_numpy(np.float64), side="left"))

    return block


def _cut(df: DataFrame, block: str, rows: int) -> DataFrame:
    """Adds ``part``: blocks over ``rows`` rows are cut by a hash of the row."""
    sizes = df.groupBy(block).agg(F.ceil(F.count("*") / rows).alias("parts"))
    return df.join(sizes, block).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))


class Neighbours:
    """The search over one train and one test table."""

    def __init__(self, train: DataFrame, test: DataFrame, features: list[str], id_col: str, label_col: str, k: int = 5,
                 block_rows: int = 8192, group_rows: int = 512):
        self.k, self.size = k, len(features)
        vector = F.array(*[F.col(c).cast("double") for c in features])
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
        limits = _limits(train, norm, block_rows)
        self.blocks, self.block = len(limits) + 1, _block_of(limits)
        cols = [F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                vector.alias("f"), norm.alias("norm")]
        placed = [cut_lineage(df.select(*cols).withColumn("rblk", self.block("norm")), "knn-rows") for df in (train, test)]
        self.train = _cut(placed[0], "rblk", block_rows).drop("norm")
        self.test = _cut(placed[1], "rblk", group_rows).select("row", "id", "label", "f", "norm", F.col("rblk").alias("tblk"), F.col("part").alias("tpart"))
        self.parts = placed[0].groupBy("rblk").agg(F.ceil(F.count("*") / block_rows).alias("parts"))

    def _meet(self, rows: DataFrame) -> DataFrame:
        """Candidates of test rows against the train blocks named in ``rblk``."""
        asked = rows.join(self.parts, "rblk").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        keys = ["rblk", "part", "tblk", "tpart"]
        needs = asked.select(*[F.col(c).alias(f"to_{c}") for c in keys]).distinct()
        given = self.train.join(needs, (F.col("rblk") == F.col("to_rblk")) & (F.col("part") == F.col("to_part")))
        given = given.select("id", "label", "f", *[f"to_{c}" for c in keys])
        return (given.groupBy(*[f"to_{c}" for c in keys]).cogroup(asked.select("row", "f", *keys).groupBy(*keys))
                .applyInPandas(_local_topk(self.k, self.size), CANDIDATES))

    def own(self) -> DataFrame:
        return self._meet(self.test.withColumn("rblk", F.col("tblk")))

    def others(self, found: DataFrame) -> DataFrame:
        """Test rows with the further blocks that may hold a nearer row than those ``found``."""
        reach = found.groupBy("row").agg(F.count("*").alias("n"), F.max("dist").alias("d"))
        far = F.sqrt("d") * (1 + 1e-9) + 1e-9
        rows = self.test.join(reach, "row", "left").withColumn("full", F.coalesce(F.col("n") >= self.k, F.lit(False)))
        last = F.lit(self.blocks - 1).cast("long")
        rows = (rows.withColumn("lo", F.when(F.col("full"), self.block(F.coalesce(F.col("norm") - far, F.lit(0.0)))).otherwise(F.lit(0).cast("long")))
                .withColumn("hi", F.when(F.col("full"), self.block(F.coalesce(F.col("norm") + far, F.lit(0.0)))).otherwise(last)))
        return (rows.withColumn("rblk", F.explode(F.sequence("lo", "hi"))).where("rblk <> tblk")
                .select("row", "f", "tblk", "tpart", "rblk"))

    def candidates(self) -> DataFrame:
        found = self._best(self.own())
        if self.blocks == 1:
            return found
        found = cut_lineage(found, "knn-own")
        return self._best(found.unionByName(self._meet(self.others(found))))

    def _best(self, candidates: DataFrame) -> DataFrame:
        w = Window.partitionBy("row").orderBy("dist", "train_id", "train_label")
        return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k).drop("rank")

    def labels(self) -> DataFrame:
        """(id, label, votes): for every test row the labels of its k nearest train rows (null without any)."""
        voted = self.candidates().groupBy("row").agg(F.sort_array(F.collect_list("train_label")).alias("votes"))
        return self.test.select("row", "id", "label").join(voted, "row", "left").select("id", "label", "votes")


def majority(votes: Column) -> Column:
    """The most frequent label, ties to the smallest."""
    counted = F.transform(F.array_distinct(votes), lambda lab: F.struct(
        (-F.size(F.filter(votes, lambda x: x == lab))).alias("neg_votes"), lab.alias("label")))
    return F.array_min(counted)["label"]


def shares(votes: Column, classes: list[str]) -> Column:
    """The share of votes of each class, in class order."""
    return F.array(*[(F.size(votes) - F.size(F.array_remove(votes, c))).cast("double") / F.size(votes) for c in classes])


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], id_col: str, label_col: str,
                k: int = 5, block_rows: int = 8192, group_rows: int = 512) -> DataFrame:
    """(id, label, prediction) for every test row (M5 + M7)."""
    found = Neighbours(train, test, features, id_col, label_col, k, block_rows, group_rows).labels()
    return found.select(F.col("id").alias(id_col), F.col("label").alias(label_col), majority(F.col("votes")).alias("prediction"))
