"""M3 core: a random forest whose fit and scoring cost what its rows cost.

Features are put into at most ``BINS`` bins (thresholds between quantiles of all rows), so a row is a byte a feature.  Each tree
takes every row a Poisson(1) number of times, drawn from a hash of row and tree.  A node tries a random subset of features, drawn
from a hash of its path, and takes the split of least Gini impurity.

A tree grows in two steps.  Nodes of more than ``LOCAL_ROWS`` rows are split over all partitions: each task adds up its rows' class counts by
bin, the sums are added up by node, and only the chosen splits reach the driver.  The rows of each smaller node then meet in one
task, which grows all below it.  Both steps choose by the same function, so where the border lies changes nothing.

A node is six bytes (feature, bin, child) and equal leaf distributions are kept once a tree, so scoring sends the whole forest
to the workers as one broadcast and needs no shuffle; it works on a stream too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from slantspark.session import cut_lineage

BINS = 64
LOCAL_ROWS = 1 << 18
LEAF = 255
CHUNK = 1024                # nodes whose class counts lie in memory at once
LEAST_GAIN = 1e-12
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
PACKED = "rows binary, label binary, bins binary"
SUBTREE = "tree int, node int, feature binary, split binary, child binary, leaves binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _root_key(seed: int, tree: int) -> np.ndarray:
    return _mix(_mix(np.array([seed], np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(tree))


def _child_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of the left and right children, one after the other."""
    return _mix(np.repeat(keys, 2) * np.uint64(2) + np.tile(np.array([1, 2], np.uint64), len(keys)))


def weights(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often the tree takes each row."""
    h = _mix(rows.astype(np.uint64) ^ _root_key(seed, tree))
    return np.searchsorted(POISSON, (h >> np.uint64(11)) * 2.0 ** -53, side="right").astype(np.uint8)


def _subsets(keys: np.ndarray, features: int) -> np.ndarray:
    """Of each node the features it tries, by the least hashes."""
    h = _mix(keys[:, None] ^ _mix(np.arange(1, features + 1, dtype=np.uint64)))
    return np.argsort(h, axis=1)[:, : math.ceil(math.sqrt(features))]


def _counts(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, node: np.ndarray, subset: np.ndarray, classes: int) -> np.ndarray:
    """(node, feature tried, bin, class): how many rows."""
    m, s = subset.shape
    out = np.empty((m, s, BINS * classes))
    for k in range(s):
        at = (node * BINS + bins[np.arange(len(node)), subset[node, k]]) * classes + label
        out[:, k] = np.bincount(at, weight, m * BINS * classes).reshape(m, -1)
    return out.reshape(m, s, BINS, classes)


def choose(counts: np.ndarray, subset: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or LEAF, last bin of the left side, class counts of the left side) of each node."""
    left = counts.cumsum(axis=2)
    total = left[:, :1, -1:]
    right, left = total - left[:, :, :-1], left[:, :, :-1]
    n_left, n_right = left.sum(axis=-1), right.sum(axis=-1)
    pure = (left * left).sum(axis=-1) / np.maximum(n_left, 1) + (right * right).sum(axis=-1) / np.maximum(n_right, 1)
    pure[(n_left < min_rows) | (n_right < min_rows)] = -1.0
    m = np.arange(len(counts))
    best = pure.reshape(len(counts), -1).argmax(axis=1)
    slot, split = best // (BINS - 1), best % (BINS - 1)
    n = np.maximum(total.sum(axis=-1).ravel(), 1)
    gain = (pure[m, slot, split] - (total * total).sum(axis=-1).ravel() / n) / n
    return np.where(gain > LEAST_GAIN, subset[m, slot], LEAF), split, left[m, slot, split]


def _open_nodes(counts: np.ndarray, depth: int, max_depth: int, min_rows: int) -> np.ndarray:
    """Nodes that may be split: of several classes, of enough rows and not too deep."""
    return ((counts > 0).sum(axis=1) > 1) & (counts.sum(axis=1) >= 2 * min_rows) & (depth < max_depth)


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, key: np.ndarray, depth: int, max_depth: int,
         min_rows: int) -> tuple[np.ndarray, ...]:
    """(feature, split, child, leaves) of the tree below one node, level by level; a leaf's child is its place in ``leaves``."""
    parts, leaf_counts, n_leaves, base = [], [], 0, 0
    node, keys = np.zeros(len(label), np.int64), key
    while len(keys):
        m = len(keys)
        counts = np.bincount(node * classes + label, weight, m * classes).reshape(m, classes)
        feature, split = np.full(m, LEAF), np.zeros(m, np.int64)
        wanted = np.flatnonzero(_open_nodes(counts, depth, max_depth, min_rows))
        if len(wanted):
            place = np.full(m, -1)
            place[wanted] = np.arange(len(wanted))
            rows = np.flatnonzero(place[node] >= 0)
            rows = rows[np.argsort(place[node[rows]], kind="stable")]
            at = place[node[rows]]
            subset = _subsets(keys[wanted], bins.shape[1])
            cuts = np.searchsorted(at, np.arange(0, len(wanted) + CHUNK, CHUNK))
            for first, a, b in zip(range(0, len(wanted), CHUNK), cuts, cuts[1:]):
                some, r = subset[first: first + CHUNK], rows[a:b]
                got = choose(_counts(bins[r], label[r], weight[r], at[a:b] - first, some, classes), some, min_rows)
                feature[wanted[first: first + CHUNK]], split[wanted[first: first + CHUNK]] = got[0], got[1]
        inner = feature != LEAF
        child = np.where(inner, base + m + 2 * (np.cumsum(inner) - 1), n_leaves + np.cumsum(~inner) - 1)
        leaf_counts.append(counts[~inner])
        n_leaves += len(leaf_counts[-1])
        parts.append((feature, split, child))
        keep = inner[node]
        bins, label, weight, node = bins[keep], label[keep], weight[keep], node[keep]
        right = bins[np.arange(len(node)), feature[node]] > split[node]
        node = 2 * (np.cumsum(inner) - 1)[node] + right
        keys, base, depth = _child_keys(keys[inner]), base + m, depth + 1
    feature, split, child = (np.concatenate(x) for x in zip(*parts))
    n = np.concatenate(leaf_counts)
    leaves, which = np.unique(n / np.maximum(n.sum(axis=1, keepdims=True), 1), axis=0, return_inverse=True)
    leaf = feature == LEAF
    child[leaf] = which.ravel()[child[leaf]]
    return feature.astype(np.uint8), split.astype(np.uint8), child.astype(np.int32), leaves


def walk(trees: tuple[np.ndarray, ...], root: int, bins: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to."""
    feature, split, child = trees[:3]
    at, rows = np.full(len(bins), root, np.int64), np.arange(len(bins))
    while len(rows):
        a = at[rows]
        f = feature[a]
        inner = f != LEAF
        rows, a, f = rows[inner], a[inner], f[inner]
        at[rows] = child[a] + (bins[rows, f] > split[a])
    return at


def _binned(columns: list[pa.Array], thresholds: list[np.ndarray]) -> np.ndarray:
    """A byte a feature; null and NaN are greater than all values."""
    out = np.empty((len(columns[0]), len(columns)), np.uint8)
    for k, (c, t) in enumerate(zip(columns, thresholds)):
        out[:, k] = np.searchsorted(t, c.to_numpy(zero_copy_only=False).astype(np.float64), side="left")
    return out


@dataclass
class Forest:
    """``packed``: feature, split, child and the roots of all trees, and the leaf distributions, as bytes."""
    labels: list[str]
    features: list[str]
    thresholds: list[list[float]]
    packed: dict[str, bytes]

    @property
    def roots(self) -> np.ndarray:
        return np.frombuffer(self.packed["roots"], np.int64)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (vector), ``prediction`` (class index) and ``predicted_label`` to every row."""
        shared = df.sparkSession.sparkContext.broadcast(self.packed)
        thresholds, classes, width = [np.array(t) for t in self.thresholds], len(self.labels), len(df.columns)
        schema = StructType([*df.schema.fields, StructField("_p", ArrayType(DoubleType()))])

        def run(batches):
            packed = shared.value
            trees = tuple(np.frombuffer(packed[n], t) for n, t in (("feature", np.uint8), ("split", np.uint8), ("child", np.int32)))
            leaves, roots = np.frombuffer(packed["leaves"], np.float64).reshape(-1, classes), np.frombuffer(packed["roots"], np.int64)
            for batch in batches:
                bins = _binned(batch.columns[width:], thresholds)
                p = np.zeros((len(bins), classes))
                for root in roots.tolist():
                    p += leaves[trees[2][walk(trees, root, bins)]]
                p /= len(roots)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * classes, pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], column], [*batch.schema.names[:width], "_p"])

        inputs = [F.col(f).cast("double").alias(f"_f{k}") for k, f in enumerate(self.features)]
        best = F.array_position("_p", F.array_max("_p")) - 1
        return (df.select("*", *inputs).mapInArrow(run, schema)
                .withColumns({"probability": array_to_vector("_p"), "prediction": best.cast("double"),
                              "predicted_label": F.get(F.array(*[F.lit(x) for x in self.labels]), best.cast("int"))}).drop("_p"))

    def save(self, path: str) -> str:
        spark = SparkSession.getActiveSession()
        schema = "labels array<string>, features array<string>, thresholds array<array<double>>, packed map<string,binary>"
        row = (self.labels, self.features, self.thresholds, {k: bytearray(v) for k, v in self.packed.items()})
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
        return path

    @classmethod
    def open(cls, path: str) -> Forest:
        row = SparkSession.getActiveSession().read.parquet(f"{path}/forest").first()
        return cls(list(row["labels"]), list(row["features"]), [list(t) for t in row["thresholds"]], {k: bytes(v) for k, v in row["packed"].items()})


def thresholds_of(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Between neighbouring quantiles of all rows, at most ``BINS`` - 1 a feature."""
    # The summaries are merged on Spark; each quantile is off by a rank of a thousandth of the rows at most.
    quantiles = df.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(features, [k / (BINS - 1) for k in range(BINS)], 0.001)
    distinct = [np.unique(q) for q in quantiles]
    return [((q[1:] + q[:-1]) / 2).tolist() for q in distinct]


class _Top:
    """The nodes of one tree down to those that one task takes over; as arrays it reads like a tree whose leaves are these."""

    def __init__(self, key: np.ndarray, big: bool):
        self.feature, self.split, self.child, self.key, self.depth, self.big = [LEAF], [0], [0], [key], [0], [big]

    def part(self, n: int, feature: int, split: int, big: tuple[bool, bool]) -> None:
        self.big[n] = False
        if feature == LEAF:
            return
        self.feature[n], self.split[n], self.child[n] = feature, split, len(self.feature)
        keys = _child_keys(self.key[n])
        for side in (0, 1):
            for values, v in ((self.feature, LEAF), (self.split, 0), (self.child, 0), (self.key, keys[side: side + 1]), (self.depth, self.depth[n] + 1), (self.big, big[side])):
                values.append(v)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.split), np.array(self.child)


def _blocks(batches):
    """(row ids, labels, bins) of packed rows."""
    for batch in batches:
        for rows, label, bins in zip(*(c.to_pylist() for c in batch.columns)):
            label = np.frombuffer(label, np.uint8)
            yield np.frombuffer(rows, np.int64), label.astype(np.int64), np.frombuffer(bins, np.uint8).reshape(len(label), -1)


def _split_big(packed: DataFrame, tops: list[_Top], features: int, classes: int, seed: int, max_depth: int, min_rows: int, local_rows: int) -> bool:
    """One level over all partitions; False when no node of more than ``local_rows`` rows is left."""
    todo = [(t, n) for t, top in enumerate(tops) for n in range(len(top.big)) if top.big[n]]
    if not todo:
        return False
    subset = _subsets(np.concatenate([tops[t].key[n] for t, n in todo]), features)
    trees = sorted({t for t, _ in todo})
    arrays = {t: tops[t].arrays() for t in trees}
    numbers = {t: np.full(len(tops[t].big), -1) for t in trees}
    for k, (t, n) in enumerate(todo):
        numbers[t][n] = k

    def add(batches):
        sums = np.zeros((len(todo), subset.shape[1], BINS, classes))
        for rows, label, bins in _blocks(batches):
            for t in trees:
                weight, at = weights(rows, seed, t), numbers[t][walk(arrays[t], 0, bins)]
                r = np.flatnonzero((weight > 0) & (at >= 0))
                here, at = np.unique(at[r], return_inverse=True)
                if len(here):
                    sums[here] += _counts(bins[r], label[r], weight[r], at, subset[here], classes)
        yield pa.RecordBatch.from_pydict({"id": pa.array(range(len(todo)), pa.int32()), "sums": pa.array([x.tobytes() for x in sums], pa.binary())})

    def best(table: pa.Table) -> pa.Table:
        k = table.column("id")[0].as_py()
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums")).reshape(1, -1, BINS, classes)
        feature, split, left = choose(total, subset[k: k + 1], min_rows)
        left, right = left[0], total[0, 0].sum(axis=0) - left[0]
        return pa.table({"id": pa.array([k], pa.int32()), "feature": pa.array([int(feature[0])], pa.int32()), "split": pa.array([int(split[0])], pa.int32()),
                         "left": [left.tolist()], "right": [right.tolist()]})

    found = packed.mapInArrow(add, "id int, sums binary").groupBy("id").applyInArrow(best, "id int, feature int, split int, left array<double>, right array<double>")
    for r in found.collect():                                                # a row a big node
        t, n = todo[r["id"]]
        depth = tops[t].depth[n] + 1
        big = [sum(c) > local_rows and bool(_open_nodes(np.array([c]), depth, max_depth, min_rows)[0]) for c in (r["left"], r["right"])]
        tops[t].part(n, r["feature"], r["split"], tuple(big))
    return True


def fit(train: DataFrame, features: list[str], label: str = "label", trees: int = 100, seed: int = 42, max_depth: int = 30, min_rows: int = 1,
        local_rows: int = LOCAL_ROWS) -> Forest:
    """``train``: rows with a label; classes are numbered in alphabetical order."""
    labels = sorted(r[0] for r in train.select(label).distinct().collect())  # a row a class
    if not labels:
        raise ValueError("there are no labelled rows to fit on")
    if len(labels) > 255 or len(features) >= LEAF:
        raise ValueError("at most 255 classes and 254 features")
    cuts = thresholds_of(train, features)
    codes, thresholds, classes = {x: n for n, x in enumerate(labels)}, [np.array(t) for t in cuts], len(labels)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                blobs = [batch.column(0).to_numpy().tobytes(), bytes(codes[x] for x in batch.column(1).to_pylist()), _binned(batch.columns[2:], thresholds).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], ["rows", "label", "bins"])

    inputs = [F.col(f).cast("double").alias(f"_f{k}") for k, f in enumerate(features)]
    packed = cut_lineage(train.select(F.monotonically_increasing_id().alias("_row"), F.col(label).alias("_label"), *inputs).mapInArrow(pack, PACKED), "forest-rows")
    rows = packed.agg(F.coalesce(F.sum(F.length("label")), F.lit(0)).alias("n")).first()["n"]
    tops = [_Top(_root_key(seed, t), rows > local_rows) for t in range(trees)]
    while _split_big(packed, tops, len(features), classes, seed, max_depth, min_rows, local_rows):
        pass
    arrays = [top.arrays() for top in tops]

    def deal(batches):
        for rows, label, bins in _blocks(batches):
            for t in range(trees):
                weight, at = weights(rows, seed, t), walk(arrays[t], 0, bins)
                taken = np.flatnonzero(weight)
                taken = taken[np.argsort(at[taken], kind="stable")]
                here, first = np.unique(at[taken], return_index=True)
                parts = np.split(taken, first[1:])
                if len(here):
                    blobs = [[x.tobytes() for x in column] for column in zip(*((label[r].astype(np.uint8), weight[r], bins[r]) for r in parts))]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(here), pa.int32()), pa.array(here, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]],
                                                     ["tree", "node", "label", "weight", "bins"])

    keys, depths, width = [top.key for top in tops], [top.depth for top in tops], len(features)

    def below(table: pa.Table) -> pa.Table:
        t, n = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        lab, w, b = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in ("label", "weight", "bins"))
        got = grow(b.reshape(-1, width), lab.astype(np.int64), w.astype(np.float64), classes, keys[t][n], depths[t][n], max_depth, min_rows)
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int32()),
                         **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("feature", "split", "child", "leaves"), got)}})

    dealt = packed.mapInArrow(deal, "tree int, node int, label binary, weight binary, bins binary")
    # A fixed number of partitions: the rows are few bytes, the work on them is long.
    grown = cut_lineage(dealt.repartition(trees, "tree", "node").groupBy("tree", "node").applyInArrow(below, SUBTREE), "forest-trees")
    return Forest(labels, list(features), cuts, _joined(arrays, grown, classes))


def _joined(tops: list[tuple[np.ndarray, ...]], grown: DataFrame, classes: int) -> dict[str, bytes]:
    """All trees one after the other, six bytes a node: the top nodes of each, then what grew below them."""
    base, leaf_base, roots = 0, 0, []
    out: dict[str, list[np.ndarray]] = {n: [] for n in ("feature", "split", "child", "leaves")}
    below: dict[int, dict[int, tuple]] = {}
    for r in grown.collect():
        below.setdefault(r["tree"], {})[r["node"]] = (np.frombuffer(r["feature"], np.uint8), np.frombuffer(r["split"], np.uint8),
                                                      np.frombuffer(r["child"], np.int32), np.frombuffer(r["leaves"], np.float64).reshape(-1, classes))
    for t, top in enumerate(tops):
        roots.append(base)
        feature, split, child = top[0].astype(np.uint8), top[1].astype(np.uint8), top[2].astype(np.int64) + base
        parts, at = [], base + len(feature)
        empty = (feature == LEAF)
        for n, (f, s, c, leaves) in sorted(below.get(t, {}).items()):
            empty[n] = False
            c = c.astype(np.int64) + np.where(f == LEAF, leaf_base, at - 1)
            feature[n], split[n], child[n] = f[0], s[0], c[0]                # the root takes the place of the top's leaf
            parts.append((f[1:], s[1:], c[1:]))
            out["leaves"].append(leaves)
            at, leaf_base = at + len(f) - 1, leaf_base + len(leaves)
        if empty.any():                                                      # a tree that took no row at all votes for all classes alike
            out["leaves"].append(np.full((1, classes), 1.0 / classes))
            child[empty] = leaf_base
            leaf_base += 1
        for name, x in zip(("feature", "split", "child"), zip((feature, split, child), *parts)):
            out[name].extend(x)
        base = at
    types = {"feature": np.uint8, "split": np.uint8, "child": np.int32, "leaves": np.float64}
    return {n: np.concatenate(x).astype(types[n]).tobytes() for n, x in out.items()} | {"roots": np.array(roots, np.int64).tobytes()}
