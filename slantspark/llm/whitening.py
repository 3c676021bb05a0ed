"""Embedding whitening by polarisation: covariances from variances of dimension-pair sums, all sums exact integers.

Each entry c becomes the integer x = floor(1024 c) + 100000.  One narrow pass gives n and the sums S; a second one adds up,
for every dimension and every sum of two dimensions, the squares of the centred integers y = x - floor(S / n).  What the
whole-number centre leaves over (S - n floor(S / n)) is corrected exactly, so the variance of each sum is an exact rational, and

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2

is rounded once, on assembly.  The matrix goes to ``eigh``; a third pass measures the covariance of the whitened values, the
last one returns the rows.

On the cluster: rows never move.  A task sends one integer for each dimension and pair (d (d + 1) / 2, whatever its number of
rows); the driver gets that many totals and holds the d x d matrix, so its load follows the dimensions, not the rows.  Sums
inside a task use 64 bits where a bound on the batch proves that they fit, else Python's integers; totals are decimal(38, 0),
and Spark raises if one does not fit.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry are dropped, and so are vectors of
another length than the most common one (of equally common lengths the longest).  Repeated rows count as often as they
stand; a null id keeps its row.  An empty table gives no row.  Components along which the vectors do not vary have a null
``whitened`` and are left out of ``identity_error``; with no variance at all that and ``explained`` are null.  ``deviation`` is null where the
exact value does not fit a long (``deviation_exact`` has it).  Only the id and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000          # fixed values of the integer form
SLICE_ROWS = 2048
WHOLE = pa.decimal128(38, 0)
OUTPUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_exact decimal(38,0)")


def _finite(v):
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the fit list in integer form."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(_finite(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _exact(y: np.ndarray, squares_of: int) -> np.ndarray:
    """``y`` as it is where sums of squares of ``squares_of`` added values fit 64 bits, else as Python integers."""
    top = int(np.abs(y).max(initial=0)) * squares_of
    return y if top * top * max(len(y), 1) < 2 ** 62 else y.astype(object)


def pair_square_sums(y: np.ndarray) -> list[np.ndarray]:
    """For each dimension i: the sums of squares of y_i and of y_i + y_j, j > i."""
    y = _exact(y, 2)
    out = []
    for i in range(y.shape[1]):
        t = y[:, i:] + y[:, i: i + 1]
        t[:, 0] = y[:, i]
        out.append((t * t).sum(axis=0))
    return out


@dataclass(frozen=True)
class Moments:
    """Exact first and second moments of the integer vectors."""
    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def centre(self) -> list[int]:
        return [s // self.n for s in self.sums]


def _column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    def run(batches):
        n, total = 0, 0
        for batch in batches:
            x = _matrix(batch)
            for s in range(0, len(x), SLICE_ROWS):
                total = total + _exact(x[s: s + SLICE_ROWS], 1).sum(axis=0).astype(object)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, len(total)), pa.int32()),
                                              "total": pa.array([Decimal(int(v)) for v in [n, *total]], WHOLE)})

    found = rows.select("x").mapInArrow(run, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    by_place = {r["i"]: int(r["total"]) for r in found}
    return by_place.pop(-1, 0), [by_place[i] for i in sorted(by_place)]


def moments(rows: DataFrame) -> Moments | None:
    """n, S and the covariance (divisor n) of all rows; None without rows."""
    n, sums = _column_sums(rows)
    if n == 0:
        return None
    centre = np.array([s // n for s in sums], np.int64)
    rest = [s - n * (s // n) for s in sums]

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch)
            for s in range(0, len(x), SLICE_ROWS):
                part = [p.astype(object) for p in pair_square_sums(x[s: s + SLICE_ROWS] - centre)]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            places = [(i, i + k, Decimal(int(v))) for i, line in enumerate(total) for k, v in enumerate(line)]
            i, j, value = zip(*places)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": pa.array(value, WHOLE)})

    found = rows.select("x").mapInArrow(run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    squares = {(r["i"], r["j"]): int(r["total"]) for r in found}
    # n^2 times the variance of a dimension, and of a sum of two
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(len(sums))]
    v = np.empty((len(sums), len(sums)))
    for (i, j), q in squares.items():
        twice = 2 * own[i] if i == j else n * q - (rest[i] + rest[j]) ** 2 - own[i] - own[j]
        v[i, j] = v[j, i] = twice / (2 * n * n)
    return Moments(n, sums, v)


@dataclass(frozen=True)
class Basis:
    """Leading unit eigenvectors (columns) by falling eigenvalue; ``varies`` marks those with variance."""
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def varies(self) -> np.ndarray:
        return self.values > len(self.vectors) * np.finfo(float).eps * max(self.values[0], 0.0)


def basis(m: Moments, components: int) -> Basis:
    """The first ``components`` eigenvectors of the covariance; the entry of largest size of each is positive."""
    values, vectors = np.linalg.eigh(m.covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Basis(vectors * sign, values, float(np.trace(m.covariance)))


def centred(x: np.ndarray, m: Moments) -> np.ndarray:
    """n x - S, exact."""
    y = x - np.array(m.centre, np.int64)
    rest = np.array([s - m.n * c for s, c in zip(m.sums, m.centre)], dtype=object)
    wide = (int(np.abs(y).max(initial=0)) + 1) * m.n >= 2 ** 62
    return (y.astype(object) * m.n - rest) if wide else y * m.n - rest.astype(np.int64)


def _whitened(z: np.ndarray, m: Moments, b: Basis) -> np.ndarray:
    e = np.where(b.varies, b.values, 1.0)
    return (z.astype(np.float64) / m.n) @ b.vectors / np.sqrt(e)


def _identity_error(rows: DataFrame, m: Moments, b: Basis) -> float | None:
    """Largest absolute entry of the measured covariance of all whitened values, minus the identity."""
    keep = np.flatnonzero(b.varies)
    if not len(keep):
        return None

    def run(batches):
        first, second = 0.0, 0.0
        for batch in batches:
            w = _whitened(centred(_matrix(batch), m), m, b)[:, keep]
            first, second = first + w.sum(axis=0), second + w.T @ w
        if np.ndim(second):
            values = np.concatenate([first, second.ravel()])
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(values)), pa.int32()), "total": pa.array(values)})

    found = rows.select("x").mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.array([r["total"] for r in sorted(found, key=lambda r: r["place"])]) / m.n
    k = len(keep)
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per kept vector and component: see ``OUTPUT`` and the module's text."""
    rows = integer_vectors(vectors, id_col, vector_col)
    m = moments(rows)
    if m is None:
        return vectors.sparkSession.createDataFrame([], OUTPUT)
    b = basis(m, components)
    error = _identity_error(rows, m, b)
    k = len(b.values)
    explained = [float(v) / b.trace if b.trace > 0 else None for v in b.values]

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(s, SLICE_ROWS)
                z = centred(_matrix(part), m)
                rows_here = len(z)
                top = int(np.abs(z).max(initial=0))
                if top * top * z.shape[1] >= 2 ** 63:
                    z = z.astype(object)
                deviation = [int(v) for v in (z * z).sum(axis=1)]
                w = _whitened(z, m, b)
                again = np.repeat(np.arange(rows_here), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                    pa.array(np.full(rows_here * k, m.n, np.int64)),
                    pa.array([v if v < 2 ** 63 else None for v in deviation], pa.int64()).take(pa.array(again)),
                    pa.array(w.ravel(), mask=np.tile(~b.varies, rows_here)), pa.array(explained * rows_here, pa.float64()),
                    pa.array([error] * (rows_here * k), pa.float64()), pa.array([Decimal(v) for v in deviation], WHOLE).take(pa.array(again)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(run, OUTPUT)
