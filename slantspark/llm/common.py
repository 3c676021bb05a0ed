"""Shared helpers of the training-data operators: ids, words, Arrow mapping, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slantspark.session import cut_lineage, scratch_path

__all__ = ["cut_lineage", "scratch_path", "table", "heldout", "map_arrow", "binary_texts", "word_table",
           "per_worker", "fresh_name", "free_shuffles", "row_ranks", "release_memory", "slices", "partitions_for", "sliding_min"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def heldout(doc_id: Column, fold: int, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``, equals ``fold`` (a null id is never held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def row_ranks(keyed: DataFrame) -> DataFrame | None:
    """(doc_id, h1, h2, key): numbers of the different rows in the order of id and hash, where some id has several texts; else None.

    A row's number is its place in its part of a range-partitioned sort plus the sizes of the parts before.
    """
    rows = keyed.distinct()
    counts = rows.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if counts["rows"] == counts["ids"]:
        return None
    order = ["doc_id", "h1", "h2"]
    ranked = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()), "row-ranks")
    part = F.shiftright("mid", 33)
    sizes = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))       # a row a partition
    return (ranked.withColumn("part", part).join(F.broadcast(before), "part")
            .select(*order, (F.col("before") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("key")))


def release_memory() -> None:
    """Drop what ``per_worker`` keeps for an earlier stage, and give freed memory back to the system (Arrow's pool, and the C library's where it can)."""
    import pyspark

    if pyspark.__dict__.get("_slantspark_per_worker_stage") != _stage():
        pyspark.__dict__.get("_slantspark_per_worker", {}).clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Let go the shuffle files of plans that nobody holds any more: Spark drops them once the driver's JVM collects."""
    spark.sparkContext._jvm.System.gc()


def _stage() -> int | None:
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.stageId() if task else None


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with ``fn`` giving dicts of column arrays (or lists) per input batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array)
                                                  else out[f.name].cast(f.type) for f in target], schema=target)
            release_memory()

    return df.mapInArrow(run, schema)


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take about ``most`` bytes together (a longer text is a run of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_table(keep_digits_letters_only: bool) -> bytes:
    """Byte table for ``bytes.translate``: A-Z to lower case; with the flag set, every ASCII byte but a-z, 0-9 to a space."""
    out = bytearray(range(256))
    for c in range(128):
        if 65 <= c <= 90:
            out[c] = c + 32
        elif keep_digits_letters_only and not (48 <= c <= 57 or 97 <= c <= 122):
            out[c] = 32
    return bytes(out)


def per_worker(key: tuple, make: Callable):
    """One object per Python worker process (Spark reuses workers), so a cache outlives a task.

    Functions reach workers by value, so the store hangs on a module that every worker has.  Only the object asked for
    last stays, and ``release_memory`` drops it in a stage that did not ask: the caches of an earlier stage do not weigh on a later one.
    """
    import pyspark

    pyspark.__dict__["_slantspark_per_worker_stage"] = _stage()
    store = pyspark.__dict__.setdefault("_slantspark_per_worker", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def partitions_for(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle partitions of the session, the knob a deployment sizes to its input."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` along the last axis, by doubling (log2(width) passes)."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[..., : out.shape[-1] - span], out[..., span:])
        span *= 2
    rest = width - span
    return np.minimum(out[..., : out.shape[-1] - rest], out[..., rest:]) if rest else out
