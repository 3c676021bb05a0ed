"""Stateless streaming: the feature path and model scoring on ``readStream``.

Cleaning (T*), annotation (K*), features (F*) and model scoring are all
per-row and stateless, so the batch code runs unchanged on a stream: no
watermark or state store is needed.  Output goes to a parquet file sink with
its checkpoint under the shared checkpoint folder, so a restarted query
resumes exactly where it stopped (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantspark.operators import features as FE
from slantspark.operators import models as MD


def read_text_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """The Parquet table at ``path``, one file or a folder in which files arrive, as a stream
    (explicit schema, bounded micro-batches).

    A stream takes a folder or a pattern, so the path is given as a pattern that only itself fits.
    """
    itself = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(itself)


def feature_stream(stream: DataFrame, key: str, text_col: str) -> DataFrame:
    return FE.extract_features(stream.select(key, F.col(text_col).alias("article_text")), "article_text", keep=[key])


def score_stream(model: MD.Model, stream: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """M9 on a stream: raw text -> features -> forest -> ``label,p0,p1,...``, with the key columns in front."""
    texts = stream.select(*keys, F.col(text_col).alias("article_text"))
    return MD.predict_text(model, texts, "article_text", keep=keys)


def run_to_parquet(df: DataFrame, out_path: str, checkpoint: str) -> str:
    """Drain everything available now into a parquet sink, then stop."""
    q = (df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
