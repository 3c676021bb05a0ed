"""Readers for the driver's parquet tables and their stand-in roles.

``documents`` plays the article table and ``labels`` the publisher ground
truth.  The bias mapping from (quality, toxic) is a fixed rule:

    quality=1, toxic=0 -> least        quality=0, toxic=0 -> left-center
    quality=1, toxic=1 -> right-center quality=0, toxic=1 -> right

and ``hyperpartisan`` is true unless the bias is ``least``.  Only the columns a
query needs are selected, so the parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def bias_from_labels(quality: Column, toxic: Column) -> Column:
    return (F.when((quality == 1) & (toxic == 0), F.lit("least"))
            .when((quality == 0) & (toxic == 0), F.lit("left-center"))
            .when((quality == 1) & (toxic == 1), F.lit("right-center"))
            .when((quality == 0) & (toxic == 1), F.lit("right")))


def articles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``articles_raw`` schema: article_id, title, published_at (all strings), article_text.

    ``title`` keeps a null source, so that null profiles count something; the merge fills it."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("article_id"),
                    F.col("source").alias("title"),
                    F.lit("").alias("published_at"),
                    F.col("text").alias("article_text"))


def ground_truth_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ground_truth_raw`` schema: article_id, url, hyperpartisan, bias, labeled_by (strings)."""
    lab = table(spark, sf_dir, "labels")
    bias = bias_from_labels(F.col("quality"), F.col("toxic"))
    return lab.select(F.col("doc_id").cast("string").alias("article_id"),
                      F.lit("").alias("url"),
                      F.when(bias == "least", F.lit("false")).otherwise(F.lit("true")).alias("hyperpartisan"),
                      bias.alias("bias"),
                      F.lit("publisher").alias("labeled_by"))
