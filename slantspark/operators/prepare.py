"""Join and reshaping operators P9-P14 and J1.

J1 is the one shuffle boundary of the dataset build.  The ground-truth side
is pruned to (article_id, hyperpartisan, bias) before the join; Spark picks
the broadcast by the bytes of that side (from its statistics, or from the
shuffle files under AQE), and AQE splits skewed partitions (duplicate or hot ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantspark.operators import quality as Q

# --- fixed values -----------------------------------------------------------
# Three-class relabelling of the centre biases.
CENTER_TO_SIDE = {"left-center": "left", "right-center": "right"}
# --- end of fixed values ------------------------------------------------------


def relabel(df: DataFrame, col: str = "bias", mapping: dict[str, str] | None = None) -> DataFrame:
    """Left-center -> left, right-center -> right."""
    return df.na.replace(mapping or CENTER_TO_SIDE, subset=[col])


def clean_articles(articles_raw: DataFrame, id_mode: str = "quarantine") -> DataFrame:
    """P5 -> P6 -> P8 on the article side: article_id BIGINT, title, article_text.

    ``failfast`` casts every id, so one that is no whole number stops the job
    (reference behaviour); ``quarantine`` leaves those rows to ``rejected_ids``.
    """
    a = Q.drop_null_text(articles_raw, "article_text")
    a = Q.cast_id(a, "article_id", id_mode)
    return a.select("article_id", "title", "article_text")


def clean_truth(truth_raw: DataFrame, id_mode: str = "quarantine") -> DataFrame:
    """P8 on the ground-truth side, pruned to the columns the merge keeps."""
    t = Q.cast_id(truth_raw, "article_id", id_mode)
    return t.select("article_id", F.col("hyperpartisan").cast("boolean").alias("hyperpartisan"), "bias")


def rejected_ids(articles_raw: DataFrame, truth_raw: DataFrame) -> DataFrame:
    """(side, article_id, n): every id, on either side, that quarantine leaves out of the merge."""
    sides = [(n, df) for n, df in (("articles", articles_raw), ("truth", truth_raw))]
    found = [Q.invalid_id_rows(df).select(F.lit(n).alias("side"), "article_id") for n, df in sides]
    return found[0].unionByName(found[1]).groupBy("side", "article_id").agg(F.count("*").alias("n"))


def merge(articles: DataFrame, truth: DataFrame) -> DataFrame:
    """J1 + P9: inner equi-join on article_id; duplicates multiply like the reference.

    Output: article_id BIGINT, title, article_text, hyperpartisan BOOLEAN, bias.
    """
    return (articles.join(truth, "article_id", "inner")
            .select("article_id", "title", "article_text", "hyperpartisan", "bias"))


def merged_articles(articles_raw: DataFrame, truth_raw: DataFrame, id_mode: str = "quarantine") -> DataFrame:
    """The merged table (before relabelling)."""
    return merge(clean_articles(articles_raw, id_mode), clean_truth(truth_raw, id_mode))


def relabelled(merged: DataFrame) -> DataFrame:
    """P10 -> P11: blanks filled, centre biases folded into left/right."""
    return relabel(merged.na.fill("", subset=["title", "article_text", "bias"]), "bias")
