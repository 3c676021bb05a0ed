"""Lifecycle A: build the labelled dataset and its feature table.

    articles_raw --P5,P6,P8--> articles --+
                                          +--J1--> merged --P10,P11--> relabelled --F27--> features
    ground_truth_raw --P8, prune---------+

One join (Spark broadcasts the pruned label side by its bytes), then narrow
per-row work.  ``build`` writes the checkpoints the reference keeps as files
(merged table, feature table) as parquet or CSV, its printed profile as a table,
and the ids it leaves out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantspark.operators import features as FE
from slantspark.operators import prepare as PR
from slantspark.operators import quality as Q
from slantspark.sources import delimited as D
from slantspark.sources import tables as T
from slantspark.session import spread

BROADCAST_IDS = 2_000_000  # 16 bytes an id


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles_raw(spark, sf_dir)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ground_truth_raw(spark, sf_dir)


def merged(spark: SparkSession, sf_dir: str, id_mode: str = "quarantine") -> DataFrame:
    return PR.merged_articles(articles(spark, sf_dir), truth(spark, sf_dir), id_mode)


def relabelled(spark: SparkSession, sf_dir: str, id_mode: str = "quarantine") -> DataFrame:
    return PR.relabelled(merged(spark, sf_dir, id_mode))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, label): the relabelled bias of every valid ground-truth row."""
    t = PR.relabel(PR.clean_truth(truth(spark, sf_dir)).na.fill("", subset=["bias"]), "bias")
    return t.select("article_id", F.col("bias").alias("label"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27 over the relabelled merged table; no join moves article text.

    Articles without a label leave by a broadcast of the labelled ids, if these are counted to be few, and the others are dealt
    over all tasks.  Only the 28 narrow columns meet the labels; Spark picks that join by the bytes of the label side.
    Duplicate ids multiply as in the merge.
    """
    lab, texts = labels(spark, sf_dir), spread(PR.clean_articles(articles(spark, sf_dir)).select("article_id", "article_text"))
    known = lab.select("article_id").distinct()
    if known.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(known), "article_id", "left_semi")
    feats = FE.extract_features(texts, "article_text", keep=["article_id"])
    return (feats.join(lab, "article_id", "inner")
            .select("label", "article_id", *FE.FEATURE_COLUMNS))


def profile(articles_raw: DataFrame, truth_raw: DataFrame, merged_table: DataFrame) -> DataFrame:
    """(check, value, n): the counts the reference prints while it builds the dataset, in long form.

    Nulls per column, valid and invalid ids of both sides, and the rows of every label of the merged table.
    """
    def long(df: DataFrame, check: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("value"), F.col(c).cast("long").alias("n")) for c in df.columns]))
        return df.select(F.lit(check).alias("check"), pairs.alias("p")).select("check", "p.value", "p.n")

    parts = [long(Q.null_counts(articles_raw, ["article_id", "title", "article_text"]), "article nulls"),
             long(Q.null_counts(truth_raw, ["article_id", "bias"]), "truth nulls"),
             long(Q.valid_id_counts(articles_raw), "article ids"), long(Q.valid_id_counts(truth_raw), "truth ids"),
             merged_table.groupBy(F.coalesce("bias", F.lit("(null)")).alias("value")).agg(F.count("*").alias("n"))
             .select(F.lit("merged labels").alias("check"), "value", "n")]
    return reduce(DataFrame.unionByName, parts)


def write_table(df: DataFrame, path: str, form: str) -> str:
    if form == "csv":
        return D.write_csv(df, path)
    df.write.mode("overwrite").parquet(path)
    return path


def read_table(spark: SparkSession, path: str, form: str, schema) -> DataFrame:
    return D.read_csv(spark, path, schema) if form == "csv" else spark.read.parquet(path)


def build_from(articles_raw: DataFrame, truth_raw: DataFrame, out_dir: str, form: str = "parquet",
               id_mode: str = "quarantine") -> dict[str, str]:
    """Write the merged table (raw biases), the relabelled one and the feature table, with the profile and the ids
    that quarantine left out; features are computed from the written table."""
    spark = articles_raw.sparkSession
    paths = {n: f"{out_dir}/{n}" for n in ("merged_raw", "merged", "features", "profile", "rejected_ids")}
    write_table(PR.merged_articles(articles_raw, truth_raw, id_mode), paths["merged_raw"], form)
    raw = read_table(spark, paths["merged_raw"], form, D.MERGED_SCHEMA)
    write_table(PR.relabelled(raw), paths["merged"], form)
    write_table(FE.feature_table(read_table(spark, paths["merged"], form, D.MERGED_SCHEMA)), paths["features"], form)
    profile(articles_raw, truth_raw, raw).write.mode("overwrite").parquet(paths["profile"])
    PR.rejected_ids(articles_raw, truth_raw).write.mode("overwrite").parquet(paths["rejected_ids"])
    return paths


def build(spark: SparkSession, sf_dir: str, out_dir: str, form: str = "parquet") -> dict[str, str]:
    """Lifecycle A over the driver's tables."""
    return build_from(articles(spark, sf_dir), truth(spark, sf_dir), out_dir, form)
