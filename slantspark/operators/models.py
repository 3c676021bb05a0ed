"""Classical detector M3, M4, M6-M10, plus model save/open S11/S12.

Classes are numbered in alphabetical order (so probability vectors list
classes like the reference's sorted ``classes_``), the 26 features stand in
table order, and the prediction is turned back into a class name.  The tree
is a Spark ML ``Pipeline``; the forest is ``operators.forest``, as Spark ML
sends the statistics of all nodes from each partition and the whole forest of
node objects with each task.  Training runs on executors; scoring is narrow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantspark.functions.text import format_prediction
from slantspark.operators import features as FE
from slantspark.operators import forest as FO
from slantspark.operators import metrics as A

# Spark caps tree depth at 30 (the reference grows unbounded trees).
MAX_DEPTH = 30


NUM_TREES = 100

# A fitted forest or a fitted pipeline of the tree.
Model = FO.Forest | PipelineModel


def tree_pipeline(features: list[str] | None = None, label: str = "label", seed: int = 42, min_rows: int = 1) -> Pipeline:
    """Indexer -> assembler -> decision tree."""
    feats = features or FE.FEATURE_COLUMNS
    # handleInvalid="error": an extra "unknown" index would add a class (and a
    # probability) to every model; training rows carry known labels only, and
    # scoring new text skips this stage (no label column).
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc",
                            handleInvalid="error")
    assembler = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    # Deep trees: cache node ids per row instead of re-walking the tree at each level, and give each level's split
    # statistics more room so fewer passes over the data are needed.
    clf = DecisionTreeClassifier(featuresCol="features", labelCol="label_index", maxDepth=MAX_DEPTH, seed=seed,
                                 minInstancesPerNode=min_rows, maxBins=64, cacheNodeIds=True, maxMemoryInMB=1024)
    return Pipeline(stages=[indexer, assembler, clf])


def with_prediction_label(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Adds ``predicted_label`` (class name) from the fitted indexer's labels."""
    labels = model.stages[0].labels
    return IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels).transform(scored)


def bounded(train: DataFrame, fit_rows: int | None, id_col: str = "article_id", seed: int = 42) -> DataFrame:
    """About ``fit_rows`` rows, chosen by a hash of the id (None: all)."""
    if fit_rows is None:
        return train
    share = fit_rows / max(1, train.count())
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000))
    return train.where(h < int(share * 1_000_000))


def fit_one(name: str, labelled: DataFrame, label: str = "label", min_rows: int = 1, seed: int = 42) -> Model:
    """One model by its name, on rows that have a label."""
    if name == "RandomForest":
        return FO.fit(labelled, FE.FEATURE_COLUMNS, label, NUM_TREES, seed, MAX_DEPTH, min_rows)
    if name == "DecisionTree":
        return tree_pipeline(label=label, seed=seed, min_rows=min_rows).fit(labelled)
    raise ValueError(f"unknown model {name}")


def fit_all(train: DataFrame, names: tuple[str, ...] = ("RandomForest", "DecisionTree"), label: str = "label",
            fit_rows: int | None = None, min_rows: int = 1) -> dict[str, Model]:
    """M6: fit every tree model on one cached training frame (KNN keeps its table, see ``operators.knn``).

    A tree of depth 30 grows with its rows; the fitted models lie on the driver and with each scoring worker.  ``fit_rows`` (default off)
    bounds the labelled rows used to fit, ``min_rows`` the rows a leaf must hold.
    """
    labelled = bounded(train.where(F.col(label).isNotNull() & (F.col(label) != "")), fit_rows).cache()
    try:
        return {n: fit_one(n, labelled, label, min_rows) for n in names}
    finally:
        labelled.unpersist()


def predict(model: Model, df: DataFrame) -> DataFrame:
    """M7: class name, class index and probability vector for every row."""
    if isinstance(model, FO.Forest):
        return model.transform(df)
    return with_prediction_label(model, model.transform(df))


def summaries(scored: dict[str, DataFrame]) -> DataFrame:
    """M8: accuracy and weighted P/R/F1 per model, one row per model, from (label, prediction) tables."""
    rows = [A.summary(s).select(F.lit(n).alias("model"), "*") for n, s in scored.items()]
    return reduce(DataFrame.unionByName, rows)


def reports(scored: dict[str, DataFrame]) -> DataFrame:
    """M8: the classification report of every model, with the model's name in front."""
    rows = [A.classification_report(s).select(F.lit(n).alias("model"), "*") for n, s in scored.items()]
    return reduce(DataFrame.unionByName, rows)


def class_order(model: Model) -> list[str]:
    """Classes in probability-vector order (alphabetical)."""
    if isinstance(model, FO.Forest):
        return list(model.labels)
    return list(model.stages[0].labels)


def predict_text(model: Model, texts: DataFrame, text_col: str = "article_text",
                 keep: list[str] | None = None) -> DataFrame:
    """M9 + M10 + T14: raw text -> features -> forest -> ``label,p0,p1,...``."""
    keep = keep or []
    feats = FE.extract_features(texts, text_col, keep=keep)
    scored = predict(model, feats)
    return scored.select(*keep, F.col("predicted_label").alias("prediction"),
                         format_prediction(F.col("predicted_label"), vector_to_array(F.col("probability"))).alias("result"))


def save_model(model: Model, path: str) -> str:
    """S11."""
    if isinstance(model, FO.Forest):
        return model.save(path)
    model.write().overwrite().save(path)
    return path


def _exists(path: str) -> bool:
    spark = SparkSession.getActiveSession()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def model_stored(path: str) -> bool:
    """Whether something is stored at ``path``; says so if not."""
    if _exists(path):
        return True
    print(f"no model is stored at {path}")
    return False


def open_model(path: str) -> Model | None:
    """The loaded model, or None (with a note) when nothing is stored at ``path``."""
    if not model_stored(path):
        return None
    return FO.Forest.open(path) if _exists(f"{path}/forest") else PipelineModel.load(path)
