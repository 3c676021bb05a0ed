"""Lifecycle B: train, test, predict and save the classical detector.

    features --M1--> train / test
    train --M6--> forest, tree ; exact KNN keeps the train table
    test  --M7/M8--> accuracy + weighted P/R/F1 + report per model
    text  --T6/K*/F27--> forest -> 'label,p0,p1,p2'          (M9, M10, T14)
    save / open: both models + the KNN train table as parquet
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantspark.operators import features as FE
from slantspark.operators import knn as KN
from slantspark.operators import models as MD
from slantspark.operators import split as SP
from slantspark.session import cut_lineage


@dataclass
class Detector:
    models: dict[str, MD.Model] = field(default_factory=dict)
    train_table: DataFrame | None = None
    test_table: DataFrame | None = None

    def train(self, features: DataFrame, test_percent: int = 20, seed: int = 42, fit_rows: int | None = None) -> Detector:
        """Split the feature table by id hash and fit forest and tree (on at most about ``fit_rows`` rows); KNN needs no fit."""
        ft = cut_lineage(features.where(F.col("label").isNotNull() & (F.col("label") != "")), "detector-features")
        self.train_table, self.test_table = SP.train_test_split(ft, "article_id", test_percent, seed)
        self.models = MD.fit_all(self.train_table, fit_rows=fit_rows)
        return self

    def _scored(self, name: str, df: DataFrame) -> DataFrame:
        if name == "KNN":
            return KN.knn_predict(self.train_table, df, FE.FEATURE_COLUMNS, "article_id", "label")
        return MD.predict(self.models[name], df).select("article_id", "label", F.col("predicted_label").alias("prediction"))

    def scored(self) -> dict[str, DataFrame]:
        """The test rows scored by each model, each written once (summary and report read them in several branches)."""
        if self.test_table is None:
            raise ValueError("train first: there is no held-out table to test on")
        return {n: cut_lineage(self._scored(n, self.test_table), f"scored-{n}") for n in (*self.models, "KNN")}

    def test(self) -> tuple[DataFrame, DataFrame]:
        """One summary row per model, and the classification report of every model."""
        scored = self.scored()
        return MD.summaries(scored), MD.reports(scored)

    def predict(self, texts: DataFrame, text_col: str = "article_text", keep: list[str] | None = None) -> DataFrame:
        """The forest's 'label,p0,p1,...' for every text (reference: forest only)."""
        return MD.predict_text(self.models["RandomForest"], texts, text_col, keep)

    def save(self, path: str) -> str:
        for name, m in self.models.items():
            MD.save_model(m, f"{path}/{name}")
        self.train_table.write.mode("overwrite").parquet(f"{path}/knn_train")
        return path

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Detector | None:
        models = {n: MD.open_model(f"{path}/{n}") for n in ("RandomForest", "DecisionTree")}
        if any(m is None for m in models.values()):
            return None
        return cls(models=models, train_table=spark.read.parquet(f"{path}/knn_train"))
