"""Lifecycle C: the text classifier (clean -> encode -> split -> fit -> evaluate -> predict)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantspark.operators import metrics as A
from slantspark.operators import split as SP
from slantspark.operators import textclf as TC
from slantspark.session import cut_lineage


@dataclass
class TextClassifier:
    n_labels: int = 3
    model: TC.TextModel | None = None
    eval_table: DataFrame | None = None

    def train(self, merged: DataFrame, max_iter: int = 30, strict: bool = False) -> TextClassifier:
        """``merged``: article_id, article_text, bias (relabelled for 3 classes, raw for 5); ``strict`` raises on an unknown bias."""
        data = cut_lineage(TC.prepare(merged, n_labels=self.n_labels, strict=strict).select("article_id", "words", "labels"),
                           "textclf-data")
        train, self.eval_table = SP.train_eval_split(data, "article_id")
        self.model = TC.train(train, max_iter=max_iter, n_labels=self.n_labels)
        return self

    def evaluate(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(log loss / accuracy / weighted P-R-F1 row, confusion counts, classification report)."""
        scored = cut_lineage(TC.scored(self.model, self.eval_table), "textclf-scored")
        named = scored.select(TC.decode_label(F.col("label"), self.n_labels).alias("label"),
                              TC.decode_label(F.col("prediction"), self.n_labels).alias("prediction"))
        summary = A.summary(scored, nll="nll").select("log_loss", "accuracy", "precision", "recall", "f1_score")
        return summary, A.confusion_long(named), A.classification_report(named)

    def predict(self, texts: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        return TC.predict(self.model, texts, text_col, keep, self.n_labels)

    def save(self, path: str) -> str:
        return self.model.save(path)

    @classmethod
    def open(cls, path: str, n_labels: int = 3) -> TextClassifier | None:
        m = TC.TextModel.open(path)
        return None if m is None else cls(n_labels=n_labels, model=m)
