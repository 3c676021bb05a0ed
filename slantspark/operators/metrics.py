"""Evaluation metrics A1-A6 as aggregations over (label, prediction) tables.

Every metric starts from one grouped aggregation with map-side partial
counts (per class, or per label x prediction pair), so the per-class
arithmetic afterwards touches a handful of rows and the scored input is
evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """A1: one row, ``accuracy``."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion_long(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """A2 (long form): label, prediction, n."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(F.count("*").alias("n"))


def class_names(df: DataFrame, *cols: str) -> list[str]:
    """The distinct class names of label columns, sorted (a handful of names on the driver)."""
    names = F.explode(F.array(*[F.col(c).cast("string") for c in cols]))
    return sorted(r[0] for r in df.select(names.alias("c")).where("c IS NOT NULL").distinct().collect())


def confusion_matrix(df: DataFrame, classes: list[str] | None = None, label: str = "label", pred: str = "prediction") -> DataFrame:
    """A2 (wide form): one row per true label, one column per class that occurs on either side."""
    classes = classes or class_names(df, label, pred)
    return (confusion_long(df, label, pred).groupBy("label").pivot("prediction", classes)
            .agg(F.sum("n")).na.fill(0))


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_counts(df: DataFrame, label: str = "label", pred: str = "prediction", nll: str | None = None) -> DataFrame:
    """Per class: support, predicted and true-positive counts (and summed loss) in ONE aggregation.

    Every row contributes its label side and its prediction side (an
    ``explode`` of two structs), so no joins are needed and the upstream plan
    is evaluated once.
    """
    loss = F.col(nll).cast("double") if nll else F.lit(None).cast("double")
    sides = F.array(
        F.struct(F.col(label).alias("cls"), F.lit(1).alias("s"), (F.col(label) == F.col(pred)).cast("int").alias("t"),
                 F.lit(0).alias("p"), loss.alias("l")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(1).alias("p"),
                 F.lit(None).cast("double").alias("l")))
    e = df.select(F.explode(sides).alias("e")).select("e.*")
    return e.groupBy("cls").agg(F.sum("s").cast("long").alias("support"), F.sum("p").cast("long").alias("predicted"),
                                F.sum("t").cast("long").alias("tp"), F.sum("l").alias("nll"))


def per_class(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per-class tp/support/predicted and precision, recall, F1 (zero when undefined)."""
    t = class_counts(df, label, pred)
    p = _safe_div(F.col("tp"), F.col("predicted"))
    r = _safe_div(F.col("tp"), F.col("support"))
    return t.select("cls", "tp", "support", "predicted", p.alias("precision"), r.alias("recall"),
                    _safe_div(2 * p * r, p + r).alias("f1_score"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction", digits: int = 6) -> DataFrame:
    """A3: class, precision, recall, f1_score, support + 'macro avg' and 'weighted avg' rows."""
    pc = per_class(df, label, pred)
    rows = pc.select(F.col("cls").alias("class"), "precision", "recall", "f1_score",
                     F.col("support").cast("long").alias("support"))
    total = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                   total.cast("long").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("class"),
                      (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                      (F.sum(F.col("f1_score") * F.col("support")) / total).alias("f1_score"),
                      total.cast("long").alias("support"))
    out = rows.unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, digits).alias(c) for c in ["precision", "recall", "f1_score"]], "support")


def weighted_prf(df: DataFrame, label: str = "label", pred: str = "prediction", digits: int = 6) -> DataFrame:
    """A4: support-weighted precision, recall, F1 (one row)."""
    pc = per_class(df, label, pred)
    total = F.sum("support")
    return pc.agg(*[F.round(F.sum(F.col(m) * F.col("support")) / total, digits).alias(m)
                    for m in ["precision", "recall", "f1_score"]])


def nll(p: Column, eps: float = 1e-15) -> Column:
    """Negative log of the true class's probability, clipped like common log-loss implementations."""
    return -F.log(F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps)))


def true_class_nll(label_index: str = "label_index", probability: str = "probability", eps: float = 1e-15) -> Column:
    """``nll`` from a probability vector and the true class's index."""
    from pyspark.ml.functions import vector_to_array
    return nll(F.element_at(vector_to_array(F.col(probability)), F.col(label_index).cast("int") + 1), eps)


def log_loss(df: DataFrame, label_index: str = "label_index", probability: str = "probability",
             eps: float = 1e-15) -> DataFrame:
    """A5: mean negative log probability of the true class (one row)."""
    return df.agg(F.avg(true_class_nll(label_index, probability, eps)).alias("log_loss"))


def summary(df: DataFrame, label: str = "label", pred: str = "prediction", nll: str | None = None,
            digits: int = 6) -> DataFrame:
    """A1 + A4 (+ A5 when ``nll`` names a per-row loss column) in one row,
    from the single-pass class counts."""
    t = class_counts(df, label, pred, nll)
    p = _safe_div(F.col("tp"), F.col("predicted"))
    r = _safe_div(F.col("tp"), F.col("support"))
    t = t.select("*", p.alias("p"), r.alias("r"), _safe_div(2 * p * r, p + r).alias("f"))
    total = F.sum("support")
    out = [F.round(F.sum("tp") / total, digits).alias("accuracy")]
    out += [F.round(F.sum(F.col(m) * F.col("support")) / total, digits).alias(name)
            for m, name in [("p", "precision"), ("r", "recall"), ("f", "f1_score")]]
    if nll:
        out.append(F.round(F.sum("nll") / total, digits).alias("log_loss"))
    return t.agg(*out)


def argmax(values: Column) -> Column:
    """0-based index of the largest element, first one on ties."""
    return F.array_position(values, F.array_max(values)) - 1
