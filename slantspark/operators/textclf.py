"""Text classifier M11-M17.

The reference fine-tunes a transformer on one machine.  Here the same
workflow runs over the T13-cleaned text:

    clean (T13) -> label encode (M11/M13) -> hash split (M2)
      -> words -> TF-IDF of all words -> multinomial logistic regression on a coefficient table (M15)
      -> evaluate (M16: loss, accuracy, weighted P/R/F1, confusion, report)
      -> predict raw text -> class name (M17, M12)

``vocab_encode`` (M14) is the token-id encoding job: the whole vocabulary counted
with map-side partial aggregation, ranked, and joined back to the first ``max_len - 2``
token positions of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slantspark.functions.patterns import WS_RUN
from slantspark.functions.text import preprocess_text_classifier
from slantspark.operators import metrics as A
from slantspark.operators import table_logistic as TL
from slantspark.operators.models import model_stored
from slantspark.session import cut_lineage

# --- fixed values -----------------------------------------------------------
# Class codes of the three-class and five-class label sets.
LABELS_3 = {"least": 0, "right": 1, "left": 2}
LABELS_5 = {"least": 0, "right": 1, "left": 2, "right-center": 3, "left-center": 4}
INVALID_LABEL = "Invalid predicted label"
# --- end of fixed values ------------------------------------------------------

# Special ids of our own vocabulary encoding.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_WORD_ID = 4


def label_set(n_labels: int = 3) -> dict[str, int]:
    if n_labels == 3:
        return LABELS_3
    if n_labels == 5:
        return LABELS_5
    raise ValueError("n_labels must be 3 or 5")


def encode_label(col: Column, n_labels: int = 3, strict: bool = False) -> Column:
    """Name -> code; unknown names are 0 (reference), or raise with ``strict``."""
    expr = None
    for name, code in label_set(n_labels).items():
        expr = F.when(col == name, F.lit(code)) if expr is None else expr.when(col == name, F.lit(code))
    other = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(col, F.lit("NULL")))) if strict else F.lit(0)
    return expr.otherwise(other).cast("int")


def decode_label(col: Column, n_labels: int = 3) -> Column:
    """Code -> name, otherwise 'Invalid predicted label'."""
    expr = None
    for name, code in label_set(n_labels).items():
        expr = F.when(col == code, F.lit(name)) if expr is None else expr.when(col == code, F.lit(name))
    return expr.otherwise(F.lit(INVALID_LABEL))


def prepare(df: DataFrame, text_col: str = "article_text", label_col: str = "bias", n_labels: int = 3,
            strict: bool = False) -> DataFrame:
    """T13 text, its words and the integer label (the encoded training table without token ids)."""
    return (df.select("*", preprocess_text_classifier(F.col(text_col)).alias("clean_text"),
                      encode_label(F.col(label_col), n_labels, strict).alias("labels"))
            .withColumn("words", words(F.col("clean_text"))))


def idf_vocabulary(texts: DataFrame, words_col: str = "words") -> DataFrame:
    """(word, id, idf) of every word: ln((rows + 1) / (rows with the word + 1))."""
    rows = texts.count()
    holding = texts.select(F.explode(F.array_distinct(words_col)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return (cut_lineage(holding.select("word", F.log((F.lit(float(rows)) + 1) / (F.col("df") + 1)).alias("idf"), F.monotonically_increasing_id().alias("id")), "textclf-words"))


@dataclass
class TextModel:
    """Coefficients (word, idf, w) of every training word as a table, and the intercepts, one a class."""
    table: DataFrame
    intercepts: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (vector) and ``prediction``; words that were not learned count for nothing."""
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "textclf-scoring")
        z = TL.margins(rows.select("_row", "words"), self.table, self.intercepts).withColumnRenamed("z", "_z")
        bare = F.array(*[F.lit(b) for b in self.intercepts])
        out = rows.join(z, "_row", "left").withColumn("_p", TL.softmax(F.coalesce("_z", bare)))
        return (out.withColumn("probability", array_to_vector("_p")).withColumn("prediction", A.argmax(F.col("_p")).cast("double"))
                .drop("_row", "_z", "_p"))

    def save(self, path: str) -> str:
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").parquet(f"{path}/coefficients")
        spark.createDataFrame([(self.intercepts,)], "w array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/intercepts")
        return path

    @classmethod
    def open(cls, path: str) -> TextModel | None:
        """The stored model, or None (with a note) when nothing is stored at ``path``."""
        if not model_stored(path):
            return None
        spark = SparkSession.getActiveSession()
        return cls(spark.read.parquet(f"{path}/coefficients"), list(spark.read.parquet(f"{path}/intercepts").first()["w"]))


def train(train_df: DataFrame, max_iter: int = 50, reg: float = 1e-4, n_labels: int | None = None) -> TextModel:
    """Fit on a table from ``prepare``; as many classes as ``n_labels``, or as the largest code needs."""
    rows = cut_lineage(train_df.where(F.col("labels").isNotNull()).select(F.monotonically_increasing_id().alias("_row"), "words", F.col("labels").cast("int").alias("label")),
                       "textclf-train")
    classes = n_labels or max(2, (rows.agg(F.max("label").alias("m")).first()["m"] or 0) + 1)
    vocab = idf_vocabulary(rows)
    coefficients, _ = TL.fit(rows, vocab, classes, max_iter=max_iter, reg=reg)
    intercepts = list(coefficients.where(F.col("id") == TL.BIAS).first()["w"])
    return TextModel(cut_lineage(vocab.join(coefficients, "id").select("word", "idf", "w"), "textclf-model"), intercepts)


def scored(model: TextModel, eval_df: DataFrame) -> DataFrame:
    """(label, prediction, nll): class codes and the loss of every evaluation row."""
    out = model.transform(eval_df.withColumn("labels", F.col("labels").cast("double")))
    return out.select(F.col("labels").cast("int").alias("label"), A.argmax(vector_to_array("probability")).cast("int").alias("prediction"),
                      A.true_class_nll("labels", "probability").alias("nll"))


def evaluate(model: TextModel, eval_df: DataFrame, n_labels: int = 3) -> DataFrame:
    """One row with log_loss, accuracy and weighted precision/recall/F1."""
    return A.summary(scored(model, eval_df), nll="nll").select("log_loss", "accuracy", "precision", "recall", "f1_score")


def predict(model: TextModel, texts: DataFrame, text_col: str = "text", keep: list[str] | None = None,
            n_labels: int = 3) -> DataFrame:
    """Raw text -> cleaned -> class code (arg max, A6) -> class name."""
    keep = keep or []
    t = texts.select(*keep, preprocess_text_classifier(F.col(text_col)).alias("clean_text"))
    cls = A.argmax(vector_to_array(F.col("probability")))
    return model.transform(t.withColumn("words", words(F.col("clean_text")))).select(*keep, cls.cast("int").alias("predicted_class"),
                         decode_label(cls, n_labels).alias("predicted_label"))


def words(col: Column) -> Column:
    """Whitespace word split of T13 text: the one notion of a word in this module."""
    return F.filter(F.split(col, WS_RUN), lambda w: w != "")


def vocabulary(texts: DataFrame, words_col: str = "words") -> DataFrame:
    """(token, id, n): every word of the texts, ids by (count desc, token).

    The counts are range-partitioned and sorted; a word's rank is its place in its partition plus
    the sizes of the partitions before, so no task sees the whole vocabulary.
    """
    counts = (texts.select(F.explode(words_col).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    ranked = cut_lineage(counts.repartitionByRange(F.col("n").desc(), "token").sortWithinPartitions(F.col("n").desc(), "token")
                         .withColumn("mid", F.monotonically_increasing_id()), "vocabulary")
    part = F.shiftright("mid", 33)                       # partition number above, place inside below
    sizes = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row a partition
    place = F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranked.withColumn("part", part).join(F.broadcast(before), "part")
            .select("token", (F.col("before") + place + FIRST_WORD_ID).cast("int").alias("id"), "n"))


def vocab_encode(texts: DataFrame, key: str, vocab: DataFrame, words_col: str = "words",
                 max_len: int = 512) -> DataFrame:
    """(key, input_ids, attention_mask), CLS + first max_len-2 words + SEP, PAD to max_len.

    Each text row gets its own row id, so the regrouping after the vocabulary
    lookup holds at most ``max_len - 2`` entries per group even when a key is
    repeated; ``posexplode_outer`` keeps texts without words, so no join back
    is needed.  The lookup is a plain join: Spark broadcasts the vocabulary by its bytes, and a larger
    one is joined by a shuffle whose frequent words AQE splits.
    """
    body = max_len - 2
    rows = texts.select(key, F.monotonically_increasing_id().alias("_row"),
                        F.slice(F.col(words_col), 1, body).alias("_w"))      # id fixed before the explode
    pos = rows.select(key, "_row", F.posexplode_outer("_w").alias("pos", "token"))
    ids = (pos.join(vocab.select("token", "id"), "token", "left")
           .select(key, "_row", "pos", F.when(F.col("pos").isNotNull(), F.coalesce("id", F.lit(UNK))).alias("id")))
    seqs = (ids.groupBy("_row")
            .agg(F.first(key).alias(key),
                 F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("s")))
    body_ids = F.transform("s", lambda e: e["id"])
    ids_full = F.concat(F.array(F.lit(CLS)), body_ids, F.array(F.lit(SEP)))
    full = seqs.select(key, ids_full.alias("ids"))
    n = F.size("ids")
    return full.select(
        key,
        F.concat("ids", F.array_repeat(F.lit(PAD), F.lit(max_len) - n)).cast("array<int>").alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n)).cast("array<int>").alias("attention_mask"),
    )
