"""Registered queries: one per operator group of the inventory.

Each query takes ``(spark, sf_dir)``, reads the driver's parquet tables in
full and returns a DataFrame whose columns match the oracle SQL in
``plans.oracles``.  ``documents`` plays the article table, ``labels`` the
ground truth (mapping in ``sources.tables``), ``pages`` exercises URL and tag
stripping (the url is prefixed so URLs actually occur), ``conversations``
is a batch of raw texts to score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantspark.functions import text as TX
from slantspark.operators import features as FE
from slantspark.operators import quality as Q
from slantspark.plans import dataset as DS
from slantspark.session import spread
from slantspark.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents")


def doc_features(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    d = spread(documents(spark, sf_dir).select("doc_id", F.col("text").alias("article_text")))
    return FE.extract_features(d, "article_text", keep=["doc_id"]).select("doc_id", *cols)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.lit("see "), F.col("url"), F.lit(" ok "), F.col("html")).alias("raw"))


# --- profiling and filters (P1-P8) -------------------------------------------------

@query
def article_null_profile(spark, sf_dir):
    """P1/P2 on the article table."""
    return Q.null_counts(T.articles_raw(spark, sf_dir), ["article_id", "title", "article_text"])


@query
def truth_null_profile(spark, sf_dir):
    """P1/P2 on the ground-truth table."""
    return Q.null_counts(T.ground_truth_raw(spark, sf_dir), ["article_id", "bias"])


def candidate_ids(spark, sf_dir) -> DataFrame:
    """Every document id as text plus every ``source`` value (never numeric)."""
    d = documents(spark, sf_dir)
    return (d.select(F.col("doc_id").cast("string").alias("article_id"))
            .unionByName(d.select(F.col("source").alias("article_id"))))


@query
def valid_id_counts(spark, sf_dir):
    """P3/P4 counts."""
    return Q.valid_id_counts(candidate_ids(spark, sf_dir), "article_id")


@query
def invalid_ids(spark, sf_dir):
    """P4 rows: candidates that are not whole numbers, with their multiplicity."""
    return (Q.invalid_id_rows(candidate_ids(spark, sf_dir), "article_id")
            .groupBy("article_id").agg(F.count("*").alias("n")))


@query
def rejected_ids(spark, sf_dir):
    """The ids that quarantine leaves out of the merge, per side, with their multiplicity."""
    from slantspark.operators import prepare as PR
    lab = T.ground_truth_raw(spark, sf_dir)
    truth_ids = lab.select("article_id").unionByName(lab.select(F.col("bias").alias("article_id")))
    return PR.rejected_ids(candidate_ids(spark, sf_dir), truth_ids)


@query
def dataset_profile(spark, sf_dir):
    """The counts of the dataset build in long form."""
    return DS.profile(DS.articles(spark, sf_dir), DS.truth(spark, sf_dir), DS.merged(spark, sf_dir))


@query
def distinct_bias(spark, sf_dir):
    """P7."""
    return Q.distinct_values(T.ground_truth_raw(spark, sf_dir), "bias")


# --- join and reshaping (P6-P14, J1) -------------------------------------------------

@query
def merged_articles(spark, sf_dir):
    """P5/P6/P8 + J1 + P9."""
    return DS.merged(spark, sf_dir)


@query
def relabelled(spark, sf_dir):
    """P10 + P11 on the merged table."""
    return DS.relabelled(spark, sf_dir)


@query
def bias_counts(spark, sf_dir):
    """Class balance after relabelling (the label distribution the models see)."""
    return DS.relabelled(spark, sf_dir).groupBy("bias").agg(F.count("*").alias("n"))


# --- cleaning (T1-T13) ----------------------------------------------------------------------

@query
def clean_text(spark, sf_dir):
    """T6 on every document."""
    return documents(spark, sf_dir).select("doc_id", TX.preprocess_features("text").alias("clean_text"))


@query
def clean_pages(spark, sf_dir):
    """T6 on 'see <url> ok <html>': URL and tag removal actually fire."""
    return page_text(spark, sf_dir).select("page_id", TX.preprocess_features("raw").alias("clean_text"))


@query
def clean_text_dl(spark, sf_dir):
    """T13 on every document."""
    return documents(spark, sf_dir).select("doc_id", TX.preprocess_text_classifier("text").alias("clean_text"))


@query
def clean_pages_dl(spark, sf_dir):
    """T13 on 'see <url> ok <html>'."""
    return page_text(spark, sf_dir).select("page_id", TX.preprocess_text_classifier("raw").alias("clean_text"))


# --- features (K1-K8, F1-F27) ---------------------------------------------------------------

@query
def token_features(spark, sf_dir):
    """K1, K7, K8 -> F1-F3, F13, F14, F19."""
    return doc_features(spark, sf_dir, ["word_count", "unique_words_count", "avg_word_length",
                                         "punctuation_count", "digits_count", "numeric_count"])


@query
def char_features(spark, sf_dir):
    """F20, F23, F24 on text with '.' -> '?' and ',' -> "'" so every count fires."""
    d = spread(documents(spark, sf_dir).select("doc_id", F.translate("text", ".,", "?'").alias("article_text")))
    return FE.extract_features(d, "article_text", keep=["doc_id"]).select(
        "doc_id", "quotes_count", "question_mark_count", "exclamation_count")


@query
def ngram_features(spark, sf_dir):
    """F21, F22."""
    return doc_features(spark, sf_dir, ["trigram_length", "bigram_length"])


@query
def sentence_features(spark, sf_dir):
    """K3 -> F4, F15."""
    return doc_features(spark, sf_dir, ["sentence_count", "avg_sentence_length"])


@query
def stopword_features(spark, sf_dir):
    """K6 -> F12."""
    return doc_features(spark, sf_dir, ["stop_words_count"])


@query
def pos_features(spark, sf_dir):
    """K2 -> F5-F10."""
    return doc_features(spark, sf_dir, ["verbs_count", "adjectives_count", "adverbs_count",
                                         "pronouns_count", "conjunctions_count", "nouns_count"])


@query
def unique_pos(spark, sf_dir):
    """K2 -> F25, F26."""
    return doc_features(spark, sf_dir, ["unique_adjectives", "unique_adverbs"])


@query
def noun_phrases(spark, sf_dir):
    """K5 -> F16, F17."""
    return doc_features(spark, sf_dir, ["noun_phrases_count", "avg_noun_phrase_length"])


@query
def entity_features(spark, sf_dir):
    """K4 -> F11, F18."""
    return doc_features(spark, sf_dir, ["entities_count", "avg_entity_length"])


@query
def all_doc_features(spark, sf_dir):
    """All 26 features for every document (labelled or not)."""
    return doc_features(spark, sf_dir, FE.FEATURE_COLUMNS)


@query
def feature_table(spark, sf_dir):
    """F27 + P13: label, article_id and the 26 features of the relabelled merged table."""
    return DS.features(spark, sf_dir)


@query
def default_label(spark, sf_dir):
    """A feature table built without a bias column has the label 'Unknown' everywhere."""
    return FE.feature_table(DS.relabelled(spark, sf_dir).drop("bias")).select("label", "article_id", "word_count")


@query
def conversation_features(spark, sf_dir):
    """Feature path on a second text source (every conversation turn)."""
    c = T.table(spark, sf_dir, "conversations")
    base = c.select("conv_id", "turn", F.col("text").alias("article_text"))
    return FE.extract_features(base, "article_text", keep=["conv_id", "turn"])


# --- tagger job (K2 fit) ---------------------------------------------------------------------

def tagged_corpus(spark, sf_dir) -> DataFrame:
    """Derived tagged corpus: every document token with its context tag."""
    from slantspark.operators import annotate as K
    d = documents(spark, sf_dir).select("doc_id", K.tokenize(TX.preprocess_features("text")).alias("tok"))
    d = d.select("tok", K.pos_tags("tok").alias("rule_tag"))          # tags computed once per row
    d = d.select("tok", K.context_tags("rule_tag").alias("tag"))
    return d.select(F.explode(F.arrays_zip("tok", "tag")).alias("z")).select("z.tok", "z.tag")


@query
def fit_tagger(spark, sf_dir):
    """K2 fit: most frequent tag per word of the derived tagged corpus."""
    from slantspark.operators import annotate as K
    return K.fit_tagger(tagged_corpus(spark, sf_dir))


@query
def fit_suffix_tagger(spark, sf_dir):
    """K2 fit, back-off level: most frequent tag per 3-letter suffix."""
    from slantspark.operators import annotate as K
    return K.fit_suffix_tagger(tagged_corpus(spark, sf_dir))


# --- splits (M1, M2) ----------------------------------------------------------------------------

@query
def hash_split(spark, sf_dir):
    """M1: 80/20 bucket of every labelled article."""
    from slantspark.operators import split as SP
    b = SP.bucket("article_id")
    return DS.relabelled(spark, sf_dir).select("article_id", b.alias("bucket"), (b < 20).alias("is_test"))


@query
def hash_split_dl(spark, sf_dir):
    """M2: 90/10 bucket."""
    from slantspark.operators import split as SP
    b = SP.bucket("article_id")
    return DS.relabelled(spark, sf_dir).select("article_id", b.alias("bucket"), (b < 10).alias("is_eval"))


# --- exact KNN and metrics (M5, A1-A4) -----------------------------------------------------------

def _knn(spark, sf_dir) -> DataFrame:
    """The 5 nearest labels of every test row, written once: the metric queries read them in several branches."""
    from slantspark.operators import knn as KN
    from slantspark.operators import split as SP
    from slantspark.session import cut_lineage
    # 28 numeric columns per article: cheap to materialise, and KNN reads it several times.
    ft = cut_lineage(DS.features(spark, sf_dir).where(F.col("label") != ""), "knn-features")
    train, test = SP.train_test_split(ft, "article_id", 20)
    return cut_lineage(KN.Neighbours(train, test, FE.FEATURE_COLUMNS, "article_id", "label", k=5).labels(), "knn-labels")


def knn_scored(spark, sf_dir) -> DataFrame:
    """KNN predictions (article_id, label, prediction)."""
    from slantspark.operators import knn as KN
    return _knn(spark, sf_dir).select(F.col("id").alias("article_id"), "label", KN.majority(F.col("votes")).alias("prediction"))


CLASSES = ["least", "left", "right"]  # class order of the relabelled table


def knn_shares(spark, sf_dir) -> DataFrame:
    from slantspark.operators import knn as KN
    return _knn(spark, sf_dir).select(F.col("id").alias("article_id"), "label", "votes", KN.shares(F.col("votes"), CLASSES).alias("p"))


@query
def knn_probabilities(spark, sf_dir):
    """M10 + T14 + A6 on KNN vote shares: 'label,p0,p1,p2' and the index of the largest share (first on ties)."""
    from slantspark.functions.text import format_prediction
    from slantspark.operators import knn as KN
    from slantspark.operators import metrics as A
    return knn_shares(spark, sf_dir).select("article_id", "label", format_prediction(KN.majority(F.col("votes")), "p").alias("result"),
                                            A.argmax(F.col("p")).cast("int").alias("argmax"))


@query
def knn_log_loss(spark, sf_dir):
    """A5 on KNN vote shares."""
    from slantspark.operators import metrics as A
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")).cast("int")
    return knn_shares(spark, sf_dir).agg(F.round(F.avg(A.nll(F.element_at("p", place))), 6).alias("log_loss"))


@query
def knn_predict(spark, sf_dir):
    """M5 + M7: exact 5-NN (Euclidean, unscaled, uniform vote) for the 20 % test split."""
    return knn_scored(spark, sf_dir)


@query
def accuracy(spark, sf_dir):
    """A1 on the KNN predictions."""
    from slantspark.operators import metrics as A
    return A.accuracy(knn_scored(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


@query
def confusion(spark, sf_dir):
    """A2 (long form) on the KNN predictions."""
    from slantspark.operators import metrics as A
    return A.confusion_long(knn_scored(spark, sf_dir))


@query
def class_report(spark, sf_dir):
    """A3 on the KNN predictions."""
    from slantspark.operators import metrics as A
    return A.classification_report(knn_scored(spark, sf_dir))


@query
def weighted_prf(spark, sf_dir):
    """A4 on the KNN predictions."""
    from slantspark.operators import metrics as A
    return A.weighted_prf(knn_scored(spark, sf_dir))


# --- label codes and token ids (M11-M14) -----------------------------------------------------------

@query
def label_encode(spark, sf_dir):
    """Three-class codes of the relabelled table."""
    from slantspark.operators import textclf as TC
    r = DS.relabelled(spark, sf_dir)
    return r.select("article_id", "bias", TC.encode_label(F.col("bias"), 3).alias("labels"))


@query
def five_class(spark, sf_dir):
    """Five-class codes of the merged table (centre biases kept)."""
    from slantspark.operators import textclf as TC
    m = DS.merged(spark, sf_dir).na.fill("", subset=["bias"])
    return m.select("article_id", "bias", TC.encode_label(F.col("bias"), 5).alias("labels"))


@query
def label_decode(spark, sf_dir):
    """Five-class codes decoded with the three-class names (3, 4 -> invalid)."""
    from slantspark.operators import textclf as TC
    m = DS.merged(spark, sf_dir).na.fill("", subset=["bias"])
    code = TC.encode_label(F.col("bias"), 5)
    return m.select("article_id", code.alias("labels"), TC.decode_label(code, 3).alias("predicted_label"))


@query
def vocab_encode(spark, sf_dir):
    """Vocabulary job + fixed-length id encoding of every document (ids as text)."""
    from slantspark.operators import textclf as TC
    from slantspark.session import cut_lineage
    t = cut_lineage(documents(spark, sf_dir).select("doc_id", TC.words(TX.preprocess_text_classifier("text")).alias("words")), "words")
    enc = TC.vocab_encode(t, "doc_id", TC.vocabulary(t), max_len=512)
    return enc.select("doc_id", F.array_join("input_ids", " ").alias("ids_text"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"))


# --- sources and sinks (S1-S7) -----------------------------------------------------------------

def _scratch(spark, name: str) -> str:
    from slantspark.session import scratch_path
    return scratch_path(spark, name)


@query
def xml_articles(spark, sf_dir):
    """S1 + S2 (lead mode): documents written as article XML, scanned back, text extracted."""
    from slantspark.sources import xml as X
    path = X.write_articles_xml(T.articles_raw(spark, sf_dir), _scratch(spark, "articles-xml"))
    return X.read_articles(spark, path, mode="lead")


@query
def xml_articles_full(spark, sf_dir):
    """S1 + S2 (full mode, document order, tails kept; JVM xpath)."""
    from slantspark.sources import xml as X
    path = X.write_articles_xml(T.articles_raw(spark, sf_dir), _scratch(spark, "articles-xml"))
    return X.read_articles(spark, path, mode="full")


@query
def xml_truth(spark, sf_dir):
    """S3: ground truth written with the XML writer (self-closing rows) and scanned back."""
    from slantspark.sources import xml as X
    path = X.write_truth_xml(T.ground_truth_raw(spark, sf_dir), _scratch(spark, "truth-xml"))
    return X.read_truth(spark, path)


def padded(df: DataFrame, text: str) -> DataFrame:
    """Texts that a delimited file is likely to change: edge spaces, the null mark, a backslash and line ends at the end."""
    return df.withColumn(text, F.concat(F.lit("  \\N"), F.col(text), F.lit("\t\"\\\r\n ")))


@query
def tsv_roundtrip(spark, sf_dir):
    """S4 + S5: the raw article table with hostile texts through our TSV."""
    from slantspark.sources import delimited as D
    raw = padded(T.articles_raw(spark, sf_dir), "article_text")
    raw = raw.withColumn("title", F.lit(" ")).withColumn("published_at", F.lit(None).cast("string"))
    path = D.write_tsv(raw, _scratch(spark, "articles-tsv"))
    return D.read_tsv(spark, path, D.ARTICLES_RAW_SCHEMA)


@query
def csv_roundtrip(spark, sf_dir):
    """S6 + S7: the relabelled merged table with hostile texts through our CSV."""
    from slantspark.sources import delimited as D
    raw = padded(DS.relabelled(spark, sf_dir), "article_text").withColumn("title", F.lit("\\N"))
    path = D.write_csv(raw, _scratch(spark, "merged-csv"))
    return D.read_csv(spark, path, D.MERGED_SCHEMA)


@query
def features_csv_roundtrip(spark, sf_dir):
    """S6 + S7: the feature table through CSV, as the training lifecycle reads it."""
    from slantspark.sources import delimited as D
    path = D.write_csv(DS.features(spark, sf_dir), _scratch(spark, "features-csv"))
    return D.read_csv(spark, path, D.FEATURES_SCHEMA)


# --- learned models (M3, M4, M6-M10, M15-M17, S11, S12, A5, A6): rows-only checks ------------------

def _feature_split(spark, sf_dir):
    from slantspark.operators import split as SP
    from slantspark.session import cut_lineage
    ft = cut_lineage(DS.features(spark, sf_dir).where(F.col("label") != ""))
    return SP.train_test_split(ft, "article_id", 20)


def _fit(spark, sf_dir, name: str):
    from slantspark.operators import models as MD
    train, test = _feature_split(spark, sf_dir)
    return MD.fit_all(train, (name,))[name], test


def _sums_to_one(p):
    return F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9


def _result_ok(classes: list[str]):
    """Whether a 'label,p0,p1,...' string names a known class and lists one probability a class that sum to 1."""
    parts = F.split("result", ",")
    p = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double"))
    return parts[0].isin(classes), (F.size(p) == len(classes)) & _sums_to_one(p)


@query
def rf_predict(spark, sf_dir):
    """M3 + M7 + M10 + T14: the forest scores the test split; what must hold for each row of 'label,p0,p1,p2'."""
    from pyspark.ml.functions import vector_to_array

    from slantspark.functions.text import format_prediction
    from slantspark.operators import models as MD
    model, test = _fit(spark, sf_dir, "RandomForest")
    known, sums = _result_ok(MD.class_order(model))
    scored = MD.predict(model, test).withColumn("result", format_prediction("predicted_label", vector_to_array("probability")))
    return scored.select("article_id", "label", known.alias("known_class"), sums.alias("sums_to_one"),
                         (F.split("result", ",")[0] == F.col("predicted_label")).alias("agrees"))


@query
def dt_predict(spark, sf_dir):
    """M4 + M7: the tree scores the test split; every prediction is a known class."""
    from pyspark.ml.functions import vector_to_array

    from slantspark.operators import models as MD
    model, test = _fit(spark, sf_dir, "DecisionTree")
    return MD.predict(model, test).select("article_id", "label", F.col("predicted_label").isin(MD.class_order(model)).alias("known_class"),
                                          _sums_to_one(vector_to_array("probability")).alias("sums_to_one"))


def _detector(spark, sf_dir):
    from slantspark.plans.detector import Detector
    return Detector().train(DS.features(spark, sf_dir))


@query
def model_eval(spark, sf_dir):
    """M6 + M8: forest, tree and exact KNN on one split, accuracy and weighted P/R/F1 each."""
    return _detector(spark, sf_dir).test()[0]


@query
def model_reports(spark, sf_dir):
    """M8 + A3: the classification report of each of the three models."""
    return _detector(spark, sf_dir).test()[1]


@query
def predict_text(spark, sf_dir):
    """M9: every conversation turn scored by the forest (raw text -> features -> class + probabilities)."""
    from slantspark.operators import models as MD
    model, _ = _fit(spark, sf_dir, "RandomForest")
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("article_text"))
    known, sums = _result_ok(MD.class_order(model))
    return MD.predict_text(model, c, "article_text", keep=["conv_id", "turn"]).select(
        "conv_id", "turn", known.alias("known_class"), sums.alias("sums_to_one"), (F.split("result", ",")[0] == F.col("prediction")).alias("agrees"))


@query
def model_roundtrip(spark, sf_dir):
    """S11 + S12: save the forest to the shared folder, open it, predictions must agree."""
    from slantspark.operators import models as MD
    model, test = _fit(spark, sf_dir, "RandomForest")
    path = MD.save_model(model, _scratch(spark, "rf-model"))
    scored = MD.predict(model, test).select("article_id", F.col("predicted_label").alias("first"), *FE.FEATURE_COLUMNS)
    return MD.predict(MD.open_model(path), scored).select("article_id", (F.col("first") == F.col("predicted_label")).alias("same"))


@query
def argmax_class(spark, sf_dir):
    """Arg max of the forest's probability vector equals its prediction index."""
    from pyspark.ml.functions import vector_to_array

    from slantspark.operators import metrics as A
    from slantspark.operators import models as MD
    model, test = _fit(spark, sf_dir, "RandomForest")
    return MD.predict(model, test).select("article_id", (A.argmax(vector_to_array("probability")) == F.col("prediction")).alias("agrees"))


def _textclf(spark, sf_dir, n_labels: int = 3):
    from slantspark.plans.text_classifier import TextClassifier
    table = DS.relabelled(spark, sf_dir) if n_labels == 3 else DS.merged(spark, sf_dir).na.fill("", subset=["bias"])
    return TextClassifier(n_labels).train(table, max_iter=30)


@query
def textclf_eval(spark, sf_dir):
    """M15 + M16 + A5: text model trained on 90 %, loss/accuracy/weighted P/R/F1 on the other 10 %."""
    return _textclf(spark, sf_dir).evaluate()[0]


@query
def textclf_confusion(spark, sf_dir):
    """M16 + A2: the text model's confusion counts."""
    return _textclf(spark, sf_dir).evaluate()[1]


@query
def textclf_report(spark, sf_dir):
    """M16 + A3: the text model's classification report."""
    return _textclf(spark, sf_dir).evaluate()[2]


@query
def textclf_predict(spark, sf_dir):
    """M17 + M12: every conversation turn -> class code -> class name; the name is the code's."""
    from slantspark.operators import textclf as TC
    scored = _textclf(spark, sf_dir).predict(T.table(spark, sf_dir, "conversations"), "text", keep=["conv_id", "turn"])
    return scored.select("conv_id", "turn", F.col("predicted_label").isin(list(TC.LABELS_3)).alias("known_class"),
                         (TC.encode_label(F.col("predicted_label"), 3) == F.col("predicted_class")).alias("agrees"))


# --- streaming (stateless, readStream -> features / scoring -> file sink) ---------------------------

@query
def stream_features(spark, sf_dir):
    """The feature path on ``readStream`` over the documents files; equals the batch result."""
    from slantspark.streaming import score as ST
    schema = T.table(spark, sf_dir, "documents").schema
    stream = ST.read_text_stream(spark, T.table_path(sf_dir, "documents"), schema)
    out = ST.run_to_parquet(ST.feature_stream(stream, "doc_id", "text"), _scratch(spark, "stream-features"),
                            _scratch(spark, "stream-features-ckpt"))
    return spark.read.parquet(out).select("doc_id", *FE.FEATURE_COLUMNS)


@query
def stream_score(spark, sf_dir):
    """M9 on a stream: conversation turns scored by the batch-trained forest."""
    from slantspark.operators import models as MD
    from slantspark.streaming import score as ST
    model, _ = _fit(spark, sf_dir, "RandomForest")
    schema = T.table(spark, sf_dir, "conversations").schema
    stream = ST.read_text_stream(spark, T.table_path(sf_dir, "conversations"), schema)
    out = ST.run_to_parquet(ST.score_stream(model, stream, ["conv_id", "turn"], "text"), _scratch(spark, "stream-score"),
                            _scratch(spark, "stream-score-ckpt"))
    known, sums = _result_ok(MD.class_order(model))
    return spark.read.parquet(out).select("conv_id", "turn", known.alias("known_class"), sums.alias("sums_to_one"))


# --- further operator queries ------------------------------------------------------------------------

@query
def confusion_wide(spark, sf_dir):
    """A2 (matrix form): one row per true label, one count column per predicted class."""
    from slantspark.operators import metrics as A
    classes = [c for c in A.class_names(DS.labels(spark, sf_dir), "label") if c]
    return A.confusion_matrix(knn_scored(spark, sf_dir), classes)


@query
def apply_tagger(spark, sf_dir):
    """K2 apply: the lexicon fitted on documents tags every conversation token
    (learned tag where known, rule tag otherwise); tag frequencies."""
    from slantspark.operators import annotate as K
    from slantspark.session import cut_lineage
    # One pass over the corpus; only the (token, tag) counts are materialised.
    counts = cut_lineage(K.tag_counts(tagged_corpus(spark, sf_dir)), "tag-counts")
    lexicon = K.fit_tagger(None, counts=counts)
    suffixes = K.fit_suffix_tagger(None, counts=counts)
    conv = T.table(spark, sf_dir, "conversations")
    toks = K.token_table(conv.select("conv_id", TX.preprocess_features("text").alias("t")), "conv_id", "t")
    return K.apply_tagger(toks, lexicon, suffixes=suffixes).groupBy("tag").agg(F.count("*").alias("n"))


@query
def textclf_eval_5(spark, sf_dir):
    """M13 five-class variant of the text model (centre biases kept as classes 3 and 4)."""
    return _textclf(spark, sf_dir, 5).evaluate()[0]


@query
def dataset_build(spark, sf_dir):
    """Lifecycle A end to end: merged table and feature table written as parquet
    to the shared folder, the feature table read back."""
    out = _scratch(spark, "dataset")
    paths = DS.build(spark, sf_dir, out)
    return spark.read.parquet(paths["features"])


PHRASE_COUNT = 25


def word_tokens(spark, sf_dir) -> DataFrame:
    """(doc_id, w): the tokens of every document that begin with a letter."""
    from slantspark.operators import annotate as K
    return documents(spark, sf_dir).select(
        "doc_id", F.filter(K.tokenize(TX.preprocess_features("text")), lambda t: t.rlike("^[\\p{L}]")).alias("w"))


def frequent_phrases(words: DataFrame, count: int = PHRASE_COUNT) -> DataFrame:
    """A gazetteer derived from the corpus: every phrase of 2 to 4 words that occurs ``count`` times or more."""
    from slantspark.operators import gazetteer as G
    counts = G.frequent_runs(words, "w", 2, 4, count)
    return counts.select("entity", F.concat(F.lit("PHRASE"), F.size(F.split("entity", " "))).alias("label"))


@query
def gazetteer_entities(spark, sf_dir):
    """K4 gazetteer job: longest non-overlapping matches of the corpus phrase table in every document."""
    from slantspark.operators import annotate as K
    from slantspark.session import cut_lineage
    words = cut_lineage(word_tokens(spark, sf_dir), "word-tokens")
    return K.entity_spans(words, "doc_id", "w", cut_lineage(frequent_phrases(words), "gazetteer"))
