"""K3 as a learned sentence model: which periods end sentences, found in unlabelled text by log-likelihood ratios.

After Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection, 2006), on counts that Spark aggregates:

* abbreviations: words that stand almost always before a period, weighed by their length, inner periods and the times they stand without one;
* sentence starters: words that stand after a sure sentence end more often than elsewhere;
* collocations: pairs around a period whose first word is an abbreviation, a number or an initial.

A period then ends a sentence unless its word is an abbreviation that no starter follows, or the pair is a collocation; ``!`` and ``?`` always end one.
``fit`` moves counts of words and of pairs around periods only.  ``sentence_counts`` moves the periods of the texts, not the words; Spark broadcasts
the three word tables by their bytes.

Words are what white space parts, in lower case, without quotes and brackets around them.  Defined results: null and empty texts and texts
without a word have no sentence; a text without any sentence end that has a word is one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantspark.session import cut_lineage

# --- fixed values -----------------------------------------------------------
# Thresholds of the paper, and the share of periods after an abbreviation in its alternative hypothesis.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
ALMOST_ALWAYS = 0.99
# --- end of fixed values ------------------------------------------------------
SPACE = r"[\x09-\x0D\x20]+"
EDGE = r"^[\"'(\[]+|[\"')\]]+$"
NUMBER, NUMBER_TYPE = r"^\p{Nd}[\p{Nd}.,]*$", "##number##"
WORD = r"[\p{L}\p{N}]"


def _type(word: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(word, r"[!?]+$", ""), r"\.$", "")
    return F.when(bare.rlike(NUMBER), NUMBER_TYPE).otherwise(bare)


def marked(text: Column) -> Column:
    """The words of a text: (typ, ends), ``ends`` one of '.', '!' (also for '?') and ''; only words with a letter or digit."""
    words = F.filter(F.transform(F.split(F.lower(text), SPACE), lambda w: F.regexp_replace(w, EDGE, "")), lambda w: w.rlike(WORD))
    return F.transform(words, lambda w: F.struct(_type(w).alias("typ"), F.when(w.rlike(r"[!?]$"), "!").when(w.endswith("."), ".").otherwise("").alias("ends")))


def _with_next(words: str) -> Column:
    """Each word with the type of the next one ('' after the last)."""
    n = F.size(words)
    following = F.concat(F.transform(F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda w: w["typ"]), F.array(F.lit("")))
    return F.explode(F.arrays_zip(F.col(words).alias("w"), F.slice(following, F.lit(1), n).alias("next")))


def _ln(count: Column, p: Column) -> Column:
    """count times ln p, 0 where the count is 0."""
    return F.when(count > 0, count * F.log(p)).otherwise(F.lit(0.0))


def association(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of b after a: ``ab`` times among ``a``, ``b`` times among all ``n``."""
    a, b, ab, n = (c.cast("double") for c in (a, b, ab, n))
    p, p1, p2 = b / n, ab / a, F.try_divide(b - ab, n - a)
    rest = n - a - b + ab
    return -2 * (_ln(ab, p) + _ln(a - ab, 1 - p) + _ln(b - ab, p) + _ln(rest, 1 - p)
                 - _ln(ab, p1) - _ln(a - ab, 1 - p1) - _ln(b - ab, p2) - _ln(rest, 1 - p2))


@dataclass
class SentenceModel:
    """``types`` (typ, n, n_period, score): all words seen before a period; ``starters`` and ``collocations`` with their ratios."""
    types: DataFrame
    starters: DataFrame
    collocations: DataFrame

    @property
    def abbreviations(self) -> DataFrame:
        return self.types.where(F.col("score") >= ABBREVIATION).select("typ")


def fit(texts: DataFrame, text_col: str = "text") -> SentenceModel:
    """Learn from any table of texts."""
    words = texts.select(marked(F.col(text_col)).alias("words")).select(_with_next("words").alias("x"))
    pairs = words.select("x.w.typ", "x.w.ends", F.col("x.next").alias("next")).groupBy(
        "typ", "ends", F.when(F.col("ends") != "", F.col("next")).alias("next")).agg(F.count("*").alias("n"))
    pairs = cut_lineage(pairs, "sentence-pairs")                                # (word, end mark, next word after a mark, n)
    counts = pairs.groupBy("typ").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("ends") == ".", F.col("n"))), F.lit(0)).alias("n_period"))
    counts = cut_lineage(counts, "sentence-counts")
    total = counts.agg(F.sum("n").alias("all"), F.sum("n_period").alias("periods"))

    n, k = F.col("n").cast("double"), F.col("n_period").cast("double")
    p = F.col("periods") / F.col("all")
    ratio = -2 * (_ln(k, p) + _ln(n - k, 1 - p) - (k * F.log(F.lit(ALMOST_ALWAYS)) + (n - k) * F.log(F.lit(1 - ALMOST_ALWAYS))))
    inner = F.length("typ") - F.length(F.replace(F.col("typ"), F.lit("."), F.lit("")))
    letters = (F.length("typ") - inner).cast("double")
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -(n - k))
    types = (counts.where((F.col("n_period") > 0) & F.col("typ").rlike(r"\p{L}")).crossJoin(F.broadcast(total))     # one row of totals
             .select("typ", "n", "n_period", F.round(score, 6).alias("score")))
    types = cut_lineage(types, "sentence-types")
    short = types.where(F.col("score") >= ABBREVIATION).select("typ", F.lit(True).alias("abbr"))

    after = pairs.where("ends <> '' AND next <> ''").join(short, "typ", "left").withColumn("abbr", F.coalesce("abbr", F.lit(False)))
    sure = after.where((F.col("ends") == "!") | (~F.col("abbr") & (F.col("typ") != NUMBER_TYPE) & (F.length("typ") > 1)))
    sure = sure.groupBy(F.col("next").alias("typ")).agg(F.sum("n").alias("n_after"))
    breaks = sure.agg(F.sum("n_after").alias("breaks"))
    held = sure.join(counts, "typ").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(breaks))
    held = held.withColumn("ratio", association(F.col("breaks"), F.col("n"), F.least("n_after", "n"), F.col("all")))
    starters = (held.where((F.col("ratio") >= STARTER) & (F.col("n_after") * F.col("all") > F.col("n") * F.col("breaks")))
                .select("typ", "n", "n_after", F.round("ratio", 6).alias("ratio")))

    around = after.where((F.col("ends") == ".") & (F.col("abbr") | (F.col("typ") == NUMBER_TYPE) | (F.length("typ") == 1)))
    around = around.groupBy("typ", "next").agg(F.sum("n").alias("n_pair"))
    first = counts.select("typ", F.col("n").alias("n_first"))
    second = counts.select(F.col("typ").alias("next"), F.col("n").alias("n_next"))
    both = around.join(first, "typ").join(second, "next").crossJoin(F.broadcast(total))
    both = both.withColumn("ratio", association(F.col("n_first"), F.col("n_next"), F.least("n_pair", "n_next"), F.col("all")))
    collocations = (both.where((F.col("ratio") >= COLLOCATION) & (F.col("n_pair") > 1) & (F.col("n_pair") * F.col("all") > F.col("n_first") * F.col("n_next")))
                    .select("typ", "next", "n_pair", F.round("ratio", 6).alias("ratio")))
    return SentenceModel(types, cut_lineage(starters, "sentence-starters"), cut_lineage(collocations, "sentence-collocations"))


def sentence_counts(texts: DataFrame, key: str, text_col: str, model: SentenceModel) -> DataFrame:
    """(key, sentence_count) for each row that has a word; ``key`` must tell the rows apart."""
    rows = texts.select(F.col(key).alias("_key"), marked(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    ends = F.filter(F.arrays_zip(F.col("words").alias("w"), F.concat(F.transform(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda w: w["typ"]),
                                                                      F.array(F.lit(""))).alias("next")), lambda x: x["w"]["ends"] != "")
    # The last word ends the last sentence whatever stands behind it, so only marks before it decide.
    inside = F.filter(ends, lambda x: x["next"] != "")
    marks = rows.select("_key", F.explode_outer(inside).alias("x")).select("_key", F.col("x.w.typ").alias("typ"), F.col("x.w.ends").alias("ends"), F.col("x.next").alias("next"))
    known = (marks.join(model.abbreviations.withColumn("abbr", F.lit(True)), "typ", "left")
             .join(model.starters.select(F.col("typ").alias("next"), F.lit(True).alias("starts")), "next", "left")
             .join(model.collocations.select("typ", "next", F.lit(True).alias("goes")), ["typ", "next"], "left"))
    abbr, starts, goes = (F.coalesce(c, F.lit(False)) for c in ("abbr", "starts", "goes"))
    is_end = F.col("ends").isNotNull() & ((F.col("ends") == "!") | (~goes & (~abbr | starts)))
    return (known.groupBy("_key").agg((F.count_if(is_end) + 1).cast("int").alias("sentence_count")).select(F.col("_key").alias(key), "sentence_count"))
