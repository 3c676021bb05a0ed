"""Toxicity by class-conditional Kneser-Ney models with a shared backoff.

For each class a bigram model with absolute discounting: p(w|h) uses the class's bigram counts and backs off to the class's
continuation counts (how many different words precede w), which back off to the continuation counts of both classes
together.  A rare expression that one class never showed so costs both classes alike.  A text is described by
length-normalised log-likelihood differences: the mean and root-length mean over its words of the bigram and of the
continuation level, the mean of its three strongest words, and its log length; a logistic curve maps them to a probability.

Fitting reads at most ``sample`` labelled rows per class (the documented bound), chosen by a hash of the id, equal texts
once; class shares come from all training labels.  A hash of the text parts all texts into two halves, and a text is always
described by the models of the other half: when the curve is fitted and when any text is scored, so no text (nor a copy)
meets counts of its own and the curve sees the same differences in both.  Only texts and the toxic label are used, never lang, source or the id.

Defined results: null and empty texts, and texts without words, get the share of toxic training labels.  Without labels every
score is 0; with labels of one class only, that class's value.  Labels that are null are not used; an id labelled twice is
toxic if one label says so.  Repeated rows each get their score.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, cut_lineage, heldout, map_arrow, release_memory, slices
from .winnow import SLICE_BYTES, known_hashes, word_hashes

DISCOUNT = 0.75
STRONGEST = 3
START = np.uint64(0x5354415254)


def _pair(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def build(context: np.ndarray, word: np.ndarray, counts: list[np.ndarray]) -> dict:
    """The two models from distinct bigrams and their counts in the classes (ordinary, toxic)."""
    vocabulary = np.unique(np.concatenate([context, word]))
    c, w = np.searchsorted(vocabulary, context), np.searchsorted(vocabulary, word)
    v = len(vocabulary)
    seen = [n > 0 for n in counts]
    continuation = [np.bincount(w[s], minlength=v) for s in seen]
    pooled = continuation[0] + continuation[1]
    known = int((pooled > 0).sum())
    shared = (pooled + 0.5) / (pooled.sum() + 0.5 * (known + 1))
    unknown = 0.5 / (pooled.sum() + 0.5 * (known + 1))
    model = {"vocabulary": vocabulary, "lower": [], "unknown": [], "total": [], "backoff": []}
    for k in (0, 1):
        total = max(int(continuation[k].sum()), 1)
        share = DISCOUNT * (continuation[k] > 0).sum() / total if continuation[k].any() else 1.0
        model["lower"].append(np.maximum(continuation[k] - DISCOUNT, 0) / total + share * shared)
        model["unknown"].append(share * unknown)
        n = np.bincount(c, weights=counts[k], minlength=v)
        model["total"].append(n)
        model["backoff"].append(np.where(n > 0, DISCOUNT * np.bincount(c[seen[k]], minlength=v) / np.maximum(n, 1), 1.0))
    keys = _pair(context, word)
    order = np.argsort(keys)
    model["bigrams"] = keys[order]
    model["counts"] = [n[order].astype(np.float32) for n in counts]
    return model


def differences(model: dict, words: np.ndarray) -> np.ndarray:
    """Length-normalised log-likelihood differences (toxic less ordinary) of a text's word hashes."""
    n = len(words)
    if not n:
        return np.zeros(6)
    before = np.concatenate([[START], words[:-1]]).astype(np.uint64)
    at, known = _find(model["vocabulary"], words)
    ctx, ctx_known = _find(model["vocabulary"], before)
    pair, pair_known = _find(model["bigrams"], _pair(before, words))
    low, full = [], []
    for k in (0, 1):
        lower = np.where(known, model["lower"][k][at] if len(model["lower"][k]) else 0.0, model["unknown"][k])
        total = np.where(ctx_known, model["total"][k][ctx], 0.0)
        count = np.where(pair_known, model["counts"][k][pair], 0.0)
        low.append(np.log(lower))
        full.append(np.log(np.where(total > 0, np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)
                                    + np.where(ctx_known, model["backoff"][k][ctx], 1.0) * lower, lower)))
    u, b = low[1] - low[0], full[1] - full[0]
    top = np.sort(u)[::-1][:STRONGEST].sum() / STRONGEST
    return np.array([b.mean(), b.sum() / np.sqrt(n), u.mean(), u.sum() / np.sqrt(n), top, np.log(n)])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> dict:
    """Weighted logistic regression by damped Newton steps on standardised features."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge * beta
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        step = np.clip(np.linalg.solve(bend, slope), -3, 3)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "spread": spread, "beta": beta}


def _bigram_counts(sample: DataFrame) -> DataFrame:
    """(context, word, c00, c01, c10, c11): counts of class-half pairs over the sample."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known = known_hashes()
        toxic, half = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for t, h, text in zip(toxic, half, binary_texts(batch.column(0))):
            words = word_hashes(text, known)
            before = np.concatenate([[START], words[:-1]]).astype(np.uint64)[: len(words)]
            pairs, counts = np.unique(np.stack([before, words], axis=1), axis=0, return_counts=True) if len(words) else (np.zeros((0, 2), np.uint64), [])
            size = len(pairs)
            yield {"context": pairs[:, 0].view(np.int64) if size else [], "word": np.ascontiguousarray(pairs[:, 1]).view(np.int64) if size else [],
                   "part": np.full(size, 2 * int(t) + int(h), np.int32), "n": counts}

    rows = map_arrow(sample.select("text", "toxic", "half"), run, "context long, word long, part int, n long")
    return rows.groupBy("context", "word").agg(*[F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).cast("int").alias(f"c{p}") for p in range(4)])


def _half(text: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(2)).cast("int")


def _described(texts: DataFrame, models: list[dict], columns: str) -> DataFrame:
    """Differences of each row's text by the model numbered ``which``."""
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known = known_hashes()
        which = batch.column(1).to_numpy()
        yield {"which": which, "toxic": batch.column(2),
               "x": [differences(shared.value[m], word_hashes(t, known)) for m, t in zip(which, binary_texts(batch.column(0)))]}

    return map_arrow(texts, run, columns)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          fold: int = 0, folds: int = 5, sample: int = 2000) -> dict:
    """Fit on labelled rows outside the held-out fold; the result holds arrays bounded by the sample."""
    usable = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
              .agg(F.max(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("toxic")).where(~heldout(F.col("doc_id"), fold, folds)))
    shares = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("text").alias("text")))
    texts = cut_lineage(texts.select("text", "toxic", _half("text").alias("half")), "labelled-sample")
    counts = _bigram_counts(texts).toArrow()  # bounded by the sample
    if not counts.num_rows or not 0 < prior < 1:
        return {"prior": prior}
    context, word = (counts.column(k).to_numpy().view(np.uint64) for k in range(2))
    c = [counts.column(2 + p).to_numpy() for p in range(4)]  # 2 * class + half
    halves = []
    for half in (0, 1):
        used = (c[half] + c[2 + half]) > 0
        halves.append(build(context[used], word[used], [c[half][used], c[2 + half][used]]))
    rows = _described(texts.select("text", (1 - F.col("half")).alias("which"), "toxic"), halves, "which int, toxic int, x array<double>").toArrow()
    x, y = np.array(rows.column("x").to_pylist()), rows.column("toxic").to_numpy()
    if not len(x) or len(set(y.tolist())) < 2:
        return {"prior": prior}
    weight = np.where(y == 1, prior / (y == 1).mean(), (1 - prior) / (y == 0).mean())
    return {"prior": prior, "halves": halves, "curve": fit_curve(x, y.astype(float), weight)}


def _probability(model: dict, half: int, words: np.ndarray) -> float:
    if not len(words) or "curve" not in model:
        return model["prior"]
    curve = model["curve"]
    z = float(((differences(model["halves"][1 - half], words) - curve["mean"]) / curve["spread"]) @ curve["beta"][:-1] + curve["beta"][-1])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _probabilities(model: dict, halves: pa.Array, texts: pa.Array) -> list[float]:
    known = known_hashes()
    return [_probability(model, h, word_hashes(t, known)) for h, t in zip(halves.to_pylist(), binary_texts(texts))]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", fold: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, 1, SLICE_BYTES):
            yield {"doc_id": part.column(0), "score": _probabilities(shared.value, part.column(2), part.column(1))}

    rows = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _half(text_col).alias("half")), run,
                     "doc_id long, score double")
    return rows.select("doc_id", heldout(F.col("doc_id"), fold, folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below one half."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for part in slices(batch, place, SLICE_BYTES):
                wanted = pa.array([p < 0.5 for p in _probabilities(shared.value, part.column(part.num_columns - 1), part.column(place))], pa.bool_())
                yield pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1]).filter(wanted)
            release_memory()

    return docs.select("*", _half(text_col).alias("text_half")).mapInArrow(keep, docs.schema)
