"""K2 as a learned sequence tagger: a hidden Markov model counted by Spark, decoded by Viterbi's dynamic program.

``fit`` takes any table of (sequence, position, token, tag) and returns a ``SequenceTagger``:

* transitions (previous tag, tag), with a start and an end, counted without sorting a sequence: each row stands once at its
  own position and once, as the previous tag, at the next one, and the two meet by (sequence, position);
* emissions of words, and of three-letter endings of rare words for words never seen.  A form keeps only the tags it was
  seen with; all others share one cost, so a form costs a few numbers, not one for each tag.

All costs are whole numbers (millionths of a natural logarithm), so sums are exact in any order and ties are real ties, which go to
the tag that comes first in sorted order.

``tag_sequences`` joins tokens with the forms (Spark broadcasts them by their bytes, AQE splits very frequent tokens of a larger table),
sorts each sequence together and decodes all sequences of a batch step by step in NumPy.  A task holds one batch and its longest
sequence.  The tag set and its transitions (tags squared) are the only parts on the driver.

Defined results: rows with a null in a sequence key, position, token or tag are not learned from.  A position that stands
twice in a sequence is learned from its first tag in sorted order; decoding takes repeated positions in the order of their tokens.  Without any
training row every token gets the tag null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slantspark.session import cut_lineage

START, END = "^", "$"                 # neighbours of the first and the last token; no tags of their own
ENDING, RARE = 3, 10                  # letters of an ending; a word seen at most RARE times teaches its ending
MAX_TAGS = 2000                       # transitions are a square table on every worker
MICRO = 1_000_000


def _micro(probability: Column) -> Column:
    return F.round(-F.log(probability) * MICRO).cast("long")


@dataclass
class SequenceTagger:
    """``tags`` in sorted order with counts; ``transitions`` (prev, tag, n, cost); ``forms`` (kind, form, total, rest, tags, costs)."""
    tags: list[tuple[str, int]]
    transitions: DataFrame
    forms: DataFrame

    @property
    def names(self) -> list[str]:
        return [t for t, _ in self.tags]

    def matrix(self) -> np.ndarray:
        """Costs from (tags, start) to (tags, end)."""
        place = {t: n for n, t in enumerate(self.names)}
        size = len(place)
        out = np.zeros((size + 1, size + 1), np.int64)
        for r in self.transitions.collect():              # at most (tags + 1) squared rows
            out[size if r["prev"] == START else place[r["prev"]], size if r["tag"] == END else place[r["tag"]]] = r["cost"]
        return out

    def save(self, path: str) -> str:
        spark = self.forms.sparkSession
        spark.createDataFrame(self.tags, "tag string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/tags")
        self.transitions.write.mode("overwrite").parquet(f"{path}/transitions")
        self.forms.write.mode("overwrite").parquet(f"{path}/forms")
        return path

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SequenceTagger:
        tags = [(r["tag"], r["n"]) for r in spark.read.parquet(f"{path}/tags").orderBy("tag").collect()]
        return cls(tags, spark.read.parquet(f"{path}/transitions"), spark.read.parquet(f"{path}/forms"))


def transition_counts(tagged: DataFrame, sequence: list[str], position: str = "pos", tag: str = "tag") -> DataFrame:
    """(prev, tag, n) with START before and END after each stretch of consecutive positions."""
    return (_neighbours(tagged, sequence, position, tag)
            .select(F.coalesce("prev", F.lit(START)).alias("prev"), F.coalesce("cur", F.lit(END)).alias("tag"), "n"))


def _neighbours(tagged: DataFrame, sequence: list[str], position: str, tag: str) -> DataFrame:
    """(prev, cur, n): counts of neighbouring tags; null before and after each stretch.  With tags as numbers Spark aggregates by hash, without a sort."""
    none = F.lit(None).cast(dict(tagged.dtypes)[tag])
    keys = [F.col(c).alias(f"_s{n}") for n, c in enumerate(sequence)]
    here = tagged.select(*keys, F.col(position).cast("long").alias("_p"), F.col(tag).alias("_tag"))
    sides = F.explode(F.array(F.struct(F.col("_p").alias("p"), F.col("_tag").alias("cur"), none.alias("prev")),
                              F.struct((F.col("_p") + 1).alias("p"), none.alias("cur"), F.col("_tag").alias("prev")))).alias("x")
    names = [f"_s{n}" for n in range(len(sequence))]
    met = here.select(*names, sides).select(*names, "x.*").groupBy(*names, "p").agg(F.min("cur").alias("cur"), F.min("prev").alias("prev"))
    return met.groupBy("prev", "cur").agg(F.count("*").alias("n"))


def _form_costs(counts: DataFrame, kind: str, tags: DataFrame, total_tags: int) -> DataFrame:
    """Costs of (form, tag, n): Bayes' inversion of the form's tag shares, smoothed by one count dealt by the tags' shares."""
    share = F.col("tag_n") / F.lit(float(total_tags))
    total = counts.groupBy("form").agg(F.sum("n").alias("total"))
    cost = _micro((F.col("n") + share) / ((F.col("total") + 1) * share))
    return (counts.join(total, "form").join(F.broadcast(tags), "tag")
            .select("form", "total", "place", cost.alias("cost"))
            .groupBy("form", "total").agg(F.array_sort(F.collect_list(F.struct("place", "cost"))).alias("c"))
            .select(F.lit(kind).alias("kind"), "form", "total", (-_micro(F.col("total") + 1.0)).alias("rest"),
                    F.transform("c", lambda x: x["place"]).alias("tags"), F.transform("c", lambda x: x["cost"]).alias("costs")))


def fit(tagged: DataFrame, sequence: list[str], position: str = "pos", token: str = "tok", tag: str = "tag", stored: bool = False) -> SequenceTagger:
    """K2 fit over (sequence, position, token, tag); a ``stored`` table is read again instead of being written a second time."""
    spark = tagged.sparkSession
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*sequence, position, token, tag]])
    rows = tagged.where(known).select(*sequence, position, F.col(token).alias("tok"), F.col(tag).cast("string").alias("tag"))
    rows = rows if stored else cut_lineage(rows, "tagger-rows")
    pairs = cut_lineage(rows.groupBy("tok", "tag").agg(F.count("*").alias("n")), "tagger-pairs")
    names = [(r["tag"], r["n"]) for r in pairs.groupBy("tag").agg(F.sum("n").alias("n")).orderBy("tag").limit(MAX_TAGS + 1).collect()]
    if len(names) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} different tags")
    if {START, END} & {t for t, _ in names}:
        raise ValueError(f"{START!r} and {END!r} cannot be tags")
    tags = spark.createDataFrame([(t, n, k) for k, (t, n) in enumerate(names)], "tag string, tag_n long, place int")
    total = sum(n for _, n in names)

    places = tags.select(F.col("tag").alias("_name"), F.col("place").alias("_place"))  # in the order of the tags
    seen = (_neighbours(rows.join(F.broadcast(places), F.col("tag") == F.col("_name")), sequence, position, "_place")
            .select(F.coalesce("prev", F.lit(-1)).alias("_prev"), F.coalesce("cur", F.lit(-1)).alias("_cur"), "n"))
    ends = [t for t, _ in names]
    grid = spark.createDataFrame([(p, t, a, b) for a, p in [*enumerate(ends), (-1, START)] for b, t in [*enumerate(ends), (-1, END)]],
                                 "prev string, tag string, _prev int, _cur int")                                     # tags squared
    filled = grid.join(F.broadcast(seen), ["_prev", "_cur"], "left").select("prev", "tag", F.coalesce("n", F.lit(0)).alias("n"))
    of_prev = filled.groupBy("prev").agg(F.sum("n").alias("of_prev"))
    transitions = (filled.join(of_prev, "prev")
                   .select("prev", "tag", "n", _micro((F.col("n") + 1) / (F.col("of_prev") + len(ends) + 1)).alias("cost")))

    words = pairs.select(F.col("tok").alias("form"), "tag", "n")
    rare = pairs.groupBy("tok").agg(F.sum("n").alias("total")).where((F.col("total") <= RARE) & (F.length("tok") > ENDING)).select("tok")
    endings = (pairs.join(rare, "tok").groupBy(F.right("tok", F.lit(ENDING)).alias("form"), "tag").agg(F.sum("n").alias("n")))
    forms = _form_costs(words, "word", tags, total).unionByName(_form_costs(endings, "ending", tags, total))
    return SequenceTagger(names, cut_lineage(transitions, "tagger-transitions"), cut_lineage(forms, "tagger-forms"))


def best_paths(emission: np.ndarray, lengths: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Least-cost tags of sequences laid one after another: all sequences advance together, the longest first."""
    size = matrix.shape[0] - 1
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    long_first = lengths[order]
    back = np.zeros(emission.shape, np.int16)
    score = np.zeros((len(order), size), np.int64)
    inner, first, last = matrix[:size, :size], matrix[size, :size], matrix[:size, size]
    for t in range(int(lengths.max(initial=0))):
        active = int(np.searchsorted(-long_first, -t, side="left"))           # sequences longer than t
        rows = starts[:active] + t
        if t == 0:
            score[:active] = first + emission[rows]
            continue
        ways = score[:active, :, None] + inner[None]
        back[rows] = ways.argmin(axis=1)                                      # the first of equal costs
        score[:active] = ways.min(axis=1) + emission[rows]
    out = np.zeros(len(emission), np.int64)
    here = (score + last).argmin(axis=1)
    for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
        active = int(np.searchsorted(-long_first, -t, side="left"))
        rows = starts[:active] + t
        out[rows] = here[:active]
        here[:active] = back[rows, here[:active]]
    return out


def with_costs(tokens: DataFrame, model: SequenceTagger, token: str = "tok") -> DataFrame:
    """Adds ``_code`` (rest, tags, costs): the word's, else its ending's, else null."""
    code = F.struct("rest", "tags", "costs")
    words = model.forms.where("kind = 'word'").select(F.col("form").alias("_word"), code.alias("_wc"))
    endings = model.forms.where("kind = 'ending'").select(F.col("form").alias("_end"), code.alias("_ec"))
    ending = F.when(F.col("_wc").isNull() & (F.length(token) > ENDING), F.right(F.col(token), F.lit(ENDING)))
    out = tokens.join(words, F.col(token) == F.col("_word"), "left").withColumn("_e", ending).join(endings, F.col("_e") == F.col("_end"), "left")
    return out.withColumn("_code", F.coalesce("_wc", "_ec")).drop("_word", "_wc", "_e", "_end", "_ec")


def tag_sequences(tokens: DataFrame, model: SequenceTagger, sequence: list[str], position: str = "pos", token: str = "tok") -> DataFrame:
    """One row per sequence: its keys, positions, tokens and decoded tags (arrays in the order of positions)."""
    names, matrix = model.names, model.matrix()
    kinds = dict(tokens.dtypes)
    keys = [f"_s{n}" for n in range(len(sequence))]
    source = tokens.select(*[F.col(c).alias(k) for c, k in zip(sequence, keys)], F.col(position).cast("long").alias("_pos"), F.col(token).alias("_tok"))
    rows = (with_costs(source, model, "_tok").select(*keys, "_pos", "_tok", "_code.rest", "_code.tags", "_code.costs")
            .repartition(*keys).sortWithinPartitions(*keys, "_pos", "_tok"))
    n_keys = len(keys)

    def decoded(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        table = table.combine_chunks()
        lengths = np.diff(cuts)
        rest, lists = table.column("rest"), table.column("tags")
        size = max(len(names), 1)
        emission = np.zeros((table.num_rows, size), np.int64)
        emission += np.nan_to_num(rest.to_numpy(zero_copy_only=False).astype(np.float64))[:, None].astype(np.int64)
        each = lists.combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        emission[np.repeat(np.arange(table.num_rows), each), lists.combine_chunks().flatten().to_numpy()] = table.column("costs").combine_chunks().flatten().to_numpy()
        path = best_paths(emission, lengths, matrix) if names else np.zeros(table.num_rows, np.int64)
        offsets = pa.array(cuts, pa.int32())
        tags = pa.array(names or [None], pa.string()).take(pa.array(path))
        columns = [table.column(k).combine_chunks().take(pa.array(cuts[:-1])) for k in range(n_keys)]
        return pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in ("_pos", "_tok")]
                                          + [pa.ListArray.from_arrays(offsets, tags)], [*keys, "pos", "tok", "tags"])

    def run(batches):
        held = None                                                           # rows of the sequence that the next batch may continue
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            new = np.zeros(table.num_rows, bool)
            for k in range(n_keys):
                codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new)])
            if len(cuts) > 1:
                yield decoded(table.slice(0, int(cuts[-1])), cuts)
            held = table.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield decoded(held, np.array([0, held.num_rows]))

    schema = ", ".join(f"{k} {kinds[c]}" for c, k in zip(sequence, keys)) + f", pos array<long>, tok array<{kinds[token]}>, tags array<string>"
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(sequence, keys)], "pos", "tok", "tags")


def tag_tokens(tokens: DataFrame, model: SequenceTagger, sequence: list[str], position: str = "pos", token: str = "tok") -> DataFrame:
    """K2 apply in long form: (sequence keys, position, token, predicted)."""
    zipped = F.inline(F.arrays_zip("pos", "tok", "tags"))
    rows = tag_sequences(tokens, model, sequence, position, token)
    return rows.select(*sequence, zipped).select(*sequence, F.col("pos").alias(position), F.col("tok").alias(token), F.col("tags").alias("predicted"))
