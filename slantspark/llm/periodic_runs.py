"""Periodic runs of words by recompression: a run-length grammar answers exact extensions of harmonic-grid candidates.

The words of a batch of texts become one sequence of numbers, with a separator of its own before, between and after the texts.
Recompression shrinks it in turns: *block* levels replace each maximal stretch of one symbol by (symbol, length), *pair*
levels split the alphabet in two by a hash and replace each (left symbol, right symbol) by one; equal stretches are parsed
alike but for their edges.  So the longest common extension of two places needs one step or two a level: climb while the
symbols agree, skipping to the next common parent border, then descend to the first difference (``Grammar.extend``).  All
queries of a batch climb together as arrays; extensions to the left run on the mirrored levels.

A run with period q and at least max(6, 4 q) words holds a multiple p of max(6, 4 q) - q with p and p + q both inside.  These
grid points are harmonic in number (n / 3 q for each q, n log n in all).  Where the words at p and p + q are equal, the two
extensions give the maximal run exactly; of runs over the same words the smallest period is the run's own.

On the cluster: one narrow pass, texts never move and a batch takes about ``SLICE_BYTES`` of text.  A longer text is a batch
of its own; its candidates are made in pieces of ``POINTS``, so memory follows its words, not its candidates.

Defined results: null and empty texts have no words, no runs and an empty collapsed text.  Repeated rows and ids and null ids are rows of their own.
Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, slices

SLICE_BYTES, POINTS = 1 << 20, 1 << 20
SHORTEST, REPEATS = 6, 4                      # a run has max(SHORTEST, REPEATS * period) words at least
RUNS = "array<struct<start: long, length: long, period: long>>"


# --- the grammar --------------------------------------------------------------------------------------

@dataclass
class Level:
    """One level: its symbols, the parent of each in the level above, and where the children of each parent start."""
    symbols: np.ndarray
    parent: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: bool = False

    def mirrored(self) -> "Level":
        if self.parent is None:
            return Level(self.symbols[::-1])
        return Level(np.ascontiguousarray(self.symbols[::-1]), np.ascontiguousarray(len(self.first) - 2 - self.parent[::-1]),
                     np.ascontiguousarray(len(self.symbols) - self.first[::-1]), self.blocks)


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _grouped(symbols: np.ndarray, starts: np.ndarray, blocks: bool) -> tuple[Level, np.ndarray]:
    """The level whose parents start at ``starts`` (a mask), and the symbols above it."""
    first = np.append(np.flatnonzero(starts), len(symbols))
    size, head = np.diff(first), symbols[first[:-1]]
    top = int(symbols.max()) + 1
    if blocks:
        keys = head * (len(symbols) + 1) + size
    else:
        tail = symbols[np.minimum(first[:-1] + 1, len(symbols) - 1)]
        keys = np.where(size == 2, head * top + tail + top, head)
    return Level(symbols, np.cumsum(starts) - 1, first, blocks), _named(keys)


def _pair_starts(symbols: np.ndarray, rng) -> np.ndarray:
    """Parent borders of a pair level: of a few random splits of the alphabet the one that joins most pairs."""
    best = None
    for _ in range(4):
        left = rng.integers(0, 2, int(symbols.max()) + 1, np.int8).astype(bool)[symbols]
        for side in (left, ~left):
            glued = side[:-1] & ~side[1:]
            if best is None or np.count_nonzero(glued) > best[0]:
                best = (np.count_nonzero(glued), glued)
    return np.append(True, ~best[1])


class Grammar:
    """Recompression of a sequence in which the first and the last symbol, and one between any two texts, occur once."""

    def __init__(self, symbols: np.ndarray, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.levels: list[Level] = []
        symbols = _named(symbols)
        while len(symbols) > 1:
            starts = np.append(True, symbols[1:] != symbols[:-1])
            if not starts.all():
                level, symbols = _grouped(symbols, starts, True)
                self.levels.append(level)
            starts = _pair_starts(symbols, rng)
            if not starts.all():
                level, symbols = _grouped(symbols, starts, False)
                self.levels.append(level)
        self.levels.append(Level(symbols))
        self._mirror: list[Level] | None = None

    @property
    def size(self) -> int:
        return len(self.levels[0].symbols)

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that starts at i and at j (i != j)."""
        return _extend(self.levels, i, j)

    def extend_left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before i and before j."""
        if self._mirror is None:
            self._mirror = [level.mirrored() for level in self.levels]
        return _extend(self._mirror, self.size - i, self.size - j)


def _extend(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = i.copy(), j.copy()
    climbing = np.arange(len(i))
    stopped = []                                          # queries whose first difference was met at each level
    for level in levels:
        x, y = a[climbing], b[climbing]
        equal = level.symbols[x] == level.symbols[y]
        if level.parent is None:                          # the top has one symbol, and i != j
            stopped.append(climbing)
            break
        stay = climbing[~equal]
        climbing, x, y = climbing[equal], x[equal], y[equal]
        p, q = level.parent[x], level.parent[y]
        inside = np.flatnonzero((level.first[p] != x) | (level.first[q] != y))
        step = np.minimum(level.first[p[inside] + 1] - x[inside], level.first[q[inside] + 1] - y[inside])
        x[inside] += step                                 # to the border that both share, if the symbols go on alike
        y[inside] += step
        differs = np.zeros(len(x), bool)
        differs[inside] = level.symbols[x[inside]] != level.symbols[y[inside]]
        a[climbing[differs]], b[climbing[differs]] = x[differs], y[differs]
        stopped.append(np.concatenate([stay, climbing[differs]]))
        climbing, x, y = climbing[~differs], x[~differs], y[~differs]
        a[climbing], b[climbing] = level.parent[x], level.parent[y]
    going_down = np.zeros(0, int)
    for n in range(len(stopped) - 1, 0, -1):
        going_down = np.concatenate([going_down, stopped[n]])
        level = levels[n - 1]
        x, y = a[going_down], b[going_down]
        size = np.minimum(level.first[x + 1] - level.first[x], level.first[y + 1] - level.first[y]) if level.blocks else 1
        x, y = level.first[x], level.first[y]
        step = np.where(level.symbols[x] == level.symbols[y], size, 0)
        a[going_down], b[going_down] = x + step, y + step
    return a - i


# --- runs ---------------------------------------------------------------------------------------------

def grid(lengths: np.ndarray, points: int = POINTS):
    """Pieces of (text, place, period): the harmonic grid of every text, all periods up to a quarter of its words."""
    periods = np.where(lengths >= SHORTEST, lengths // REPEATS, 0)
    ends = np.cumsum(periods)
    for s in range(0, int(ends[-1]) if len(ends) else 0, points):
        line = np.arange(s, min(s + points, int(ends[-1])))
        text = np.searchsorted(ends, line, side="right")
        q = line - (ends[text] - periods[text]) + 1
        gap = np.maximum(SHORTEST, REPEATS * q) - q
        count = -(-(lengths[text] - q) // gap)
        done = np.cumsum(count)
        cuts = np.searchsorted(done, np.arange(points, int(done[-1]) + points, points), side="left") + 1
        for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
            part = slice(a, min(b, len(count)))
            c = count[part]
            k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(text[part], c), k * np.repeat(gap[part], c), np.repeat(q[part], c)


def find_runs(words: np.ndarray, lengths: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, sorted; ``words`` are the numbered words of texts of ``lengths``, one after another."""
    offsets = np.cumsum(lengths) - lengths + np.arange(len(lengths)) + 1          # places in the sequence with separators
    total = int(lengths.sum()) + len(lengths) + 1
    sequence = np.empty(total, np.int64)
    separator = np.ones(total, bool)
    separator[np.arange(len(words)) + np.repeat(np.arange(len(lengths)) + 1, lengths)] = False
    sequence[~separator] = words
    sequence[separator] = int(words.max(initial=-1)) + 1 + np.arange(len(lengths) + 1)
    grammar, found = None, []
    for text, place, q in grid(lengths, points):
        p = offsets[text] + place
        hit = sequence[p] == sequence[p + q]
        if not hit.any():
            continue
        text, p, q = text[hit], p[hit], q[hit]
        grammar = grammar or Grammar(sequence)
        right, left = grammar.extend(p, p + q), grammar.extend_left(p, p + q)
        length = left + right + q
        run = (length >= np.maximum(SHORTEST, REPEATS * q)) & (left < np.maximum(SHORTEST, REPEATS * q) - q)  # the run's first grid point
        found.append((text[run], (p - left - offsets[text])[run], length[run], q[run]))
    text, start, length, q = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    own = np.append(True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(q)]
    text, start, length, q = text[own], start[own], length[own], q[own]           # the smallest period of the same words
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (stretches without ASCII white space) and the number of words of each text; null is the empty text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    before = np.concatenate([[0], np.cumsum(keep)])
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    return flat.filter(pa.array(keep)), np.diff(before[ends]).astype(np.int64)


def collapse(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each text."""
    words, lengths = split_words(texts)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    text, start, length, q = find_runs(codes, lengths)
    entries = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, q)], ["start", "length", "period"])
    n_runs = np.bincount(text, minlength=len(lengths))
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32()), entries)
    # a word goes if some run holds it after that run's first q words
    change = np.zeros(len(words) + 1, np.int64)
    at = (np.cumsum(lengths) - lengths)[text] + start
    np.add.at(change, at + q, 1)
    np.add.at(change, at + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)])]
    kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(keep)))
    return runs, pc.binary_join(kept, " ")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (id, runs by start and period, collapsed text)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                runs, collapsed = collapse(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), runs, collapsed], [id_col, "runs", "collapsed"])
            release_memory()

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, runs {RUNS}, collapsed string")


def run_digests(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest run of each row (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("neg"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = runs.withColumn("best", best)
    length = -F.col("best.neg")
    return rows.select(id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
                       F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's input (id, text): where crc32 of the id ends in 0, the words from place a on repeat with a period p."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    cut = cut.select(id_col, "text", "g", "words", F.when(n > 0, F.col("g") % n).alias("a"))
    p = F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)) + 1
    cut = cut.select(id_col, "text", "words", F.col("a").cast("int").alias("a"), p.cast("int").alias("p"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")                     # 11 at most, as p is a tenth of n - a or more
    turns = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    again = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), n - F.col("a")))
    return cut.select(id_col, F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
