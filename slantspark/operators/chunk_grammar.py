"""K5 by a chunk grammar: a finite-state table over tag symbols, folded once over each row's tags.

A grammar names one symbol per (token, tag) and says which symbol leads from which state to which.  Chunks are the leftmost
longest stretches that end in an accepting state.  The fold keeps the state, the length so far and the length at the last accepting
state; where no move fits, the chunk found is counted and the same token begins anew.  That single pass equals leftmost-longest
matching as long as no chunk can begin inside the part it gives up; ``ChunkGrammar`` checks this for its table and refuses others.

All of it is array expressions on the row: no shuffle, no Python.  Null tokens or tags give no chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from slantspark.functions import lexicon as L

START = "start"


@dataclass(frozen=True)
class ChunkGrammar:
    """``tags``: (symbol, tags) rules; ``words``: (symbol, tokens) rules that go first; ``moves``: state -> {symbols: next state};
    ``accepting``: states in which a chunk may end.  The first state of ``moves`` is ``start``."""
    tags: tuple[tuple[str, tuple[str, ...]], ...]
    words: tuple[tuple[str, tuple[str, ...]], ...]
    moves: dict[str, dict[str, str]]
    accepting: tuple[str, ...]

    def __post_init__(self):
        if START not in self.moves or START in self.accepting or any(START in to.values() for to in self.moves.values()):
            raise ValueError("the start state must exist, and neither accept nor be entered again")
        unknown = {s for to in self.moves.values() for s in to.values()} - set(self.moves)
        if unknown:
            raise ValueError(f"states without moves: {sorted(unknown)}")
        self._check_single_pass()

    @property
    def symbols(self) -> list[str]:
        return sorted({x for to in self.moves.values() for group in to for x in group})

    def move(self, state: str, symbol: str) -> str | None:
        return next((to for group, to in self.moves[state].items() if symbol in group), None)

    def _check_single_pass(self) -> None:
        """Follows every path together with the chunks that could begin inside its unaccepted end."""
        todo = [(START, frozenset())]
        seen = set(todo)
        while todo:
            state, inner = todo.pop()
            for x in self.symbols:
                onward = {self.move(s, x) for s in inner | ({START} if state != START else set())} - {None}
                to = self.move(state, x)
                if to is None:
                    if {self.move(s, x) for s in inner} - {None}:
                        raise ValueError(f"a chunk may begin before the symbol {x!r} that state {state!r} refuses")
                    continue
                if to in self.accepting:
                    onward = set()
                elif onward & set(self.accepting):
                    raise ValueError(f"a chunk may end inside an unfinished one (state {to!r}, symbol {x!r})")
                entry = (to, frozenset(onward))
                if entry not in seen:
                    seen.add(entry)
                    todo.append(entry)

    def table(self) -> tuple[list[str], list[int], int]:
        """(states, next state for state * symbols + symbol, first accepting state); a next state of ``len(states)`` or more begins anew."""
        states = [START, *[s for s in self.moves if s != START and s not in self.accepting], *[s for s in self.moves if s in self.accepting]]
        number = {s: n for n, s in enumerate(states)}
        out = []
        for s in states:
            for x in [*self.symbols, None]:
                to = self.move(s, x) if x and s != START else None
                again = (self.move(START, x) if x else None) or START
                out.append(number[to] if to else number[again] + len(states))
        return states, out, len(states) - len([s for s in self.moves if s in self.accepting])


_OPEN = {"R": "adverb", "J": "adjective", "C": "open", "N": "noun"}       # what may stand before a noun

# [predeterminer] [determiner] {number | adverbs adjective {, or "and" adjective}} nouns {possessive modifiers nouns}, or a pronoun
NOUN_PHRASES = ChunkGrammar(
    tags=(("A", ("PDT",)), ("D", ("DT", "PRP$")), ("C", ("CD",)), ("J", tuple(L.ADJ_TAGS)), ("R", tuple(L.ADV_TAGS)), ("X", ("CC",)), ("Z", (",",)),
          ("N", tuple(L.NOUN_TAGS)), ("P", ("PRP",)), ("G", ("POS",))),
    words=(("Q", ("'", "’")), ("S", ("s",))),
    moves={
        START: {"A": "predeterminer", "D": "open", "P": "pronoun", **_OPEN},
        "predeterminer": {"D": "open", **_OPEN},
        "open": _OPEN,
        "adverb": {"R": "adverb", "J": "adjective"},
        "adjective": {**_OPEN, "XZ": "joined"},
        "joined": {"R": "adverb", "J": "adjective"},
        "owner": _OPEN,
        "apostrophe": {"S": "owner", **_OPEN},
        "noun": {"N": "noun", "G": "owner", "Q": "apostrophe"},
        "pronoun": {},
    },
    accepting=("noun", "pronoun"))


def symbol_numbers(tokens: Column, tags: Column, grammar: ChunkGrammar = NOUN_PHRASES) -> Column:
    """Per token the number of its symbol; what no rule names gets the number after the last."""
    number = {x: n for n, x in enumerate(grammar.symbols)}

    def symbol(token, tag):
        out = F.lit(len(number))
        for rules, value in ((grammar.tags, tag), (grammar.words, token)):        # words are put on last, so they go first
            for x, members in reversed(rules):
                out = F.when(value.isin(list(members)), F.lit(number[x])).otherwise(out)
        return out

    return F.zip_with(tokens, tags, symbol)


def chunk_stats(tokens: Column, tags: Column, grammar: ChunkGrammar = NOUN_PHRASES) -> Column:
    """struct(chunks, chars, words): chunks, their characters (tokens joined by one space) and their tokens, over the whole row."""
    states, moves, first = grammar.table()
    width = len(grammar.symbols) + 1
    table = F.array(*[F.lit(m) for m in moves])
    zipped = F.arrays_zip(F.transform(tokens, F.length).alias("len"), symbol_numbers(tokens, tags, grammar).alias("x"))
    zero = F.lit(0)
    init = F.struct(*[zero.alias(n) for n in ("state", "len", "n", "good", "good_n", "chunks", "chars", "words")])

    def step(acc, z):
        to = F.element_at(table, acc["state"] * width + z["x"] + 1)
        anew = to >= len(states)
        state = to % len(states)
        length = F.when(~anew, acc["len"] + z["len"] + 1).when(state > 0, z["len"]).otherwise(zero)
        n = F.when(~anew, acc["n"] + 1).when(state > 0, F.lit(1)).otherwise(zero)
        ends = state >= first
        return F.struct(state.alias("state"), length.alias("len"), n.alias("n"),
                        F.when(ends, length).when(anew, zero).otherwise(acc["good"]).alias("good"),
                        F.when(ends, n).when(anew, zero).otherwise(acc["good_n"]).alias("good_n"),
                        *_counted(acc, anew))

    def finish(acc):
        return F.struct(*_counted(acc, F.lit(True)))

    return F.aggregate(zipped, init, step, finish)


def _counted(acc: Column, closes: Column) -> list[Column]:
    add = closes & (acc["good_n"] > 0)
    return [(acc["chunks"] + F.when(add, 1).otherwise(0)).alias("chunks"), (acc["chars"] + F.when(add, acc["good"]).otherwise(0)).alias("chars"),
            (acc["words"] + F.when(add, acc["good_n"]).otherwise(0)).alias("words")]
