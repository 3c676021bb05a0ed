"""K1 by rules: white space first, then prefixes, suffixes, exceptions, contractions and infixes of each piece.

For each piece between white space, leading prefix characters come off one by one.  Of what is left, the longest part that the exception
table holds (the rest of it being suffix characters) stays whole, or is split as the table says; without one, all trailing
suffix characters come off.  The core then loses a contraction ending ("n't", "'ll") and is cut at infix characters, which
are tokens of their own; a comma or colon cuts only where the core has no digit, so "1,000" and "10:30" stay whole.

Nothing is dropped: a piece's tokens, put together, are the piece.  So offsets follow from lengths, and tokens with their
``space`` flag (white space before the next token) rebuild the text, its white space made single and trimmed.  A null text gives
null, an empty one no tokens.  Array expressions on the row only; each pattern repeats single character classes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from slantspark.functions import patterns as P

PREFIX = r"""^["'`(\[{<$#“‘«¿¡]*"""
SUFFIX = r"""[.,!?;:"'`)\]}>%”’»…]*$"""
ENDING = r"(?i)(n['’]t|['’](?:s|re|ve|ll|d|m))$"
INFIX = r"""-–—/…()\[\]{}"“”«»;&|~=+*<>!?"""
RUNS = {True: f"[^{INFIX}]+|[{INFIX}]", False: f"[^{INFIX},:]+|[{INFIX},:]"}      # by: has a digit
DIGIT = "[0-9]"
ONE = "(?s)."
SPECIAL = INFIX + """.,:'`%$#‘’¿¡"""                                   # all prefix, suffix, ending and infix characters
PLAIN = f"^[^{SPECIAL}]+\\z"                                            # one token
MARKED = f"^[^{SPECIAL}]+[.,!?;:]\\z"                                   # such a word and one suffix character

WHOLE = ("a.m.", "co.", "corp.", "dr.", "e-mail", "e.g.", "etc.", "gen.", "gov.", "i.e.", "inc.", "jr.", "ltd.", "ma'am", "mr.", "mrs.", "ms.", "o'clock",
         "p.m.", "prof.", "rep.", "sen.", "sr.", "st.", "t-shirt", "u.k.", "u.n.", "u.s.", "vs.", "x-ray")
SPLIT = {"cannot": 3, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "wanna": 3, "y'all": 2}


@dataclass(frozen=True)
class Exceptions:
    """``whole``: lower-case words never cut; ``split``: lower-case word -> length of its first token."""
    whole: tuple[str, ...] = WHOLE
    split: tuple[tuple[str, int], ...] = tuple(SPLIT.items())

    def __post_init__(self):
        if any(not 0 < n < len(w) for w, n in self.split):
            raise ValueError("a split must leave two tokens")

    @property
    def words(self) -> list[str]:
        return [*self.whole, *[w for w, _ in self.split]]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a lambda over an array of one)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut_core(core: Column) -> Column:
    def cut(core, ending):
        base = F.substring(core, F.lit(1), F.length(core) - F.length(ending))
        runs = _let(base, lambda b: F.when(b.rlike(DIGIT), F.regexp_extract_all(b, F.lit(RUNS[True]), 0)).otherwise(F.regexp_extract_all(b, F.lit(RUNS[False]), 0)))
        return F.concat(runs, F.when(ending == "", F.array().cast("array<string>")).otherwise(F.array(ending)))

    ending = _let(F.regexp_extract(core, ENDING, 0), lambda e: F.when(F.length(e) < F.length(core), e).otherwise(""))
    return _let(ending, lambda e: cut(core, e))


def _rest_tokens(rest: Column, exceptions: Exceptions) -> Column:
    words = exceptions.words

    def longest(bare):
        parts = F.transform(F.sequence(F.length(rest), bare, F.lit(-1)), lambda n: F.substring(rest, F.lit(1), n))
        whole = F.get(F.filter(parts, lambda x: F.lower(x).isin(words)), F.lit(0)) if words else F.lit(None).cast("string")
        return F.struct(whole.alias("whole"), F.substring(rest, F.lit(1), bare).alias("bare"))

    def tokens(found):
        at = F.lit(0)
        for word, n in exceptions.split:
            at = F.when(F.lower(found["whole"]) == word, n).otherwise(at)
        inner = (F.when(found["whole"].isNull(), _cut_core(found["bare"]))
                 .otherwise(_let(at, lambda n: F.when(n > 0, F.array(F.substring(found["whole"], F.lit(1), n), F.substring(found["whole"], n + 1, F.length(found["whole"]))))
                                 .otherwise(F.array(found["whole"])))))
        back = F.substring(rest, F.length(F.coalesce(found["whole"], found["bare"])) + 1, F.length(rest))
        return F.concat(inner, F.regexp_extract_all(back, F.lit(ONE), 0))

    bare = F.length(rest) - F.length(F.regexp_extract(rest, SUFFIX, 0))
    return _let(_let(bare, longest), tokens)


def _piece_tokens(piece: Column, exceptions: Exceptions) -> Column:
    """The rules on one piece; most pieces are plain words, for which they come to the word and its mark."""
    split, word = [w for w, _ in exceptions.split], F.substring(piece, F.lit(1), F.length(piece) - 1)
    plain, marked = piece.rlike(PLAIN), piece.rlike(MARKED)
    if split:
        plain &= ~F.lower(piece).isin(split)
    if exceptions.words:
        marked &= ~F.lower(piece).isin(exceptions.words) & ~F.lower(word).isin(exceptions.words)
    return (F.when(plain, F.array(piece)).when(marked, F.array(word, F.substring(piece, F.length(piece), F.lit(1))))
            .otherwise(_ruled_tokens(piece, exceptions)))


def _ruled_tokens(piece: Column, exceptions: Exceptions) -> Column:
    return _let(F.regexp_extract(piece, PREFIX, 0), lambda front: F.concat(
        F.regexp_extract_all(front, F.lit(ONE), 0),
        _let(F.substring(piece, F.length(front) + 1, F.length(piece)), lambda rest: _rest_tokens(rest, exceptions))))


def pieces(col) -> Column:
    """The text's pieces between white space."""
    text = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(text, P.WS_RUN, -1), lambda x: x != "")


def tokenize(col, exceptions: Exceptions = Exceptions()) -> Column:
    """array<string>: the text's tokens."""
    return F.flatten(F.transform(pieces(col), lambda p: _piece_tokens(p, exceptions)))


def tokenize_with_space(col, exceptions: Exceptions = Exceptions()) -> Column:
    """array<struct(token, space)>: the tokens and whether white space follows before another token."""
    def marked(piece, number, last):
        return _let(_piece_tokens(piece, exceptions), lambda toks: F.transform(
            toks, lambda t, i: F.struct(t.alias("token"), ((i == F.size(toks) - 1) & (number < last)).alias("space"))))

    return _let(pieces(col), lambda ps: F.flatten(F.transform(ps, lambda p, n: marked(p, n, F.size(ps) - 1))))
