"""Regular expressions used by the cleaning and tokenising functions.

Every pattern here is written for java.util.regex (Spark) and is also valid RE2
(DuckDB oracle), so the two engines agree.  Rules kept on purpose:

* no repeated groups (``(?:a|b)+``): java.util.regex recurses per repetition and
  overflows the task stack on long inputs; only single character classes repeat;
* ``.`` stops only at ``\\n`` (Python semantics): Java spells it ``[^...\\n]`` or ``(?d)``, RE2 already
  behaves that way;
* no pattern reads a stretch of text again and again (unclosed ``<``, runs of white space);
* ``\\z`` (not ``$``) anchors the true end of the input in both engines.
"""

# --- fixed values -----------------------------------------------------------
# Python's Unicode ``\s`` as a character-class body: tab..carriage return,
# U+001C..U+0020, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000.
WS_BODY = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The same characters, for functions that take a set.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                             0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))

# The feature-path URL pattern: scheme http/https, then a run of the characters
# ``!``, ``$`` through ``_`` (a code-point range) and ``a`` through ``z``.
URL = r"https?://[!$-_a-z]+"

# Markup: from ``<`` to the next ``>`` on its line.  Bracketed text: the same with ``[`` and ``]``.
TAG = r"<.*?>"
BRACKETS = r"(?d)\[.*?\]"
# --- end of fixed values ------------------------------------------------------

WS = f"[{WS_BODY}]"
WS_RUN = f"{WS}+"
NOT_WS_RUN = f"[^{WS_BODY}]+"

# Python ``\w`` for str patterns.
WORD_CLASS = r"\p{L}\p{N}_"

# Markup in a form that reads each character once: ``<`` up to ``>`` without a line end is ``TAG``; where no ``>``
# follows on the line, group 1 takes all that a further ``<`` could start in vain (for T4 up to the next URL), and the
# replacement ``$1`` puts it back.
OPEN_LINE = r"<[^>\n]*+>|(<[^>\n]*+)"

# Feature path (T4): markup or URL, markup first.
TAG_OR_URL_JAVA = r"<[^>\n]*+>|" + URL + r"|(<[^>\n]*?)(?=https?://|\n|\z)"
TAG_OR_URL_RE2 = TAG + "|" + URL

# DL path.
DL_URL = "http" + NOT_WS_RUN                       # T7  http\S+
DL_TAG_JAVA = OPEN_LINE                            # T8
DL_TAG_RE2 = TAG
DL_PUNCT = f"[^{WORD_CLASS}{WS_BODY}]"            # T9  [^\w\s]
EDGE_WS = f"^{WS}+|{WS}+\\z"                       # T10 strip(), for RE2

# Tokeniser (K1): a number with inner separators ("340,000", "3.5", "2nd"),
# a run of word characters, or any single other non-space character.
TOKEN = (
    r"\p{N}(?:[\p{N}.,]*\p{N})?[" + WORD_CLASS + "]*"
    + "|[" + WORD_CLASS + "]+"
    + "|[^" + WORD_CLASS + WS_BODY + "]"
)

PUNCT_TOKEN = r"^\p{P}+$"       # K7 is_punct
DIGIT_TOKEN = r"^\p{Nd}+$"      # K8 is_digit

# Sentence boundary (K3): a run of terminators followed by a space or the end.
SENTENCE_BOUNDARY = r"[.!?]+(?: |\z)"
HAS_WORD = "[" + WORD_CLASS + "]"
