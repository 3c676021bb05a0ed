"""Token annotation K1-K8 as Spark jobs.

The reference runs a pre-trained English pipeline per row.  Here every
annotation is a native array expression on the article row (K1-K8): the
tokens of one document never leave its row, so annotation is a narrow map
with no shuffle and scales with the text volume.  ``fit_tagger`` and
``fit_suffix_tagger`` (K2) learn word and suffix lexicons from a tagged token
table with grouped aggregations, and ``apply_tagger`` joins them back.
``entity_spans`` (K4) matches a gazetteer table (longest non-overlapping spans).

Fidelity: K1, K7, K8 are exact given our tokeniser; K2-K6 are lexicon and rule
approximations of a statistical model (see README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slantspark.functions import lexicon as L
from slantspark.functions import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- K1 tokenise -------------------------------------------------------------

def tokenize(col) -> Column:
    """K1: numbers with inner separators, word runs, or single other characters."""
    return F.regexp_extract_all(_c(col), F.lit(P.TOKEN), 0)


# --- K2 rule tagger ------------------------------------------------------------

def _tags_by_word() -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {}
    for word, tag in L.word_tag_pairs():
        grouped.setdefault(tag, []).append(word)
    return grouped


def suffix_groups() -> dict[str, list[tuple[str, str]]]:
    """Suffix rules grouped by their last character, rule order kept inside a group."""
    groups: dict[str, list[tuple[str, str]]] = {}
    for suffix, tag in L.SUFFIX_TAGS:
        groups.setdefault(suffix[-1], []).append((suffix, tag))
    return groups


def starts_with_digit(x: Column) -> Column:
    """First character is an ASCII digit (two binary string comparisons, no regex)."""
    return (x >= F.lit("0")) & (x < F.lit(":"))


def rule_tag(x: Column, out=None) -> Column:
    """Penn tag for one lowercase token: lexicon, number, punctuation, suffix, default NN.

    Runs per token inside ``transform`` (interpreted), so the common paths are
    kept short: one hash-set probe decides lexicon membership, a digit test is
    two string comparisons, and suffix rules are grouped by last character.
    ``out`` maps each tag constant to the emitted value (see ``rule_code``).
    """
    if out is not None:
        _lit = F.lit
        lit = lambda t: _lit(out(t))
    else:
        lit = F.lit
    by_tag = _tags_by_word()
    all_words = [w for words in by_tag.values() for w in words]
    lex = None
    for tag, words in by_tag.items():
        cond = x.isin(words)
        lex = F.when(cond, lit(tag)) if lex is None else lex.when(cond, lit(tag))
    punct = None
    for ch, tag in L.PUNCT_TAGS.items():
        punct = F.when(x == F.lit(ch), lit(tag)) if punct is None else punct.when(x == F.lit(ch), lit(tag))
    suffix = None
    for last, rules in suffix_groups().items():
        inner = None
        for sfx, tag in rules:
            cond = x.endswith(sfx) & (F.length(x) >= len(sfx) + 2)
            inner = F.when(cond, lit(tag)) if inner is None else inner.when(cond, lit(tag))
        inner = inner.otherwise(lit("NN"))
        cond = x.endswith(last)
        suffix = F.when(cond, inner) if suffix is None else suffix.when(cond, inner)
    return (F.when(x.isin(all_words), lex)
            .when(starts_with_digit(x), lit("CD"))
            .when(x.isin(list(L.PUNCT_TAGS)), punct)
            .when((F.length(x) == 1) & x.rlike("^[^" + P.WORD_CLASS + "]$"), lit("SYM"))
            .when(F.length(x) < 3, lit("NN"))
            .otherwise(suffix.otherwise(lit("NN"))))


def pos_tags(tokens) -> Column:
    """K2 over a token array (narrow, per row)."""
    return F.transform(_c(tokens), lambda x: rule_tag(x))


# One character per tag group, used by the feature path.  Letters are chosen so
# the noun-phrase classes form the contiguous range J..N:
#   J adjective  K possessive pronoun (also a determiner)  L determiner / number
#   M personal pronoun (also a noun-phrase head)  N noun
#   C coordinating conjunction  O other  R adverb  V verb  W wh-pronoun
NP_FIRST, NP_LAST, NP_HEAD_FIRST = "J", "N", "M"


def tag_group(tag: str) -> str:
    if tag in L.VERB_TAGS:
        return "V"
    if tag in L.NOUN_TAGS:
        return "N"
    if tag in L.ADJ_TAGS:
        return "J"
    if tag in L.ADV_TAGS:
        return "R"
    if tag in L.CONJ_TAGS:
        return "C"
    if tag == "PRP":
        return "M"
    if tag == "PRP$":
        return "K"
    if tag in ("WP", "WP$"):
        return "W"
    if tag in L.NP_DET_TAGS:
        return "L"
    return "O"


def rule_code(x: Column) -> Column:
    """``tag_group(rule_tag(x))`` computed in the same single CASE."""
    return rule_tag(x, out=tag_group)


# Token flags as one lowercase letter: 'a' + bitmask of
#   1 stop word (K6)   2 punctuation (K7)   4 digits only (K8)   8 entity token (K4)
FLAG_STOP, FLAG_PUNCT, FLAG_DIGIT, FLAG_ENTITY = 1, 2, 4, 8
FLAG_LETTERS = "abcdefghijklmnop"
GROUP_LETTERS = "CJKLMNORVW"


def flag_letters(bit: int) -> str:
    """All flag letters whose bitmask contains ``bit``."""
    return "".join(ch for i, ch in enumerate(FLAG_LETTERS) if i & bit)


def _may_be_punct(x: Column) -> Column:
    """Cheap exact pre-check for K7 on our tokens: only single characters and
    underscore runs can consist of punctuation alone (``_`` is the only
    punctuation that is also a word character)."""
    return (F.length(x) == 1) | x.startswith("_")


def _may_be_digits(x: Column) -> Column:
    """Cheap exact pre-check for K8: a token starting with an ASCII letter is never all digits."""
    return ~((x >= F.lit("a")) & (x < F.lit("{")))


def token_flags(x: Column) -> Column:
    # The regex flags run only behind their pre-checks: RLIKE converts each
    # token to a Java string, which dominates its cost on word tokens.
    punct = F.when(_may_be_punct(x) & is_punct(x), FLAG_PUNCT).otherwise(0)
    digit = F.when(_may_be_digits(x) & is_digit(x), FLAG_DIGIT).otherwise(0)
    bits = (F.when(is_stop(x), FLAG_STOP).otherwise(0) + punct + digit
            + F.when(is_entity_token(x), FLAG_ENTITY).otherwise(0))
    return F.substring(F.lit(FLAG_LETTERS), bits + 1, 1)


def token_codes(tokens) -> Column:
    """Feature path: per token, its tag-group letter followed by its flag letter
    (one interpreted pass for K2, K4, K6, K7, K8)."""
    return F.transform(_c(tokens), lambda x: F.concat(rule_code(x), token_flags(x)))


def context_tags(tags) -> Column:
    """K2 context pass over rule tags: a verb-looking word after a determiner is a
    noun ("the run"), a noun-looking word after ``to`` or a modal is a verb
    ("will stop")."""
    from slantspark.functions.lexicon import VERB_TAGS
    t = _c(tags)

    def fix(tag, i):
        prev = F.when(i > 0, F.element_at(t, i))  # element_at is 1-based: position i is the previous tag
        return (F.when((prev == "DT") & tag.isin(VERB_TAGS), F.lit("NN"))
                .when(prev.isin("TO", "MD") & (tag == "NN"), F.lit("VB"))
                .otherwise(tag))

    return F.transform(t, fix)


# --- K3 sentences ------------------------------------------------------------------

def sentence_count(col) -> Column:
    """K3: pieces between terminator runs (followed by a space or the end) that hold a word."""
    pieces = F.split(_c(col), P.SENTENCE_BOUNDARY, -1)
    return F.size(F.filter(pieces, lambda s: s.rlike(P.HAS_WORD)))


# --- K4 entities -------------------------------------------------------------------

def is_entity_token(x: Column) -> Column:
    return starts_with_digit(x) | x.isin(L.ENTITY_WORDS + L.ENTITY_SIGNS)


def ngrams(tokens, max_n: int) -> Column:
    """All 1..max_n-grams of a token array as structs (start, n, gram), gram space-joined."""
    toks = _c(tokens)

    def grams_of(n):
        starts = F.when(F.size(toks) >= n, F.sequence(F.lit(0), F.size(toks) - n)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), n.alias("n"),
                                                      F.array_join(F.slice(toks, i + 1, n), " ").alias("gram")))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_n)), grams_of))


def entity_spans(docs: DataFrame, key: str, tokens_col: str, gazetteer: DataFrame) -> DataFrame:
    """K4 with a gazetteer (entity, label): see ``operators.gazetteer``."""
    from slantspark.operators import gazetteer as G
    return G.entity_spans(docs, key, tokens_col, gazetteer)


# --- K5 noun chunks ------------------------------------------------------------------

def np_class(tag: Column) -> Column:
    return (F.when(tag.isin(L.NP_NOUN_TAGS), F.lit("N"))
            .when(tag.isin(L.ADJ_TAGS), F.lit("J"))
            .when(tag.isin(L.NP_DET_TAGS), F.lit("D"))
            .otherwise(F.lit("O")))


def noun_chunk_stats(tokens, tags=None, codes=None) -> Column:
    """K5: chunks are maximal runs of D/J/N tokens that contain a noun-like token.

    Returns struct(chunks, chars): number of chunks and their summed length in
    characters (tokens joined by one space).  Gaps-and-islands as one fold
    over (token, group code); pass ``codes`` (``token_codes``) or ``tags``.
    """
    toks = _c(tokens)
    if codes is None:
        codes = F.transform(_c(tags), lambda g: np_group(g))
    zipped = F.arrays_zip(F.transform(toks, F.length).alias("len"), _c(codes).alias("c"))
    init = F.struct(F.lit(0).alias("cur"), F.lit(False).alias("has_n"),
                    F.lit(0).alias("chunks"), F.lit(0).alias("chars"))

    def step(acc, z):
        c = z["c"]                     # group letter, optionally followed by a flag letter
        inside = (c >= F.lit(NP_FIRST)) & (c < F.lit(chr(ord(NP_LAST) + 1)))
        flush = ~inside & acc["has_n"]
        return F.struct(
            F.when(inside, acc["cur"] + z["len"] + F.when(acc["cur"] > 0, 1).otherwise(0))
             .otherwise(0).alias("cur"),
            F.when(inside, acc["has_n"] | (c >= F.lit(NP_HEAD_FIRST))).otherwise(False).alias("has_n"),
            (acc["chunks"] + F.when(flush, 1).otherwise(0)).alias("chunks"),
            (acc["chars"] + F.when(flush, acc["cur"]).otherwise(0)).alias("chars"),
        )

    def finish(acc):
        last = acc["has_n"]
        return F.struct((acc["chunks"] + F.when(last, 1).otherwise(0)).alias("chunks"),
                        (acc["chars"] + F.when(last, acc["cur"]).otherwise(0)).alias("chars"))

    return F.aggregate(zipped, init, step, finish)


def np_group(tag: Column) -> Column:
    """Tag -> group code restricted to what K5 needs (see ``tag_group``)."""
    return (F.when(tag.isin(L.NOUN_TAGS), F.lit("N")).when(tag == "PRP", F.lit("M"))
            .when(tag.isin(L.ADJ_TAGS), F.lit("J")).when(tag == "PRP$", F.lit("K"))
            .when(tag.isin(L.NP_DET_TAGS), F.lit("L")).otherwise(F.lit("O")))


# --- K6-K8 token flags ----------------------------------------------------------------

def is_stop(x: Column) -> Column:
    """K6."""
    return x.isin(L.STOP_WORDS)


def is_punct(x: Column) -> Column:
    """K7."""
    return x.rlike(P.PUNCT_TOKEN)


def is_digit(x: Column) -> Column:
    """K8."""
    return x.rlike(P.DIGIT_TOKEN)


# --- long-format token table and the table-job tagger (K2 fit/apply) -------------------

def token_table(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, pos, tok) rows; ``pos`` is 0-based.  A narrow ``posexplode``."""
    return df.select(key, F.posexplode(tokenize(text_col)).alias("pos", "tok"))


def tag_counts(tagged: DataFrame, tok_col: str = "tok", tag_col: str = "tag") -> DataFrame:
    """(tok, tag, n): one pass over the tagged corpus with map-side partial counts.

    Its size is the number of distinct (token, tag) pairs, far below the
    corpus; both lexicons below derive from it.
    """
    return tagged.groupBy(F.col(tok_col).alias("tok"), F.col(tag_col).alias("tag")).agg(F.count("*").alias("n"))


def _best_tag(counts: DataFrame, key: str) -> DataFrame:
    """Per key: the tag with the highest count, ties to the smallest tag; plus the key's total."""
    return (counts.groupBy(key)
            .agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("tag").alias("tag"))).alias("m"),
                 F.sum("n").alias("total"))
            .select(key, F.col("m.tag").alias("tag"), (-F.col("m.neg_n")).alias("n"), "total"))


def fit_tagger(tagged: DataFrame | None, tok_col: str = "tok", tag_col: str = "tag", min_count: int = 1,
               counts: DataFrame | None = None) -> DataFrame:
    """K2 fit: most frequent tag per token, ties to the smallest tag.

    ``tagged`` is any (tok, tag) table (or pass precomputed ``tag_counts``).
    A hot token only ever sends one partial count per task.
    """
    c = counts if counts is not None else tag_counts(tagged, tok_col, tag_col)
    return _best_tag(c, "tok").where(F.col("total") >= min_count)


SUFFIX_LEN = 3


def fit_suffix_tagger(tagged: DataFrame | None, tok_col: str = "tok", tag_col: str = "tag",
                      suffix_len: int = SUFFIX_LEN, counts: DataFrame | None = None) -> DataFrame:
    """K2 fit, back-off level: most frequent tag per final ``suffix_len`` letters
    (words longer than the suffix only), ties to the smallest tag.  Derived from
    the (token, tag) counts, so the corpus is not read again."""
    c = counts if counts is not None else tag_counts(tagged, tok_col, tag_col)
    by_suffix = (c.where(F.length("tok") > suffix_len)
                 .groupBy(F.expr(f"right(tok, {suffix_len})").alias("suffix"), "tag")
                 .agg(F.sum("n").alias("n")))
    return _best_tag(by_suffix, "suffix")


def apply_tagger(tokens: DataFrame, lexicon: DataFrame, tok_col: str = "tok",
                 suffixes: DataFrame | None = None, suffix_len: int = SUFFIX_LEN) -> DataFrame:
    """K2 apply: learned word tag, else learned suffix tag, else the rule tag.

    Spark broadcasts a lexicon by its bytes; a larger one goes through a shuffle join
    (AQE splits the partitions of very frequent tokens).
    """
    lex = lexicon.select(F.col("tok").alias("_lex_tok"), F.col("tag").alias("_lex_tag"))
    out = tokens.join(lex, tokens[tok_col] == lex["_lex_tok"], "left")
    tag = F.col("_lex_tag")
    drop = ["_lex_tok", "_lex_tag"]
    if suffixes is not None:
        suf = suffixes.select(F.col("suffix").alias("_sfx"), F.col("tag").alias("_sfx_tag"))
        key = F.when(F.length(tok_col) > suffix_len, F.expr(f"right(`{tok_col}`, {suffix_len})"))
        out = out.withColumn("_key", key).join(suf, F.col("_key") == suf["_sfx"], "left")
        tag = F.coalesce(tag, F.col("_sfx_tag"))
        drop += ["_key", "_sfx", "_sfx_tag"]
    return out.withColumn("tag", F.coalesce(tag, rule_tag(F.col(tok_col)))).drop(*drop)


def noun_chunks_long(tags: DataFrame, key: str) -> DataFrame:
    """K5 over the long (key, pos, tok, tag) table with a window (gaps-and-islands).

    Used where the token table already exists (fixtures, inspection); the
    feature path uses the per-row fold in ``noun_chunk_stats`` to avoid a shuffle.
    """
    w = Window.partitionBy(key).orderBy("pos")
    t = tags.withColumn("cls", np_class(F.col("tag")))
    t = t.withColumn("island", F.sum(F.when(F.col("cls") == "O", 1).otherwise(0)).over(w))
    inside = t.where(F.col("cls") != "O")
    return (inside.groupBy(key, "island")
            .agg(F.count("*").alias("n_tok"), F.sum(F.length("tok")).alias("n_chars"),
                 F.max(F.when(F.col("cls") == "N", 1).otherwise(0)).alias("has_n"))
            .where("has_n = 1")
            .select(key, "island", (F.col("n_chars") + F.col("n_tok") - 1).alias("chunk_chars")))
