"""The 26 text features F1-F26 and the feature table F27.

Everything is computed on the article row from its cleaned text and token
array: narrow steps, no shuffle.  Cleaning, tokens, sentences and character
counts are column expressions; what hangs on single tokens is counted by
``token_stats``, a batch of texts at a time.  With codes of a learned tagger
or a chunk grammar the same values are column expressions (``token_values``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantspark.functions import lexicon as L
from slantspark.functions.text import preprocess_features
from slantspark.operators import annotate as K
from slantspark.operators import token_stats as TS
from slantspark.session import cut_lineage

# --- fixed values -----------------------------------------------------------
# Output order of the feature table (after label, article_id).
FEATURE_COLUMNS = [
    "word_count", "unique_words_count", "avg_word_length", "sentence_count", "verbs_count",
    "adjectives_count", "adverbs_count", "pronouns_count", "conjunctions_count", "nouns_count",
    "entities_count", "stop_words_count", "punctuation_count", "digits_count", "avg_sentence_length",
    "noun_phrases_count", "avg_noun_phrase_length", "avg_entity_length", "numeric_count", "quotes_count",
    "trigram_length", "bigram_length", "question_mark_count", "exclamation_count", "unique_adjectives",
    "unique_adverbs",
]
# --- end of fixed values ------------------------------------------------------
DOUBLE_FEATURES = {"avg_word_length", "avg_sentence_length", "avg_noun_phrase_length", "avg_entity_length"}


def char_count(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars`` (ASCII) in ``text`` (codegen'd, no regex)."""
    if len(chars) > 2:
        return F.length(text) - F.length(F.translate(text, chars, ""))
    rest = text                                             # a search of the bytes: cheaper than translating each character
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def _unique_with_code(toks: Column, codes: Column, code: str) -> Column:
    picked = F.zip_with(toks, codes, lambda t, c: F.when(F.substring(c, 1, 1) == F.lit(code), t))
    return F.size(F.array_compact(F.array_distinct(picked)))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def with_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_t`` (T6-cleaned text) and ``_tok`` (K1 tokens)."""
    return (df.withColumn("_t", preprocess_features(F.col(text_col)))
              .withColumn("_tok", K.tokenize(F.col("_t"))))


def token_values(toks: Column, codes: Column) -> dict[str, Column]:
    """The values of ``token_stats.FIELDS`` from tokens and given two-letter codes (a learned tagger's)."""
    joined = F.array_join(codes, "")
    groups = F.translate(joined, K.FLAG_LETTERS, "")        # one tag-group letter per token
    flags = F.translate(joined, K.GROUP_LETTERS, "")        # one flag letter per token
    chunks = K.noun_chunk_stats(toks, codes=codes)
    return {
        "tokens": F.size(toks),
        "unique_tokens": F.size(F.array_distinct(toks)),
        "letters": F.length(F.array_join(toks, "")),
        **{name: char_count(groups, of) for name, of in TS.GROUPS.items()},
        **{name: char_count(flags, K.flag_letters(bit)) for name, bit in TS.FLAGS.items()},
        "entity_runs": F.size(F.regexp_extract_all(flags, F.lit(f"[{K.flag_letters(K.FLAG_ENTITY)}]+"), 0)),
        "entity_letters": F.length(F.array_join(F.filter(toks, K.is_entity_token), "")),
        "chunks": chunks["chunks"],
        "chunk_chars": chunks["chars"],
        "unique_adjectives": _unique_with_code(toks, codes, "J"),
        "unique_adverbs": _unique_with_code(toks, codes, "R"),
    }


def feature_columns(text: Column, v: dict[str, Column]) -> list[Column]:
    """F1-F26 from the cleaned text and the values of its tokens (``token_stats`` or ``token_values``)."""
    n = v["tokens"]
    sents = K.sentence_count(text)
    ent_chars = v["entity_letters"] + v["entity_tokens"] - v["entity_runs"]
    cols = {
        "word_count": n,
        "unique_words_count": v["unique_tokens"],
        "avg_word_length": _ratio(v["letters"], n),
        "sentence_count": sents,
        "verbs_count": v["verbs"],
        "adjectives_count": v["adjectives"],
        "adverbs_count": v["adverbs"],
        "pronouns_count": v["pronouns"],
        "conjunctions_count": v["conjunctions"],
        "nouns_count": v["nouns"],
        "entities_count": v["entity_runs"],
        "stop_words_count": v["stops"],
        "punctuation_count": v["puncts"],
        "digits_count": v["digits"],
        "avg_sentence_length": _ratio(n, sents),
        "noun_phrases_count": v["chunks"],
        "avg_noun_phrase_length": _ratio(v["chunk_chars"], v["chunks"]),
        "avg_entity_length": _ratio(ent_chars, v["entity_runs"]),
        "numeric_count": v["digits"],
        "quotes_count": char_count(text, "\"'"),
        "trigram_length": F.greatest(n - 2, F.lit(0)),
        "bigram_length": F.greatest(n - 1, F.lit(0)),
        "question_mark_count": char_count(text, "?"),
        "exclamation_count": char_count(text, "!"),
        "unique_adjectives": v["unique_adjectives"],
        "unique_adverbs": v["unique_adverbs"],
    }
    out = []
    for name in FEATURE_COLUMNS:
        c = cols[name]
        out.append((c.cast("double") if name in DOUBLE_FEATURES else c.cast("int")).alias(name))
    return out


# What a learned tagger, a gazetteer and a sentence model replace.
TAGGER_FEATURES = ["verbs_count", "adjectives_count", "adverbs_count", "pronouns_count", "conjunctions_count", "nouns_count",
                   "noun_phrases_count", "avg_noun_phrase_length", "unique_adjectives", "unique_adverbs"]
GAZETTEER_FEATURES = ["entities_count", "avg_entity_length"]
SENTENCE_FEATURES = ["sentence_count", "avg_sentence_length"]
CHUNK_FEATURES = ["noun_phrases_count", "avg_noun_phrase_length"]


def extract_features(df: DataFrame, text_col: str = "article_text", keep: list[str] | None = None, tagger=None,
                     gazetteer: DataFrame | None = None, sentences=None, chunks=None) -> DataFrame:
    """F1-F26 for every row of ``df``; ``keep`` columns are carried in front.

    ``tagger``: a fitted ``sequence_tagger.SequenceTagger`` with Penn tags; its tags stand in for the rules'.
    ``gazetteer``: (entity, label); its longest matches stand in for the entity word list.
    ``sentences``: a fitted ``sentence_model.SentenceModel``; its sentence ends stand in for the pattern's.
    ``chunks``: a ``chunk_grammar.ChunkGrammar``; its chunks over the tags (the tagger's, if given) stand in for the runs of tags.
    """
    keep = keep or []
    if tagger is not None or gazetteer is not None or sentences is not None:
        return _learned_features(df, text_col, keep, tagger, gazetteer, sentences, chunks)
    staged = with_tokens(df.select(*keep, text_col), text_col)
    if chunks is None:
        staged = staged.select(*keep, "_t", TS.token_stats(F.col("_tok")).alias("_s"))
        return staged.select(*keep, *feature_columns(F.col("_t"), {n: F.col("_s")[n] for n in TS.FIELDS}))
    staged = staged.select(*keep, "_t", "_tok", K.token_codes(F.col("_tok")).alias("_code"), K.pos_tags(F.col("_tok")).alias("_tags"))
    staged = _with_chunks(staged, chunks)
    columns = _chunk_columns(feature_columns(F.col("_t"), token_values(F.col("_tok"), F.col("_code"))))
    return staged.select(*keep, *columns)


def _with_chunks(staged: DataFrame, grammar) -> DataFrame:
    """Adds ``_np``, the grammar's counts over ``_tok`` and ``_tags``: a column of its own, so that the fold runs once a row."""
    from slantspark.operators import chunk_grammar as CG
    return staged.withColumn("_np", CG.chunk_stats(F.col("_tok"), F.col("_tags"), grammar))


def _chunk_columns(columns: list[Column]) -> list[Column]:
    """The feature columns with F16 and F17 by the grammar's counts."""
    stats = F.col("_np")
    new = dict(zip(CHUNK_FEATURES, (F.coalesce(stats["chunks"], F.lit(0)), _ratio(stats["chars"], stats["chunks"]))))
    return [new[n].alias(n) if n in new else c for n, c in zip(FEATURE_COLUMNS, columns)]


def tag_codes(tags: Column, names: list[str]) -> Column:
    """The two-letter codes of a tag array: the tag's group and no flag."""
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(K.tag_group(name), []).append(name)

    def code(tag):
        out = F.lit("Oa")
        for letter, members in groups.items():
            out = F.when(tag.isin(members), F.lit(letter + "a")).otherwise(out)
        return out

    return F.transform(tags, code)


def _learned_features(df: DataFrame, text_col: str, keep: list[str], tagger, gazetteer: DataFrame | None, sentences, chunks=None) -> DataFrame:
    """Texts and tokens are stored once; only tokens (tagger) or plausible entity starts (gazetteer) and counts move."""
    from slantspark.operators import gazetteer as G
    from slantspark.operators import sentence_model as SN
    from slantspark.operators import sequence_tagger as ST
    staged = cut_lineage(with_tokens(df.select(*keep, text_col), text_col)
                         .select(*keep, "_t", "_tok", F.monotonically_increasing_id().alias("_row")), "feature-tokens")

    def some(names: list[str], rows: DataFrame, carry: list[str], text: Column, toks: str, codes: Column, tags: Column) -> DataFrame:
        places = [FEATURE_COLUMNS.index(n) for n in names]
        coded = rows.select(*carry, text.alias("_t"), F.col(toks).alias("_tok"), codes.alias("_code"), *([] if chunks is None else [tags.alias("_tags")]))
        columns = feature_columns(F.col("_t"), token_values(F.col("_tok"), F.col("_code")))
        if chunks is not None:
            coded, columns = _with_chunks(coded, chunks), _chunk_columns(columns)
        return coded.select(*carry, *[columns[p] for p in places])

    learned = ((TAGGER_FEATURES if tagger is not None else []) + (GAZETTEER_FEATURES if gazetteer is not None else [])
               + (SENTENCE_FEATURES if sentences is not None else []))
    out = some([n for n in FEATURE_COLUMNS if n not in learned], staged, [*keep, "_row"], F.col("_t"), "_tok", K.token_codes(F.col("_tok")), K.pos_tags(F.col("_tok")))
    if tagger is not None:
        tokens = staged.select("_row", F.posexplode("_tok").alias("pos", "tok"))
        tagged = ST.tag_sequences(tokens, tagger, ["_row"])
        out = out.join(some(TAGGER_FEATURES, tagged, ["_row"], F.lit(""), "tok", tag_codes(F.col("tags"), tagger.names), F.col("tags")), "_row", "left")
    if gazetteer is not None:
        spans = G.pick_longest(G.entity_matches(staged.select("_row", F.col("_tok").alias("_toks")), gazetteer))
        out = out.join(spans.groupBy("_row").agg(F.count("*").cast("int").alias("entities_count"), F.avg(F.length("entity")).alias("avg_entity_length")),
                       "_row", "left")
    if sentences is not None:
        out = out.join(SN.sentence_counts(staged, "_row", "_t", sentences), "_row", "left")
        out = out.withColumn("avg_sentence_length", _ratio(F.col("word_count"), F.col("sentence_count")))
    return out.select(*keep, *[F.coalesce(c, F.lit(0.0 if c in DOUBLE_FEATURES else 0)).alias(c) for c in FEATURE_COLUMNS])


def feature_table(df: DataFrame, text_col: str = "article_text", tagger=None, gazetteer: DataFrame | None = None,
                  sentences=None, chunks=None) -> DataFrame:
    """label, article_id, then the 26 features in the reference order.

    P13: a missing ``bias`` column gives label 'Unknown'; a missing id gives null.
    """
    label = F.col("bias") if "bias" in df.columns else F.lit("Unknown")
    art = F.col("article_id").cast("long") if "article_id" in df.columns else F.lit(None).cast("long")
    base = df.select(label.alias("label"), art.alias("article_id"), F.col(text_col).alias("_text"))
    return extract_features(base, "_text", keep=["label", "article_id"], tagger=tagger, gazetteer=gazetteer, sentences=sentences, chunks=chunks)
