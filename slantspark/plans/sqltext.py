"""DuckDB (RE2) renderings of our column functions, for the oracle SQL.

The rules come from the same data as the Spark side (``functions.patterns``,
``functions.lexicon``), but the SQL deliberately uses a different formulation
where that makes it an independent check: token runs (noun chunks, entities)
are computed with ``unnest`` + window functions instead of array folds.
"""

from __future__ import annotations

from slantspark.functions import lexicon as L
from slantspark.functions import patterns as P
from slantspark.operators import annotate as K


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def t6(x: str) -> str:
    s = f"regexp_replace({x}, {lit(P.WS_RUN)}, ' ', 'g')"
    s = f"regexp_replace({s}, {lit(P.URL)}, '', 'g')"
    s = f"trim({s})"
    s = f"regexp_replace({s}, {lit(P.TAG_OR_URL_RE2)}, '', 'g')"
    return f"lower({s})"


def t13(x: str) -> str:
    s = f"regexp_replace({x}, {lit(P.DL_URL)}, '', 'g')"
    s = f"regexp_replace({s}, {lit(P.DL_TAG_RE2)}, '', 'g')"
    s = f"regexp_replace({s}, {lit(P.DL_PUNCT)}, '', 'g')"
    return f"regexp_replace(lower({s}), {lit(P.EDGE_WS)}, '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(P.TOKEN)})"


def rule_tag(x: str) -> str:
    by_tag = K._tags_by_word()
    all_words = [w for ws in by_tag.values() for w in ws]
    lex = "CASE " + " ".join(f"WHEN {x} IN {in_list(ws)} THEN {lit(t)}" for t, ws in by_tag.items()) + " END"
    punct = "CASE " + " ".join(f"WHEN {x} = {lit(ch)} THEN {lit(t)}" for ch, t in L.PUNCT_TAGS.items()) + " END"
    groups = []
    for last, rules in K.suffix_groups().items():
        inner = " ".join(f"WHEN ends_with({x}, {lit(s)}) AND length({x}) >= {len(s) + 2} THEN {lit(t)}" for s, t in rules)
        groups.append(f"WHEN ends_with({x}, {lit(last)}) THEN CASE {inner} ELSE 'NN' END")
    suffix = "CASE " + " ".join(groups) + " ELSE 'NN' END"
    return ("CASE "
            f"WHEN {x} IN {in_list(all_words)} THEN {lex} "
            f"WHEN {x} >= '0' AND {x} < ':' THEN 'CD' "
            f"WHEN {x} IN {in_list(L.PUNCT_TAGS)} THEN {punct} "
            f"WHEN length({x}) = 1 AND regexp_full_match({x}, {lit('[^' + P.WORD_CLASS + ']')}) THEN 'SYM' "
            f"WHEN length({x}) < 3 THEN 'NN' "
            f"ELSE {suffix} END")


def np_class(tag: str) -> str:
    return (f"CASE WHEN {tag} IN {in_list(L.NP_NOUN_TAGS)} THEN 'N' WHEN {tag} IN {in_list(L.ADJ_TAGS)} THEN 'J' "
            f"WHEN {tag} IN {in_list(L.NP_DET_TAGS)} THEN 'D' ELSE 'O' END")


def is_entity(x: str) -> str:
    return f"(({x} >= '0' AND {x} < ':') OR {x} IN {in_list(L.ENTITY_WORDS + L.ENTITY_SIGNS)})"


def sentence_count(t: str) -> str:
    return (f"len(list_filter(string_split_regex({t}, {lit(P.SENTENCE_BOUNDARY)}), "
            f"lambda s: regexp_matches(s, {lit(P.HAS_WORD)})))")


def char_count(t: str, chars: str) -> str:
    return f"(length({t}) - length(translate({t}, {lit(chars)}, '')))"


def features_sql(src: str, key: str = "k", text: str = "raw", carry: list[str] | None = None) -> str:
    """All 26 features for ``src`` (a SELECT with columns ``key``, ``text`` and ``carry``).

    Returns a SELECT with ``key``, ``carry`` and the 26 feature columns.
    """
    carry = carry or []
    cs = "".join(f", {c}" for c in carry)
    verbs, adjs, advs = in_list(L.VERB_TAGS), in_list(L.ADJ_TAGS), in_list(L.ADV_TAGS)
    return f"""
WITH src AS ({src}),
cl AS (SELECT {key} AS k{cs}, {t6(text)} AS t FROM src),
tk AS (SELECT k{cs}, t, {tokens('t')} AS toks FROM cl),
tg AS (SELECT k{cs}, t, toks, list_transform(toks, lambda x: {rule_tag('x')}) AS tags FROM tk),
lng AS (SELECT k, unnest(range(len(toks))) AS pos, unnest(toks) AS tok, unnest(tags) AS tag FROM tg),
cls AS (SELECT k, pos, tok, tag, {np_class('tag')} AS cls, {is_entity('tok')} AS e FROM lng),
isl AS (SELECT *, sum(CASE WHEN cls = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS np_isl,
               sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY pos) AS e_isl FROM cls),
npc AS (SELECT k, np_isl, count(*) AS n, sum(length(tok)) AS c, max(CASE WHEN cls = 'N' THEN 1 ELSE 0 END) AS has_n
        FROM isl WHERE cls <> 'O' GROUP BY k, np_isl),
npa AS (SELECT k, count(*) AS chunks, sum(c + n - 1) AS chars FROM npc WHERE has_n = 1 GROUP BY k),
ent AS (SELECT k, e_isl, count(*) AS n, sum(length(tok)) AS c FROM isl WHERE e GROUP BY k, e_isl),
enta AS (SELECT k, count(*) AS runs, sum(c + n - 1) AS chars FROM ent GROUP BY k),
agg AS (SELECT k,
          count(*) AS n, count(DISTINCT tok) AS uniq, sum(length(tok)) AS tchars,
          count(*) FILTER (WHERE tag IN {verbs}) AS verbs,
          count(*) FILTER (WHERE tag IN {adjs}) AS adjs,
          count(*) FILTER (WHERE tag IN {advs}) AS advs,
          count(*) FILTER (WHERE tag IN {in_list(L.PRON_TAGS)}) AS prons,
          count(*) FILTER (WHERE tag IN {in_list(L.CONJ_TAGS)}) AS conjs,
          count(*) FILTER (WHERE tag IN {in_list(L.NOUN_TAGS)}) AS nouns,
          count(*) FILTER (WHERE tok IN {in_list(L.STOP_WORDS)}) AS stops,
          count(*) FILTER (WHERE regexp_full_match(tok, {lit(P.PUNCT_TOKEN[1:-1])})) AS puncts,
          count(*) FILTER (WHERE regexp_full_match(tok, {lit(P.DIGIT_TOKEN[1:-1])})) AS digits,
          count(DISTINCT tok) FILTER (WHERE tag IN {adjs}) AS uadj,
          count(DISTINCT tok) FILTER (WHERE tag IN {advs}) AS uadv
        FROM lng GROUP BY k),
sc AS (SELECT k{cs}, t, {sentence_count('t')} AS sents FROM tg)
SELECT sc.k AS {key}{cs},
  CAST(coalesce(agg.n, 0) AS INTEGER) AS word_count,
  CAST(coalesce(agg.uniq, 0) AS INTEGER) AS unique_words_count,
  CASE WHEN coalesce(agg.n, 0) > 0 THEN CAST(agg.tchars AS DOUBLE) / agg.n ELSE 0.0 END AS avg_word_length,
  CAST(sents AS INTEGER) AS sentence_count,
  CAST(coalesce(verbs, 0) AS INTEGER) AS verbs_count,
  CAST(coalesce(adjs, 0) AS INTEGER) AS adjectives_count,
  CAST(coalesce(advs, 0) AS INTEGER) AS adverbs_count,
  CAST(coalesce(prons, 0) AS INTEGER) AS pronouns_count,
  CAST(coalesce(conjs, 0) AS INTEGER) AS conjunctions_count,
  CAST(coalesce(nouns, 0) AS INTEGER) AS nouns_count,
  CAST(coalesce(enta.runs, 0) AS INTEGER) AS entities_count,
  CAST(coalesce(stops, 0) AS INTEGER) AS stop_words_count,
  CAST(coalesce(puncts, 0) AS INTEGER) AS punctuation_count,
  CAST(coalesce(digits, 0) AS INTEGER) AS digits_count,
  CASE WHEN sents > 0 THEN CAST(coalesce(agg.n, 0) AS DOUBLE) / sents ELSE 0.0 END AS avg_sentence_length,
  CAST(coalesce(npa.chunks, 0) AS INTEGER) AS noun_phrases_count,
  CASE WHEN coalesce(npa.chunks, 0) > 0 THEN CAST(npa.chars AS DOUBLE) / npa.chunks ELSE 0.0 END AS avg_noun_phrase_length,
  CASE WHEN coalesce(enta.runs, 0) > 0 THEN CAST(enta.chars AS DOUBLE) / enta.runs ELSE 0.0 END AS avg_entity_length,
  CAST(coalesce(digits, 0) AS INTEGER) AS numeric_count,
  CAST({char_count('t', chr(34) + chr(39))} AS INTEGER) AS quotes_count,
  CAST(greatest(coalesce(agg.n, 0) - 2, 0) AS INTEGER) AS trigram_length,
  CAST(greatest(coalesce(agg.n, 0) - 1, 0) AS INTEGER) AS bigram_length,
  CAST({char_count('t', '?')} AS INTEGER) AS question_mark_count,
  CAST({char_count('t', '!')} AS INTEGER) AS exclamation_count,
  CAST(coalesce(uadj, 0) AS INTEGER) AS unique_adjectives,
  CAST(coalesce(uadv, 0) AS INTEGER) AS unique_adverbs
FROM sc LEFT JOIN agg ON sc.k = agg.k LEFT JOIN npa ON sc.k = npa.k LEFT JOIN enta ON sc.k = enta.k
"""
