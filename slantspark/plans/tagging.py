"""Queries of the learned annotators (K2 sequence tagger, K3 sentence model, K4 gazetteer in the features), of the chunk grammar (K5), of tokens by rules (K1), of approximate neighbours (M5), and their DuckDB SQL.

No tagged corpus comes with the test tables.  The tagger's stand-in input is the case of each word, which the raw text itself
gives: the token is the lower-case word, its tag the shape of what stood there (L lower, T title, U upper, M mixed, O no
letter), a sequence is a sentence.  Documents of the 80 % split teach the model, the others are tagged from lower-case
words alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantspark.functions import patterns as P
from slantspark.operators import annotate as K
from slantspark.operators import chunk_grammar as CG
from slantspark.operators import features as FE
from slantspark.operators import rule_tokens as RT
from slantspark.operators import sentence_model as SN
from slantspark.operators import sequence_tagger as ST
from slantspark.operators import split as SP
from slantspark.plans import oracles as O
from slantspark.plans import queries as Q
from slantspark.plans import sqltext as S
from slantspark.session import cut_lineage, spread


def word_shape(raw: Column) -> Column:
    """L lower, T title, U upper, M mixed, O no letter.  ASCII tokens, nearly all, are compared with their lower and upper case, without a pattern."""
    upper, lower, letter = (raw.rlike(rf"\p{{{c}}}") for c in ("Lu", "Ll", "L"))
    shape = F.when(~letter, "O").when(~upper, "L").when(raw.rlike(r"^\p{Lu}\P{Lu}*$"), "T").when(~lower, "U").otherwise("M")
    no_upper, no_lower, rest = raw == F.lower(raw), raw == F.upper(raw), F.substring(raw, 2, 1 << 30)
    plain = (F.when(no_upper, F.when(no_lower, "O").otherwise("L"))
             .when((rest == F.lower(rest)) & (F.left(raw, F.lit(1)) != F.lower(F.left(raw, F.lit(1)))), "T").when(no_lower, "U").otherwise("M"))
    return F.when(F.octet_length(raw) == F.length(raw), plain).otherwise(shape)


def case_tags(spark, sf_dir) -> DataFrame:
    """Stand-in tagged table: (doc_id, sent, pos, tok, tag, bucket) of every document's sentences."""
    d = spread(Q.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", SP.bucket("doc_id").alias("bucket"), F.split(F.regexp_replace("text", P.WS_RUN, " "), P.SENTENCE_BOUNDARY, -1).alias("ss"))
    tokens = F.filter(F.transform("ss", lambda s: K.tokenize(s)), lambda t: F.size(t) > 0)
    s = d.select("doc_id", "bucket", F.posexplode(tokens).alias("sent", "toks")).select("doc_id", "bucket", "sent", F.posexplode("toks").alias("pos", "raw"))
    return s.select("doc_id", "sent", "pos", F.lower("raw").alias("tok"), word_shape(F.col("raw")).alias("tag"), "bucket")


def _fitted(spark, sf_dir) -> tuple[ST.SequenceTagger, DataFrame]:
    rows = cut_lineage(case_tags(spark, sf_dir), "case-tags")
    return ST.fit(rows.where("bucket >= 20"), ["doc_id", "sent"], stored=True), rows.where("bucket < 20")


@Q.query
def hmm_transitions(spark, sf_dir):
    """K2 fit: counts and costs of each pair of neighbouring tags, start and end included."""
    return _fitted(spark, sf_dir)[0].transitions


@Q.query
def hmm_emissions(spark, sf_dir):
    """K2 fit: costs of words and endings, one row for each tag they were seen with."""
    model, _ = _fitted(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in model.names])
    each = F.inline(F.arrays_zip("tags", "costs"))
    return (model.forms.select("kind", "form", "total", "rest", each)
            .select("kind", "form", "total", "rest", F.element_at(names, F.col("tags") + 1).alias("tag"), F.col("costs").alias("cost")))


@Q.query
def viterbi_tags(spark, sf_dir):
    """K2 apply: least-cost tags of every word of the held-out documents."""
    model, test = _fitted(spark, sf_dir)
    return ST.tag_tokens(test, model, ["doc_id", "sent"])


@Q.query
def viterbi_accuracy(spark, sf_dir):
    """K2: held-out words per true tag, how many got it, and the share of all words."""
    model, test = _fitted(spark, sf_dir)
    found = ST.tag_tokens(test, model, ["doc_id", "sent"])
    both = test.join(found.drop("tok"), ["doc_id", "sent", "pos"])
    return both.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == F.col("predicted")).alias("n_right"))


@Q.query
def gazetteer_features(spark, sf_dir):
    """K4 -> F11, F18 with a gazetteer (the corpus phrase table) in the feature path."""
    phrases = cut_lineage(Q.frequent_phrases(cut_lineage(Q.word_tokens(spark, sf_dir), "word-tokens")), "gazetteer")
    d = Q.documents(spark, sf_dir).select("doc_id", F.col("text").alias("article_text"))
    return FE.extract_features(d, "article_text", keep=["doc_id"], gazetteer=phrases).select("doc_id", *FE.GAZETTEER_FEATURES)


@Q.query
def sentence_types(spark, sf_dir):
    """K3 fit: every word seen before a period with its counts and its score as an abbreviation."""
    return SN.fit(Q.documents(spark, sf_dir)).types


@Q.query
def sentence_starters(spark, sf_dir):
    """K3 fit: words that begin sentences more often than chance."""
    return SN.fit(Q.documents(spark, sf_dir)).starters


@Q.query
def learned_sentences(spark, sf_dir):
    """K3 -> F4: sentences of every document by the model fitted on all of them."""
    d = Q.documents(spark, sf_dir)
    return SN.sentence_counts(d, "doc_id", "text", SN.fit(d))


@Q.query
def grammar_chunks(spark, sf_dir):
    """K5: noun phrases of every document by the chunk grammar over the rules' tags: chunks, their characters and tokens."""
    d = FE.with_tokens(Q.documents(spark, sf_dir).select("doc_id", "text"), "text")
    d = d.select("doc_id", "_tok", K.pos_tags(F.col("_tok")).alias("_tags"))
    return d.select("doc_id", CG.chunk_stats(F.col("_tok"), F.col("_tags")).alias("s")).select("doc_id", "s.chunks", "s.chars", "s.words")


@Q.query
def grammar_features(spark, sf_dir):
    """K5 -> F16, F17 with the chunk grammar in the feature path."""
    d = Q.documents(spark, sf_dir).select("doc_id", F.col("text").alias("article_text"))
    return FE.extract_features(d, "article_text", keep=["doc_id"], chunks=CG.NOUN_PHRASES).select("doc_id", *FE.CHUNK_FEATURES)


@Q.query
def rule_tokens(spark, sf_dir):
    """K1 by rules: every document's tokens, their number and a hash of all of them in order."""
    d = Q.documents(spark, sf_dir).select("doc_id", RT.tokenize("text").alias("t"))
    return d.select("doc_id", F.coalesce(F.size("t"), F.lit(0)).alias("n_tokens"), F.md5(F.coalesce(F.array_join("t", "\n"), F.lit(""))).alias("tokens_md5"))


@Q.query
def knn_approx_predict(spark, sf_dir):
    """M5 approximate mode: predictions of the test rows by random-projection buckets."""
    from slantspark.operators import knn_approx as KA
    ft = cut_lineage(Q.DS.features(spark, sf_dir).where(F.col("label") != ""), "knn-features")
    train, test = SP.train_test_split(ft, "article_id", 20)
    return KA.knn_predict_approx(train, test, FE.FEATURE_COLUMNS, "article_id", "label")


# --- DuckDB ---------------------------------------------------------------------------------------

_BOUNDARY, _WS = S.lit(P.SENTENCE_BOUNDARY), S.lit(P.WS_RUN)
_FIT = f"""
pieces AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, {_WS}, ' ', 'g'), {_BOUNDARY}), lambda s: {S.tokens('s')}),
                                      lambda t: len(t) > 0) AS ss FROM documents),
sents AS (SELECT doc_id, unnest(range(len(ss))) AS sent, unnest(ss) AS toks FROM pieces),
lng AS (SELECT doc_id, sent, unnest(range(len(toks))) AS pos, unnest(toks) AS raw FROM sents),
rows_ AS (SELECT doc_id, CAST(sent AS INTEGER) AS sent, CAST(pos AS BIGINT) AS pos, lower(raw) AS tok, {O.BUCKET.format(id='doc_id')} AS bucket,
          CASE WHEN NOT regexp_matches(raw, '\\p{{L}}') THEN 'O' WHEN NOT regexp_matches(raw, '\\p{{Lu}}') THEN 'L'
               WHEN regexp_matches(raw, '^\\p{{Lu}}\\P{{Lu}}*$') THEN 'T' WHEN NOT regexp_matches(raw, '\\p{{Ll}}') THEN 'U' ELSE 'M' END AS tag
          FROM lng),
tr AS (SELECT * FROM rows_ WHERE bucket >= 20),
tags AS (SELECT tag, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share, row_number() OVER (ORDER BY tag) AS k FROM tr GROUP BY tag),
moves AS (SELECT coalesce(lag(tag) OVER w, '^') AS prev, tag FROM tr WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos)
          UNION ALL SELECT arg_max(tag, pos), '$' FROM tr GROUP BY doc_id, sent),
seen AS (SELECT prev, tag, count(*) AS n FROM moves GROUP BY prev, tag),
grid AS (SELECT p.tag AS prev, t.tag FROM (SELECT tag FROM tags UNION ALL SELECT '^') p, (SELECT tag FROM tags UNION ALL SELECT '$') t),
filled AS (SELECT grid.prev, grid.tag, coalesce(n, 0) AS n FROM grid LEFT JOIN seen ON seen.prev = grid.prev AND seen.tag = grid.tag),
trans AS (SELECT prev, tag, CAST(n AS BIGINT) AS n,
                 CAST(round(-ln((n + 1) / (sum(n) OVER (PARTITION BY prev) + (SELECT count(*) FROM tags) + 1)) * 1000000) AS BIGINT) AS cost FROM filled),
pairs AS (SELECT tok, tag, count(*) AS n FROM tr GROUP BY tok, tag),
rare AS (SELECT tok FROM pairs GROUP BY tok HAVING sum(n) <= 10 AND length(tok) > 3),
counts AS (SELECT 'word' AS kind, tok AS form, tag, n FROM pairs
           UNION ALL SELECT 'ending', right(tok, 3), tag, sum(n) FROM pairs WHERE tok IN (SELECT tok FROM rare) GROUP BY 2, 3),
forms AS (SELECT kind, form, tag, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY kind, form) AS BIGINT) AS total FROM counts),
emit AS (SELECT kind, form, total, forms.tag, CAST(round(ln(total + 1.0) * 1000000) AS BIGINT) AS rest,
                CAST(round(-ln((forms.n + share) / ((total + 1) * share)) * 1000000) AS BIGINT) AS cost
         FROM forms JOIN tags ON tags.tag = forms.tag)"""

_VITERBI = f"""
WITH RECURSIVE {_FIT},
te AS (SELECT * FROM rows_ WHERE bucket < 20),
known AS (SELECT DISTINCT kind, form, rest FROM emit),
codes AS (SELECT te.doc_id, te.sent, te.pos, te.tok, coalesce(w.kind, e.kind) AS kind, coalesce(w.form, e.form) AS form, coalesce(w.rest, e.rest, 0) AS rest
          FROM te LEFT JOIN known w ON w.kind = 'word' AND w.form = te.tok
                  LEFT JOIN known e ON e.kind = 'ending' AND length(te.tok) > 3 AND e.form = right(te.tok, 3) AND w.form IS NULL),
costs AS (SELECT doc_id, sent, pos, tok, list(coalesce(emit.cost, rest0) ORDER BY k) AS c
          FROM (SELECT codes.*, codes.rest AS rest0, tags.tag AS t, k FROM codes, tags) x
          LEFT JOIN emit ON emit.kind = x.kind AND emit.form = x.form AND emit.tag = x.t GROUP BY doc_id, sent, pos, tok),
matrix AS (SELECT list(line ORDER BY k) AS m FROM (SELECT t.k, list(trans.cost ORDER BY trans.prev) AS line FROM trans JOIN tags t ON t.tag = trans.tag
           WHERE trans.prev <> '^' GROUP BY t.k)),
entry_ AS (SELECT list(trans.cost ORDER BY trans.tag) AS f FROM trans WHERE prev = '^' AND tag <> '$'),
leave_ AS (SELECT list(trans.cost ORDER BY trans.prev) AS l FROM trans WHERE tag = '$' AND prev <> '^'),
walk AS (
  SELECT doc_id, sent, pos, tok, list_transform(range(1, len(c) + 1), lambda s: f[s] + c[s]) AS score, CAST([] AS BIGINT[]) AS back FROM costs, entry_ WHERE pos = 0
  UNION ALL
  SELECT c.doc_id, c.sent, c.pos, c.tok,
         list_transform(range(1, len(c.c) + 1), lambda s: list_min(list_transform(range(1, len(c.c) + 1), lambda p: w.score[p] + m[s][p])) + c.c[s]),
         list_transform(range(1, len(c.c) + 1), lambda s: list_position(list_transform(range(1, len(c.c) + 1), lambda p: w.score[p] + m[s][p]),
                                                             list_min(list_transform(range(1, len(c.c) + 1), lambda p: w.score[p] + m[s][p]))))
  FROM walk w JOIN costs c ON c.doc_id = w.doc_id AND c.sent = w.sent AND c.pos = w.pos + 1, matrix),
ends AS (SELECT doc_id, sent, max(pos) AS pos FROM walk GROUP BY doc_id, sent),
path AS (
  SELECT walk.doc_id, walk.sent, walk.pos, walk.back,
         list_position(list_transform(range(1, len(score) + 1), lambda s: score[s] + l[s]), list_min(list_transform(range(1, len(score) + 1), lambda s: score[s] + l[s]))) AS s
  FROM walk JOIN ends ON ends.doc_id = walk.doc_id AND ends.sent = walk.sent AND ends.pos = walk.pos, leave_
  UNION ALL
  SELECT w.doc_id, w.sent, w.pos, w.back, p.back[p.s] FROM path p JOIN walk w ON w.doc_id = p.doc_id AND w.sent = p.sent AND w.pos = p.pos - 1)
"""

O.ORACLES["hmm_transitions"] = f"WITH {_FIT} SELECT prev, tag, n, cost FROM trans"
O.ORACLES["hmm_emissions"] = f"WITH {_FIT} SELECT kind, form, total, rest, tag, cost FROM emit"
O.ORACLES["viterbi_tags"] = (_VITERBI + "SELECT te.doc_id, te.sent, te.pos, te.tok, tags.tag AS predicted FROM path "
                             "JOIN te ON te.doc_id = path.doc_id AND te.sent = path.sent AND te.pos = path.pos JOIN tags ON tags.k = path.s")
O.ORACLES["viterbi_accuracy"] = (_VITERBI + "SELECT te.tag, count(*) AS n, count(*) FILTER (WHERE te.tag = tags.tag) AS n_right FROM path "
                                 "JOIN te ON te.doc_id = path.doc_id AND te.sent = path.sent AND te.pos = path.pos JOIN tags ON tags.k = path.s GROUP BY te.tag")

_ALL_TOKENS = f"""
WITH RECURSIVE
d AS (SELECT doc_id, {O._WORDS} AS w FROM documents),
wl AS (SELECT doc_id, unnest(range(len(w))) AS pos, w FROM d),
gaz AS (SELECT array_to_string(w[pos + 1:pos + r.n], ' ') AS entity FROM wl, (SELECT unnest(range(2, 5)) AS n) r WHERE pos + r.n <= len(w)
        GROUP BY entity HAVING count(*) >= {Q.PHRASE_COUNT}),
a AS (SELECT doc_id, {S.tokens(S.t6('text'))} AS w FROM documents),
al AS (SELECT doc_id, unnest(range(len(w))) AS pos, w FROM a),
hits AS (SELECT doc_id, pos AS start, max(r.n) AS n FROM al, (SELECT unnest(range(2, 5)) AS n) r
         WHERE pos + r.n <= len(w) AND array_to_string(w[pos + 1:pos + r.n], ' ') IN (SELECT entity FROM gaz) GROUP BY doc_id, pos),
chain AS (
  SELECT doc_id, min(start) AS start, arg_min(n, start) AS n FROM hits GROUP BY doc_id
  UNION ALL
  SELECT c.doc_id, nx.start, nx.n FROM chain c,
    LATERAL (SELECT h.start, h.n FROM hits h WHERE h.doc_id = c.doc_id AND h.start >= c.start + c.n ORDER BY h.start LIMIT 1) nx)
SELECT a.doc_id, CAST(count(c.n) AS INTEGER) AS entities_count,
       coalesce(avg(length(array_to_string(a.w[c.start + 1:c.start + c.n], ' '))), 0.0) AS avg_entity_length
FROM a LEFT JOIN chain c ON c.doc_id = a.doc_id GROUP BY a.doc_id"""
O.ORACLES["gazetteer_features"] = _ALL_TOKENS


def _col_log(a: str, b: str, ab: str, n: str) -> str:
    """``sentence_model.association`` in SQL."""
    def ln(count, p):
        return f"(CASE WHEN ({count}) > 0 THEN ({count}) * ln({p}) ELSE 0 END)"
    p, p1, p2, rest = f"({b} / {n})", f"({ab} / {a})", f"(({b} - {ab}) / ({n} - {a}))", f"({n} - {a} - {b} + {ab})"
    return (f"(-2 * ({ln(ab, p)} + {ln(f'{a} - {ab}', f'1 - {p}')} + {ln(f'{b} - {ab}', p)} + {ln(rest, f'1 - {p}')} - {ln(ab, p1)} - "
            f"{ln(f'{a} - {ab}', f'1 - {p1}')} - {ln(f'{b} - {ab}', p2)} - {ln(rest, f'1 - {p2}')}))")


_NUM = S.lit(SN.NUMBER_TYPE)
_SENTENCES = f"""
WITH ws AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(text), {S.lit(SN.SPACE)}), lambda w: regexp_replace(w, {S.lit(SN.EDGE)}, '', 'g')),
                                       lambda w: regexp_matches(w, {S.lit(SN.WORD)})) AS w FROM documents),
l AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS w FROM ws),
b AS (SELECT doc_id, pos, regexp_replace(regexp_replace(w, '[!?]+$', ''), '\\.$', '') AS bare,
             CASE WHEN regexp_matches(w, '[!?]$') THEN '!' WHEN ends_with(w, '.') THEN '.' ELSE '' END AS ends FROM l),
m AS (SELECT doc_id, pos, CASE WHEN regexp_matches(bare, {S.lit(SN.NUMBER)}) THEN {_NUM} ELSE bare END AS typ, ends FROM b),
x AS (SELECT *, coalesce(lead(typ) OVER (PARTITION BY doc_id ORDER BY pos), '') AS nxt FROM m),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE ends = '.') AS DOUBLE) AS p FROM x),
cnt AS (SELECT typ, count(*) AS n, count(*) FILTER (WHERE ends = '.') AS n_period FROM x GROUP BY typ),
sc AS (SELECT typ, n, n_period, CAST(n AS DOUBLE) AS c, CAST(n_period AS DOUBLE) AS k, CAST(length(replace(typ, '.', '')) AS DOUBLE) AS letters, p / a AS q FROM cnt, tot
       WHERE n_period > 0 AND regexp_matches(typ, '\\p{{L}}')),
types AS (SELECT typ, n, n_period, round(-2 * (k * ln(q) + CASE WHEN c > k THEN (c - k) * ln(1 - q) ELSE 0 END - k * ln(0.99) - (c - k) * ln(1 - 0.99))
          * exp(-letters) * (length(typ) - letters + 1) * pow(letters, -(c - k)), 6) + 0.0 AS score FROM sc),
abbr AS (SELECT typ FROM types WHERE score >= {SN.ABBREVIATION}),
aft AS (SELECT x.typ, ends, nxt, count(*) AS n, any_value(abbr.typ IS NOT NULL) AS ab FROM x LEFT JOIN abbr ON abbr.typ = x.typ WHERE ends <> '' AND nxt <> '' GROUP BY x.typ, ends, nxt),
sure AS (SELECT nxt AS typ, sum(n) AS n_after FROM aft WHERE ends = '!' OR (NOT ab AND typ <> {_NUM} AND length(typ) > 1) GROUP BY nxt),
brk AS (SELECT CAST(sum(n_after) AS DOUBLE) AS br FROM sure),
st AS (SELECT sure.typ, cnt.n, CAST(n_after AS BIGINT) AS n_after, CAST(cnt.n AS DOUBLE) AS bb, CAST(least(n_after, cnt.n) AS DOUBLE) AS ab, br, a FROM sure JOIN cnt ON cnt.typ = sure.typ, tot, brk),
starters AS (SELECT typ, n, n_after, {_col_log('br', 'bb', 'ab', 'a')} AS ratio FROM st WHERE n_after * a > n * br),
pr AS (SELECT typ, nxt, CAST(sum(n) AS DOUBLE) AS np FROM aft WHERE ends = '.' AND (ab OR typ = {_NUM} OR length(typ) = 1) GROUP BY typ, nxt),
co AS (SELECT pr.typ, pr.nxt, np, CAST(f.n AS DOUBLE) AS nf, CAST(s.n AS DOUBLE) AS ns, least(np, s.n) AS ab, a FROM pr JOIN cnt f ON f.typ = pr.typ JOIN cnt s ON s.typ = pr.nxt, tot),
coll AS (SELECT typ, nxt FROM co WHERE np > 1 AND np * a > nf * ns AND {_col_log('nf', 'ns', 'ab', 'a')} >= {SN.COLLOCATION})
"""
O.ORACLES["sentence_types"] = _SENTENCES + "SELECT typ, n, n_period, score FROM types"
O.ORACLES["sentence_starters"] = _SENTENCES + f"SELECT typ, n, n_after, round(ratio, 6) AS ratio FROM starters WHERE ratio >= {SN.STARTER}"
O.ORACLES["learned_sentences"] = _SENTENCES + f"""
SELECT x.doc_id, CAST(1 + count(*) FILTER (WHERE x.ends <> '' AND x.nxt <> '' AND (x.ends = '!' OR (coll.typ IS NULL AND (abbr.typ IS NULL OR s.typ IS NOT NULL)))) AS INTEGER) AS sentence_count
FROM x LEFT JOIN abbr ON abbr.typ = x.typ LEFT JOIN (SELECT typ FROM starters WHERE ratio >= {SN.STARTER}) s ON s.typ = x.nxt
       LEFT JOIN coll ON coll.typ = x.typ AND coll.nxt = x.nxt GROUP BY x.doc_id"""


def _symbol(token: str, tag: str) -> str:
    g = CG.NOUN_PHRASES
    rules = [f"WHEN {v} IN {S.in_list(list(m))} THEN '{x}'" for v, rs in ((token, g.words), (tag, g.tags)) for x, m in rs]
    return f"CASE {' '.join(rules)} ELSE 'o' END"


# The grammar as one regular expression over the symbols; '<' and '>' mark its matches, a running sum tells the tokens inside.
_MODIFIERS = "(?:R*J(?:[XZ]R*J)*|C)*"
_PHRASE = f"P|A?D?{_MODIFIERS}N+(?:(?:G|QS?){_MODIFIERS}N+)*"
_CHUNKS = f"""
WITH cl AS (SELECT doc_id, {S.tokens(S.t6('text'))} AS toks FROM documents),
sy AS (SELECT doc_id, toks, array_to_string(list_transform(toks, lambda x: {_symbol('x', '(' + S.rule_tag('x') + ')')}), '') AS s FROM cl),
mk AS (SELECT doc_id, regexp_replace(s, '({_PHRASE})', '<\\1>', 'g') AS m FROM sy),
ch AS (SELECT doc_id, unnest(range(length(m))) AS i, unnest(string_split(m, '')) AS c FROM mk WHERE length(m) > 0),
dp AS (SELECT doc_id, c, sum(CASE c WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END) OVER w AS depth,
              sum(CASE WHEN c IN ('<', '>') THEN 0 ELSE 1 END) OVER w AS pos FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
inn AS (SELECT dp.doc_id, count(*) FILTER (WHERE c = '<') AS chunks, count(*) FILTER (WHERE c NOT IN ('<', '>')) AS words,
               sum(CASE WHEN c IN ('<', '>') THEN 0 ELSE length(sy.toks[CAST(pos AS BIGINT)]) END) AS letters
        FROM dp JOIN sy ON sy.doc_id = dp.doc_id WHERE depth = 1 GROUP BY dp.doc_id),
res AS (SELECT sy.doc_id, CASE WHEN toks IS NULL THEN NULL ELSE coalesce(chunks, 0) END AS chunks, CASE WHEN toks IS NULL THEN NULL ELSE coalesce(words, 0) END AS words,
               CASE WHEN toks IS NULL THEN NULL ELSE coalesce(letters + words - chunks, 0) END AS chars FROM sy LEFT JOIN inn ON inn.doc_id = sy.doc_id)
"""
O.ORACLES["grammar_chunks"] = _CHUNKS + "SELECT doc_id, CAST(chunks AS INTEGER) AS chunks, CAST(chars AS INTEGER) AS chars, CAST(words AS INTEGER) AS words FROM res"
O.ORACLES["grammar_features"] = _CHUNKS + """
SELECT doc_id, CAST(coalesce(chunks, 0) AS INTEGER) AS noun_phrases_count, CASE WHEN chunks > 0 THEN CAST(chars AS DOUBLE) / chunks ELSE 0.0 END AS avg_noun_phrase_length FROM res"""


_EX = RT.Exceptions()
_AT = " ".join(f"WHEN {S.lit(w)} THEN {n}" for w, n in _EX.split)
O.ORACLES["rule_tokens"] = f"""
WITH p AS (SELECT doc_id, list_filter(string_split_regex(text, {S.lit(P.WS_RUN)}), lambda x: x <> '') AS ps FROM documents),
a AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS piece FROM p),
b AS (SELECT doc_id, i, regexp_extract(piece, {S.lit(RT.PREFIX)}) AS front, substr(piece, length(regexp_extract(piece, {S.lit(RT.PREFIX)})) + 1) AS rest FROM a),
c AS (SELECT *, length(rest) - length(regexp_extract(rest, {S.lit(RT.SUFFIX)})) AS bare FROM b),
d AS (SELECT *, list_filter(list_transform(range(length(rest), bare - 1, -1), lambda n: substr(rest, 1, n)), lambda x: lower(x) IN {S.in_list(_EX.words)})[1] AS whole FROM c),
e AS (SELECT *, coalesce(whole, substr(rest, 1, bare)) AS core FROM d),
f AS (SELECT *, CASE WHEN length(regexp_extract(core, {S.lit(RT.ENDING)})) < length(core) THEN regexp_extract(core, {S.lit(RT.ENDING)}) ELSE '' END AS ending,
             coalesce(CASE lower(whole) {_AT} ELSE 0 END, 0) AS at_ FROM e),
g AS (SELECT *, substr(core, 1, length(core) - length(ending)) AS base FROM f),
h AS (SELECT doc_id, i, list_concat(list_concat(regexp_extract_all(front, {S.lit(RT.ONE)}),
        CASE WHEN whole IS NULL THEN list_concat(CASE WHEN regexp_matches(base, {S.lit(RT.DIGIT)}) THEN regexp_extract_all(base, {S.lit(RT.RUNS[True])})
                                                      ELSE regexp_extract_all(base, {S.lit(RT.RUNS[False])}) END, CASE WHEN ending = '' THEN [] ELSE [ending] END)
             WHEN at_ > 0 THEN [substr(core, 1, at_), substr(core, at_ + 1)] ELSE [core] END),
        regexp_extract_all(substr(rest, length(core) + 1), {S.lit(RT.ONE)})) AS toks FROM g),
t AS (SELECT doc_id, flatten(list(toks ORDER BY i)) AS t FROM h GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(t), 0) AS INTEGER) AS n_tokens, md5(coalesce(array_to_string(t, chr(10)), '')) AS tokens_md5
FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id"""
