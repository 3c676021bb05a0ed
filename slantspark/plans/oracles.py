"""DuckDB oracle SQL for the registered queries (tables are pre-registered views).

Column names and types match the Spark side of ``plans.queries``.
"""

from __future__ import annotations

from slantspark.operators import features as FE
from slantspark.plans import sqltext as S

ORACLES: dict[str, str] = {}

BIAS = ("CASE WHEN quality = 1 AND toxic = 0 THEN 'least' WHEN quality = 0 AND toxic = 0 THEN 'left-center' "
        "WHEN quality = 1 AND toxic = 1 THEN 'right-center' WHEN quality = 0 AND toxic = 1 THEN 'right' END")

ARTICLES_RAW = ("SELECT CAST(doc_id AS VARCHAR) AS article_id, source AS title, '' AS published_at, "
                "text AS article_text FROM documents")
TRUTH_RAW = (f"SELECT CAST(doc_id AS VARCHAR) AS article_id, '' AS url, "
             f"CASE WHEN ({BIAS}) = 'least' THEN 'false' ELSE 'true' END AS hyperpartisan, "
             f"{BIAS} AS bias, 'publisher' AS labeled_by FROM labels")
MERGED = f"""
SELECT a.article_id, a.title, a.article_text, t.hyperpartisan, t.bias FROM
 (SELECT TRY_CAST(article_id AS BIGINT) AS article_id, title, article_text FROM ({ARTICLES_RAW})
  WHERE TRY_CAST(article_id AS BIGINT) IS NOT NULL AND article_text IS NOT NULL) a
 JOIN
 (SELECT TRY_CAST(article_id AS BIGINT) AS article_id, CAST(hyperpartisan AS BOOLEAN) AS hyperpartisan, bias
  FROM ({TRUTH_RAW}) WHERE TRY_CAST(article_id AS BIGINT) IS NOT NULL) t
 ON a.article_id = t.article_id"""
RELABELLED = f"""
SELECT article_id, coalesce(title, '') AS title, coalesce(article_text, '') AS article_text, hyperpartisan,
  CASE coalesce(bias, '') WHEN 'left-center' THEN 'left' WHEN 'right-center' THEN 'right' ELSE coalesce(bias, '') END AS bias
FROM ({MERGED})"""
CANDIDATES = "SELECT CAST(doc_id AS VARCHAR) AS article_id FROM documents UNION ALL SELECT source FROM documents"
PAGE_TEXT = "SELECT page_id, concat('see ', url, ' ok ', html) AS raw FROM pages"


def _doc_features(cols: list[str], src: str = "SELECT doc_id, text AS raw FROM documents") -> str:
    inner = S.features_sql(src, key="doc_id", text="raw")
    return f"SELECT doc_id, {', '.join(cols)} FROM ({inner})"


ORACLES.update({
    "article_null_profile": f"""SELECT count(*) FILTER (WHERE article_id IS NULL) AS article_id_nulls,
        count(*) FILTER (WHERE title IS NULL) AS title_nulls,
        count(*) FILTER (WHERE article_text IS NULL) AS article_text_nulls FROM ({ARTICLES_RAW})""",
    "truth_null_profile": f"""SELECT count(*) FILTER (WHERE article_id IS NULL) AS article_id_nulls,
        count(*) FILTER (WHERE bias IS NULL) AS bias_nulls FROM ({TRUTH_RAW})""",
    "valid_id_counts": f"""SELECT count(*) FILTER (WHERE TRY_CAST(article_id AS BIGINT) IS NOT NULL) AS valid_ids,
        count(*) FILTER (WHERE TRY_CAST(article_id AS BIGINT) IS NULL) AS invalid_ids,
        count(*) AS total_rows FROM ({CANDIDATES})""",
    "invalid_ids": f"""SELECT article_id, count(*) AS n FROM ({CANDIDATES})
        WHERE TRY_CAST(article_id AS BIGINT) IS NULL GROUP BY article_id""",
    "distinct_bias": f"SELECT DISTINCT bias FROM ({TRUTH_RAW})",
    "merged_articles": MERGED,
    "relabelled": RELABELLED,
    "bias_counts": f"SELECT bias, count(*) AS n FROM ({RELABELLED}) GROUP BY bias",
    "clean_text": f"SELECT doc_id, {S.t6('text')} AS clean_text FROM documents",
    "clean_pages": f"SELECT page_id, {S.t6('raw')} AS clean_text FROM ({PAGE_TEXT})",
    "clean_text_dl": f"SELECT doc_id, {S.t13('text')} AS clean_text FROM documents",
    "clean_pages_dl": f"SELECT page_id, {S.t13('raw')} AS clean_text FROM ({PAGE_TEXT})",
    "token_features": _doc_features(["word_count", "unique_words_count", "avg_word_length",
                                     "punctuation_count", "digits_count", "numeric_count"]),
    "char_features": _doc_features(["quotes_count", "question_mark_count", "exclamation_count"],
                                   "SELECT doc_id, translate(text, '.,', '?''') AS raw FROM documents"),
    "ngram_features": _doc_features(["trigram_length", "bigram_length"]),
    "sentence_features": _doc_features(["sentence_count", "avg_sentence_length"]),
    "stopword_features": _doc_features(["stop_words_count"]),
    "pos_features": _doc_features(["verbs_count", "adjectives_count", "adverbs_count",
                                   "pronouns_count", "conjunctions_count", "nouns_count"]),
    "unique_pos": _doc_features(["unique_adjectives", "unique_adverbs"]),
    "noun_phrases": _doc_features(["noun_phrases_count", "avg_noun_phrase_length"]),
    "entity_features": _doc_features(["entities_count", "avg_entity_length"]),
    "all_doc_features": _doc_features(FE.FEATURE_COLUMNS),
    "feature_table": "SELECT label, article_id, " + ", ".join(FE.FEATURE_COLUMNS) + " FROM ("
                     + S.features_sql(f"SELECT article_id, bias AS label, article_text AS raw FROM ({RELABELLED})",
                                      key="article_id", text="raw", carry=["label"]) + ")",
    "conversation_features": "SELECT conv_id, turn, " + ", ".join(FE.FEATURE_COLUMNS) + " FROM ("
                             + S.features_sql("SELECT conv_id * 1000000 + turn AS k2, conv_id, turn, text AS raw FROM conversations",
                                              key="k2", text="raw", carry=["conv_id", "turn"]) + ")",
})

# --- tagger, splits, KNN, metrics, label codes, token ids ---------------------------------------

from slantspark.functions import lexicon as _L  # noqa: E402
from slantspark.functions import patterns as _P  # noqa: E402

BUCKET = "CAST(('0x' || substr(md5(concat(CAST({id} AS VARCHAR), ':42')), 1, 8)) AS BIGINT) % 100"
FEATURE_TABLE = ORACLES["feature_table"]


def _dist(a: str, b: str) -> str:
    terms = [f"(CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE)) * (CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE))"
             for c in FE.FEATURE_COLUMNS]
    return " + ".join(terms)


KNN = f"""
WITH ft AS ({FEATURE_TABLE}),
s AS (SELECT *, {BUCKET.format(id='article_id')} AS b FROM ft WHERE label <> ''),
tr AS (SELECT * FROM s WHERE b >= 20), te AS (SELECT * FROM s WHERE b < 20),
d AS (SELECT te.article_id AS test_id, tr.article_id AS train_id, tr.label AS train_label, {_dist('te', 'tr')} AS dist
      FROM te CROSS JOIN tr),
r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS rn FROM d),
v AS (SELECT test_id, train_label, count(*) AS n FROM r WHERE rn <= 5 GROUP BY test_id, train_label),
p AS (SELECT test_id, train_label AS prediction, row_number() OVER (PARTITION BY test_id ORDER BY n DESC, train_label) AS rn FROM v)
SELECT te.article_id, te.label, p.prediction FROM te LEFT JOIN p ON te.article_id = p.test_id AND p.rn = 1"""

CLASSES = ("least", "left", "right")
KNN_SHARES = KNN[:KNN.rindex("SELECT te.article_id")] + f"""
SELECT te.article_id, te.label, any_value(p.prediction) AS prediction,
       {', '.join(f"coalesce(sum(v.n) FILTER (WHERE v.train_label = '{c}'), 0) / 5.0 AS p{k}" for k, c in enumerate(CLASSES))}
FROM te LEFT JOIN v ON te.article_id = v.test_id LEFT JOIN p ON te.article_id = p.test_id AND p.rn = 1
GROUP BY te.article_id, te.label"""

PER_CLASS = f"""
WITH k AS ({KNN}),
cm AS (SELECT label, prediction, count(*) AS n FROM k GROUP BY label, prediction),
cls AS (SELECT label AS c FROM cm UNION SELECT prediction AS c FROM cm),
sup AS (SELECT label AS c, sum(n) AS support FROM cm GROUP BY label),
prd AS (SELECT prediction AS c, sum(n) AS predicted FROM cm GROUP BY prediction),
tp AS (SELECT label AS c, n AS tp FROM cm WHERE label = prediction),
t AS (SELECT cls.c, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
      FROM cls LEFT JOIN sup ON cls.c = sup.c LEFT JOIN prd ON cls.c = prd.c LEFT JOIN tp ON cls.c = tp.c),
m AS (SELECT c, support, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS p,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS r FROM t)
SELECT c, support, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM m"""

ENCODE3 = "CAST(CASE {b} WHEN 'least' THEN 0 WHEN 'right' THEN 1 WHEN 'left' THEN 2 ELSE 0 END AS INTEGER)"
ENCODE5 = ("CAST(CASE {b} WHEN 'least' THEN 0 WHEN 'right' THEN 1 WHEN 'left' THEN 2 WHEN 'right-center' THEN 3 "
           "WHEN 'left-center' THEN 4 ELSE 0 END AS INTEGER)")
DECODE3 = "CASE {c} WHEN 0 THEN 'least' WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE 'Invalid predicted label' END"
MERGED_FILLED = f"SELECT article_id, coalesce(bias, '') AS bias FROM ({MERGED})"

TAGGED_CORPUS = f"""
WITH tk AS (SELECT doc_id, {S.tokens(S.t6('text'))} AS toks FROM documents),
lng AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM tk),
tg AS (SELECT doc_id, pos, tok, {S.rule_tag('tok')} AS tag FROM lng)
SELECT tok, CASE WHEN lag(tag) OVER w = 'DT' AND tag IN {S.in_list(_L.VERB_TAGS)} THEN 'NN'
                 WHEN lag(tag) OVER w IN ('TO', 'MD') AND tag = 'NN' THEN 'VB' ELSE tag END AS tag
FROM tg WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""

ORACLES.update({
    "fit_suffix_tagger": f"""
WITH c AS (SELECT right(tok, 3) AS suffix, tag FROM ({TAGGED_CORPUS}) WHERE length(tok) > 3),
cnt AS (SELECT suffix, tag, count(*) AS n FROM c GROUP BY suffix, tag),
best AS (SELECT suffix, tag, n, CAST(sum(n) OVER (PARTITION BY suffix) AS BIGINT) AS total,
                row_number() OVER (PARTITION BY suffix ORDER BY n DESC, tag) AS rn FROM cnt)
SELECT suffix, tag, n, total FROM best WHERE rn = 1""",
    "fit_tagger": f"""
WITH tk AS (SELECT doc_id, {S.tokens(S.t6('text'))} AS toks FROM documents),
lng AS (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM tk),
tg AS (SELECT doc_id, pos, tok, {S.rule_tag('tok')} AS tag FROM lng),
ctx AS (SELECT tok, CASE WHEN lag(tag) OVER w = 'DT' AND tag IN {S.in_list(_L.VERB_TAGS)} THEN 'NN'
                         WHEN lag(tag) OVER w IN ('TO', 'MD') AND tag = 'NN' THEN 'VB' ELSE tag END AS tag
        FROM tg WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cnt AS (SELECT tok, tag, count(*) AS n FROM ctx GROUP BY tok, tag),
best AS (SELECT tok, tag, n, CAST(sum(n) OVER (PARTITION BY tok) AS BIGINT) AS total,
                row_number() OVER (PARTITION BY tok ORDER BY n DESC, tag) AS rn FROM cnt)
SELECT tok, tag, n, total FROM best WHERE rn = 1""",
    "hash_split": f"SELECT article_id, {BUCKET.format(id='article_id')} AS bucket, "
                  f"{BUCKET.format(id='article_id')} < 20 AS is_test FROM ({RELABELLED})",
    "hash_split_dl": f"SELECT article_id, {BUCKET.format(id='article_id')} AS bucket, "
                     f"{BUCKET.format(id='article_id')} < 10 AS is_eval FROM ({RELABELLED})",
    "knn_predict": KNN,
    "accuracy": f"SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({KNN})",
    "confusion": f"SELECT label, prediction, count(*) AS n FROM ({KNN}) GROUP BY label, prediction",
    "class_report": f"""
WITH m AS ({PER_CLASS})
SELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""",
    "weighted_prf": f"""
WITH m AS ({PER_CLASS})
SELECT round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall,
       round(sum(f * support) / sum(support), 6) AS f1_score FROM m""",
    "label_encode": f"SELECT article_id, bias, {ENCODE3.format(b='bias')} AS labels FROM ({RELABELLED})",
    "five_class": f"SELECT article_id, bias, {ENCODE5.format(b='bias')} AS labels FROM ({MERGED_FILLED})",
    "label_decode": f"SELECT article_id, {ENCODE5.format(b='bias')} AS labels, "
                    f"{DECODE3.format(c=ENCODE5.format(b='bias'))} AS predicted_label FROM ({MERGED_FILLED})",
    "vocab_encode": f"""
WITH t AS (SELECT doc_id, {S.t13('text')} AS ct FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS token
      FROM (SELECT doc_id, list_filter(string_split_regex(ct, {S.lit(_P.WS_RUN)}), lambda x: x <> '') AS ws FROM t)),
cnt AS (SELECT token, count(*) AS n FROM w GROUP BY token),
ranked AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rk FROM cnt),
vocab AS (SELECT token, rk + 3 AS id FROM ranked),
enc AS (SELECT w.doc_id, w.pos, coalesce(v.id, 1) AS id FROM w LEFT JOIN vocab v ON w.token = v.token WHERE w.pos < 510),
agg AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS body, count(*) AS nb FROM enc GROUP BY doc_id)
SELECT t.doc_id, '2' || coalesce(' ' || body, '') || ' 3' || repeat(' 0', CAST(510 - coalesce(nb, 0) AS INTEGER)) AS ids_text,
       CAST(coalesce(nb, 0) + 2 AS INTEGER) AS n_tokens
FROM t LEFT JOIN agg ON t.doc_id = agg.doc_id""",
})

# --- sources -------------------------------------------------------------------------------------

_FIRST_WORD = S.lit(__import__("slantspark.sources.xml", fromlist=["FIRST_WORD"]).FIRST_WORD)
PADDED = "concat('  \\N', article_text, chr(9), chr(34), '\\', chr(13), chr(10), ' ')"
LEAD_TEXT = (f"array_to_string(list_transform(string_split(text, chr(10)), lambda p: "
             f"CASE WHEN regexp_matches(p, {_FIRST_WORD}) THEN regexp_extract(p, {_FIRST_WORD}, 1) ELSE p END), '')")

ORACLES.update({
    "xml_articles": f"SELECT CAST(doc_id AS VARCHAR) AS article_id, coalesce(source, '') AS title, '' AS published_at, "
                    f"{LEAD_TEXT} AS article_text FROM documents",
    "xml_articles_full": "SELECT CAST(doc_id AS VARCHAR) AS article_id, coalesce(source, '') AS title, '' AS published_at, "
                         "replace(text, chr(10), '') AS article_text FROM documents",
    "xml_truth": TRUTH_RAW,
    "tsv_roundtrip": f"SELECT article_id, ' ' AS title, CAST(NULL AS VARCHAR) AS published_at, {PADDED} AS article_text FROM ({ARTICLES_RAW})",
    "csv_roundtrip": f"SELECT article_id, '\\N' AS title, {PADDED} AS article_text, hyperpartisan, bias FROM ({RELABELLED})",
    "features_csv_roundtrip": FEATURE_TABLE,
})

ORACLES["stream_features"] = ORACLES["all_doc_features"]

ORACLES.update({
    "confusion_wide": f"""
WITH k AS ({KNN})
SELECT label, CAST(count(*) FILTER (WHERE prediction = 'least') AS BIGINT) AS least,
       CAST(count(*) FILTER (WHERE prediction = 'left') AS BIGINT) AS "left",
       CAST(count(*) FILTER (WHERE prediction = 'right') AS BIGINT) AS "right"
FROM k GROUP BY label""",
    "apply_tagger": f"""
WITH lex AS ({ORACLES['fit_tagger']}),
suf AS ({ORACLES['fit_suffix_tagger']}),
ct AS (SELECT conv_id * 1000000 + turn AS k, {S.tokens(S.t6('text'))} AS toks FROM conversations),
lng AS (SELECT k, unnest(toks) AS tok FROM ct)
SELECT coalesce(lex.tag, suf.tag, {S.rule_tag('lng.tok')}) AS tag, count(*) AS n
FROM lng LEFT JOIN lex ON lng.tok = lex.tok
         LEFT JOIN suf ON length(lng.tok) > 3 AND right(lng.tok, 3) = suf.suffix GROUP BY 1""",
})

ORACLES.update({
    "dataset_build": ORACLES["feature_table"],
})

_WORDS = (f"list_filter({S.tokens(S.t6('text'))}, lambda t: regexp_matches(t, '^[\\p{{L}}]'))")
GAZETTEER_ENTITIES = f"""
WITH RECURSIVE
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lng AS (SELECT doc_id, unnest(range(len(w))) AS pos, w FROM d),
grams AS (SELECT doc_id, pos AS start, r.n AS n, array_to_string(w[pos + 1:pos + r.n], ' ') AS gram
          FROM lng, (SELECT unnest(range(1, 5)) AS n) r WHERE pos + r.n <= len(w)),
gaz AS (SELECT gram AS entity FROM grams WHERE n >= 2 GROUP BY gram HAVING count(*) >= 25),
hits AS (SELECT g.doc_id, g.start, max(g.n) AS n FROM grams g JOIN gaz ON g.gram = gaz.entity GROUP BY g.doc_id, g.start),
chain AS (
  SELECT doc_id, min(start) AS start, arg_min(n, start) AS n FROM hits GROUP BY doc_id
  UNION ALL
  SELECT c.doc_id, nx.start, nx.n FROM chain c,
    LATERAL (SELECT h.start, h.n FROM hits h WHERE h.doc_id = c.doc_id AND h.start >= c.start + c.n
             ORDER BY h.start LIMIT 1) nx
)
SELECT c.doc_id, CAST(c.start AS INTEGER) AS start, CAST(c.n AS INTEGER) AS n, g.gram AS entity,
       'PHRASE' || CAST(c.n AS VARCHAR) AS label
FROM chain c JOIN grams g ON g.doc_id = c.doc_id AND g.start = c.start AND g.n = c.n"""
ORACLES["gazetteer_entities"] = GAZETTEER_ENTITIES

# --- profile, defaults, vote shares, and what must hold for learned models --------------------------

_BAD = "(TRY_CAST(article_id AS BIGINT) IS NULL)"


def _nulls(side: str, src: str, col: str) -> str:
    return f"""SELECT '{side} nulls' AS "check", '{col}_nulls' AS value, count(*) FILTER (WHERE {col} IS NULL) AS n FROM ({src})"""


_TEST = f"SELECT article_id, label FROM ({FEATURE_TABLE}) WHERE label <> '' AND {BUCKET.format(id='article_id')} < 20"
ORACLES.update({
    "rejected_ids": f"""
SELECT 'articles' AS side, article_id, count(*) AS n FROM ({CANDIDATES}) WHERE {_BAD} GROUP BY article_id
UNION ALL SELECT 'truth', article_id, count(*) FROM (SELECT article_id FROM ({TRUTH_RAW}) UNION ALL SELECT bias FROM ({TRUTH_RAW}))
WHERE {_BAD} GROUP BY article_id""",
    "dataset_profile": " UNION ALL ".join(
        [_nulls("article", ARTICLES_RAW, c) for c in ("article_id", "title", "article_text")]
        + [_nulls("truth", TRUTH_RAW, c) for c in ("article_id", "bias")]
        + [f"SELECT '{side} ids', '{name}', count(*) FILTER (WHERE {test}) FROM ({src})"
           for side, src in (("article", ARTICLES_RAW), ("truth", TRUTH_RAW))
           for name, test in (("valid_ids", f"NOT {_BAD}"), ("invalid_ids", _BAD), ("total_rows", "TRUE"))]
        + [f"SELECT 'merged labels', coalesce(bias, '(null)'), count(*) FROM ({MERGED}) GROUP BY bias"]),
    "default_label": f"SELECT 'Unknown' AS label, article_id, word_count FROM ({FEATURE_TABLE})",
    "knn_probabilities": f"""SELECT article_id, label, concat_ws(',', prediction, CAST(CAST(p0 AS DOUBLE) AS VARCHAR), CAST(CAST(p1 AS DOUBLE) AS VARCHAR),
        CAST(CAST(p2 AS DOUBLE) AS VARCHAR)) AS result,
        CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS argmax FROM ({KNN_SHARES})""",
    "knn_log_loss": f"""SELECT round(avg(-ln(greatest(least(CAST(CASE label WHEN 'least' THEN p0 WHEN 'left' THEN p1 ELSE p2 END AS DOUBLE),
        1 - 1e-15), 1e-15))), 6) AS log_loss FROM ({KNN_SHARES})""",
    "rf_predict": f"SELECT article_id, label, TRUE AS known_class, TRUE AS sums_to_one, TRUE AS agrees FROM ({_TEST})",
    "dt_predict": f"SELECT article_id, label, TRUE AS known_class, TRUE AS sums_to_one FROM ({_TEST})",
    "model_roundtrip": f"SELECT article_id, TRUE AS same FROM ({_TEST})",
    "argmax_class": f"SELECT article_id, TRUE AS agrees FROM ({_TEST})",
    "predict_text": "SELECT conv_id, turn, TRUE AS known_class, TRUE AS sums_to_one, TRUE AS agrees FROM conversations",
    "textclf_predict": "SELECT conv_id, turn, TRUE AS known_class, TRUE AS agrees FROM conversations",
    "stream_score": "SELECT conv_id, turn, TRUE AS known_class, TRUE AS sums_to_one FROM conversations",
})
