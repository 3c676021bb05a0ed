"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_repair, compact_windows, kmeans_tree, minhash_dedup, ngram_lm, periodic_runs, projection_dedup, sp_codec,
               token_output, toxicity, url_filter, whitening, winnow)
from .common import heldout, table

REGISTRY: dict = {}
ORACLES: dict[str, str] = {}

# Fixed values of op8: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def tokenizer_file(name: str, path: str | None = None) -> bytes:
    """The bytes of a public tokenizer file; ``path`` overrides the installed place."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


@query
def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.fit_and_score(table(spark, sf_dir, "documents"), ~heldout(F.col("doc_id"), 1))


@query
def op2_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_projection_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.format_chats(table(spark, sf_dir, "conversations"))


@query
def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query
def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2, 50_257,
                                     special_ids=True)


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query
def op12_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.repeated_texts(table(spark, sf_dir, "documents"))))


@query
def op13_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, recall=0.95)


_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLES["op8_url_filter"] = f"""
WITH rules(rh, rp, v) AS (VALUES {_RULE_VALUES}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
fit AS (
  SELECT p.page_id, p.host, p.path, r.rh || r.rp AS rule, r.v,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rh || r.rp) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
"""

_WORDS = r"list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op2_winnow_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n,
         array_to_string(list_slice(w, s, s + CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END - 1), ' ') AS g
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(s) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
  FROM d, (SELECT DISTINCT n FROM iw) k, unnest(generate_series(1, len(w) - n + 1)) AS t(s) WHERE len(w) >= n),
found AS (SELECT dw.doc_id, dw.s, iw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM found) f, unnest(generate_series(s, s + n - 1)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
