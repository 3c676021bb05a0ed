"""Spark and DuckDB renderings agree on hostile strings; fallback joins equal broadcast joins."""
import random

import duckdb

from paths import SF_SMALL
from slantspark.functions import text as TX
from slantspark.operators import annotate as K
from slantspark.plans import sqltext as S

ALPHABET = (list("aZ09 _-.,;:!?'\"<>/\\#~%[]{}()=&+*$@^`|\t\n\x0b\x0c")
            + ["\x1c", "\x85", "\xa0", "　", "​", "é", "ß", "²", "¼", "́", "http://", "https://",
               "<br>", "</p>", "340,000", "3.5", "\U0001F600"])


def test_spark_and_duckdb_cleaning_and_tokens_agree(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.a, r.b, list(r.c)) for r in df.select(
        "i", TX.preprocess_features("t").alias("a"), TX.preprocess_text_classifier("t").alias("b"),
        K.tokenize(TX.preprocess_features("t")).alias("c")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(f"SELECT i, {S.t6('t')}, {S.t13('t')}, {S.tokens(S.t6('t'))} FROM x").fetchall()
    for i, a, b, c in rows:
        assert got[i] == (a, b, list(c)), repr(texts[i])


def _without_broadcast(spark, make):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shuffle_joins_equal_broadcast_joins(spark):
    from slantspark.plans.queries import REGISTRY
    for name in ("merged_articles", "feature_table", "apply_tagger", "vocab_encode", "gazetteer_entities"):
        rows = [sorted(map(tuple, make()), key=repr) for make in (
            lambda: REGISTRY[name](spark, SF_SMALL).collect(),
            lambda: _without_broadcast(spark, lambda: REGISTRY[name](spark, SF_SMALL).collect()))]
        assert rows[0] == rows[1], name


def test_entities_of_any_length(spark):
    docs = spark.createDataFrame([(1, "he left the united states of america for the united states".split()), (2, []), (3, ["america"])], "k long, w array<string>")
    gaz = spark.createDataFrame([("the united states of america", "A"), ("united states", "B"), ("states", "C")], "entity string, label string")
    got = sorted((r.k, r.start, r.n, r.label) for r in K.entity_spans(docs, "k", "w", gaz).collect())
    assert got == [(1, 2, 5, "A"), (1, 9, 2, "B")]
    assert K.entity_spans(docs, "k", "w", gaz.limit(0)).count() == 0
