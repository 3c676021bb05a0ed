"""The text model's passes over rows that stay in place."""
import re
from collections import Counter

import numpy as np
import pytest

from slantspark.operators import table_logistic as TL
from slantspark.operators import textclf as TC

ROWS = [(n, (["even", "all"] if n % 2 == 0 else ["odd", "all", "odd"]) + [f"w{n % 7}"] * (n % 3), n % 3) for n in range(60)] + [(60, [], 1), (61, None, 0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_pass_moves_sums_of_words_only(spark, monkeypatch):
    """Packed rows, margins and residuals are joined where they lie: the only exchanges are those of the (block, word) sums."""
    monkeypatch.setattr(TL, "BLOCK_ENTRIES", 40)
    table = spark.createDataFrame(ROWS, "_row long, words array<string>, label int")
    vocab = TC.idf_vocabulary(table)
    fit = TL.Fit(TL.encode(table, vocab, 3), vocab, 0.01)
    blocks = fit.blocks.data.select("block").collect()
    assert len(blocks) == fit.blocks.parts > 3 and len(set(blocks)) == len(blocks)
    monkeypatch.setattr(TL, "BLOCK_ENTRIES", 1 << 22)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)               # as for large tables
    try:
        text = plan(fit.next_state(fit.kept[0][0], np.array([1.0, 0.0]), np.eye(3)[:2]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", text)) == ["asker", "shard"] and "Broadcast" not in text


def test_inner_products_follow_from_the_rows(spark):
    """The driver's products of gradients and steps equal those of the vectors themselves, word by word."""
    table = spark.createDataFrame(ROWS, "_row long, words array<string>, label int")
    vocab = TC.idf_vocabulary(table)
    fit = TL.Fit(TL.encode(table, vocab, 3), vocab, 0.01)
    fit.minimise(3, 0.0)
    free, bias, loss = fit.free, fit.bias, fit.loss
    found = {r["id"]: np.array(r["w"]) for r in fit.coefficients().collect()}
    w = np.array([v for i, v in found.items() if i != TL.BIAS])
    assert len(w) == vocab.count() and (w * w).sum() == pytest.approx(free[0, 0], rel=1e-9)
    assert found[TL.BIAS][:2] == pytest.approx(bias[0]) and 0 < loss < np.log(3)


def test_word_counts_of_rows(spark):
    rows = ROWS + [(62, ["x", None, "x"], 0)]
    got = {(r["_row"], r["word"]): r["tf"] for r in TL.word_counts(spark.createDataFrame(rows, "_row long, words array<string>, label int")).collect()}
    assert got == {(n, w): c for n, ws, _ in rows for w, c in Counter(x for x in ws or [] if x is not None).items()}
    assert "Exchange" not in plan(TL.word_counts(spark.createDataFrame(rows, "_row long, words array<string>, label int")))
