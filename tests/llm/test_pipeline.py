import hashlib

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
import public_tokenizers
from slantspark.llm import toxicity
from slantspark.llm.common import cut_lineage, table
from test_minhash import brute as minhash_brute
from test_winnow import brute as winnow_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut_lineage(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "piece_encoding"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_each_stage_equals_its_brute_force_version(spark, stages):
    _, before, after = stages[0]
    model = toxicity.train(before, table(spark, SF, "labels"))
    assert set(texts(after)) == {r.doc_id for r in toxicity.score(before, model).collect() if r.score < 0.5}
    _, before, after = stages[1]
    want, _ = minhash_brute(sorted(texts(before).items()), 5, 80)
    assert set(texts(after)) == {i for i, (_, _, kept) in want.items() if kept}
    _, before, after = stages[2]
    old, new = texts(before), texts(after)
    seen = {}
    for d in sorted(old):
        w = old[d].encode().lower().split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i:i + 50]), set()).add(d)
    repeated = {d for ids in seen.values() if len(ids) > 1 for d in ids if d != min(ids)}
    assert set(old) == set(new) and repeated <= {d for d in old if old[d] != new[d]}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    left = {}
    for d in new:
        w = new[d].encode().lower().split()
        for i in range(len(w) - 49):
            left.setdefault(tuple(w[i:i + 50]), set()).add(d)
    assert not any(len(ids) > 1 for ids in left.values())
    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert set(texts(after)) == {r[0] for r in winnow_brute(list(texts(before).items()), items) if not r[5]}
    _, before, after = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    old = texts(before)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in after.collect()}
    assert set(got) == set(old)
    for d, t in old.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_stages_take_nulls_shared_ids_clashing_columns_and_empty_tables(spark):
    """Stages 2 to 5 on odd rows: every row is a text of its own, columns stay as they are."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(90))
    leak = next(r.text for r in table(spark, SF, "benchmark").orderBy("item_id").collect() if len(r.text.split()) > 12)
    rows = [(1, a), (5, a), (5, b), (7, "start " + " ".join(b.split()[:70])), (None, None), (None, "no id"), (8, ""), (9, None), (10, "see " + leak)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, span_id int, repeat_spans int, dropped_id int, bad_key int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        after = cut_lineage(stage(spark, docs, SF), name)
        assert after.dtypes == docs.dtypes
        docs = after
        assert stage(spark, docs.where("false"), SF).count() == 0
    left = sorted(((r.doc_id, " ".join((r.text or "").split())) for r in docs.collect()), key=repr)
    assert (5, b) in left and (7, "start") in left and (1, a) in left and (None, "no id") in left
    assert not any(leak in t for _, t in left)
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == len(left)


def test_repeated_passages_cuts_near_repeats_behind_other_documents(spark, docs_of):
    """Documents with parts of a passage stand before and between its first place and its copy with one word changed."""
    rng = np.random.default_rng(63)
    fill = lambda n: [f"p{k}" for k in rng.integers(0, 100_000, n)]
    rows = {}
    for base in range(0, 300, 20):
        passage = fill(90)
        for d in (*range(6), *range(7, 13)):
            rows[base + d] = " ".join(w for k in rng.integers(0, 60, 3) for w in fill(20) + passage[k: k + 30])
        rows[base + 6] = " ".join(fill(30) + passage)
        rows[base + 13] = " ".join(fill(30) + passage[:45] + ["other"] + passage[46:])
    after = corpus_pipeline.repeated_passages(spark, docs_of(rows), SF).collect()
    cut = {r.doc_id: r for r in after if r.text != rows[r.doc_id]}
    assert set(cut) == set(range(13, 300, 20))
    assert all(r.text.split() == rows[d].split()[:30] and r.n_chars == len(r.text) for d, r in cut.items())
