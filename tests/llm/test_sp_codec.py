import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from slantspark.llm import queries, sp_codec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return sp_codec.PrefixTableBpe(queries.tokenizer_file("piece_bpe_32k.model"))


def same(codec, library, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    got = codec.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert codec.decode(got) == library.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, library, text):
    same(codec, library, text)


def test_spaces_marks_and_unknown_characters(codec, library):
    rng = random.Random(1)
    letters = "abcdeéß ▁  \n\t中文字ॐ🙂\x00\x01'\".,!ABC123\u00a0aaaabbb"
    for _ in range(1500):
        same(codec, library, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
    for text in ("", " ", "▁", "  x  ", " " * 40 + "x" + " " * 33, "word " * 20_000):
        same(codec, library, text)


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.REGISTRY["op5_piece_codec"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r.doc_id] == expected(library, r.text)


def test_nulls_repeats_and_kept_ids(spark, docs_of, library):
    model = queries.tokenizer_file("piece_bpe_32k.model")
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")]
    docs = docs_of(rows).withColumnRenamed("lang", "n_tokens")
    got = sp_codec.encode_decode(docs, model, keep_ids=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == \
        sorted(((i, *expected(library, t)) for i, t in rows), key=repr)
    assert {r.decoded for r in got} == {"", "a b", "x"}
    assert sp_codec.encode_decode(docs_of([]), model).count() == 0
