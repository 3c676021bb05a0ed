import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from slantspark.llm import queries, token_output

SF = "/root/testdata/sf0.001"
ODD = ["", "a  b", " x", "a \n b  ", "  ", "\n\n x ' s don't  'll  q", "x  y \u0085 z", "\t \t a", "a\x1c b", "<|endoftext|> a", "é ü  ß", "a \u3000b \u2028 c \u00a0", "x \u202f"]


@pytest.fixture(scope="module")
def definition():
    return queries.tokenizer_file("byte_bpe_50k.json")


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_cached_pieces_equal_whole_encoding(definition):
    coder = token_output.ByteBpe(definition, 2, "<u2")
    for _ in range(2):
        for texts in (ODD, ODD[:1], []):
            got = coder.encode(pa.array(texts, pa.string())).to_pylist()
            want = [np.array(e.ids + [2], "<u2").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert got == want


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.REGISTRY["op10_token_files"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_nulls_ties_long_texts_and_extra_columns(spark, docs_of, definition):
    rows = [(i * 3 - 9, t) for i, t in enumerate(ODD)] + [(None, "null id"), (40, None), (41, "long " * 30_000)]
    docs = docs_of(rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "start")
    got = token_output.token_output(docs, definition, 2, 50_257).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_repeated_ids_keep_all_rows(spark, docs_of, definition):
    got = token_output.token_output(docs_of([(1, "a b"), (1, "a b"), (1, "c")]), definition, 2, 50_257).collect()
    assert sorted(map(tuple, got))[0][1] == 0 and len(got) == 3 and all(r.doc_id == 1 for r in got)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered[1:]] == [ordered[0].n_tokens, ordered[0].n_tokens + ordered[1].n_tokens]


def test_empty_table(spark, docs_of, definition):
    assert token_output.token_output(docs_of([]), definition, 2, 50_257).count() == 0


def test_query_gives_special_tokens_their_id(spark, docs_of, tmp_path):
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|><|endoftext|> y", "plain words", *ODD]
    docs_of(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.REGISTRY["op10_token_files"](spark, str(tmp_path)).collect()}
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, text in enumerate(texts):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_files_follow_the_ids(spark, docs_of, definition, tmp_path):
    """Part files in the order of their names, and the blocks of each, hold the documents in ascending id order."""
    rows = [((i * 7919) % 1000 - 300, f"text {i} " * (i % 9)) for i in range(1000)] + [(None, "no id")] + [(55, "again")] * 300
    token_output.write_token_files(docs_of(rows).repartition(6), str(tmp_path / "out"), definition, 2, 50_257)
    files = sorted(glob.glob(str(tmp_path / "out" / "part-*.parquet")))
    blocks = [b for f in files for b in pq.read_table(f).to_pylist()]
    assert len(files) > 2 and sum(b["n_null"] for b in blocks) == 1 and blocks[0]["n_null"] == 1
    ids = [d for b in blocks for d in np.frombuffer(b["doc_ids"], "<i8")[b["n_null"]:].tolist()]
    assert ids == sorted(i for i, _ in rows if i is not None)
    assert [(b["shard"], b["block"]) for b in blocks] == sorted((b["shard"], b["block"]) for b in blocks)
