import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave.llm import blocks, bpe, queries


@pytest.fixture(scope="module")
def model():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(), special_tokens={})


@settings(deadline=None, max_examples=300)
@given(st.one_of(st.text(max_size=40), st.text("ab é漢 \n1'", max_size=60)))
def test_words(text):
    ranks = test_words.ranks = getattr(test_words, "ranks", None) or bpe.load()
    own = test_words.model = getattr(test_words, "model", None) or tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    raw = text.encode()
    if raw:
        assert bpe.encode_word(raw, ranks) == own._encode_single_piece(raw)


def test_long_words(model):
    ranks = bpe.load()
    for word in (b"a" * 3_000, b"ab" * 2_000, "漢字".encode() * 700, bytes(random.Random(1).choices(range(256), k=2_000))):
        assert bpe.encode_word(word, ranks) == model._encode_single_piece(word)


def test_numbers_and_strings():
    for numbers in ([], [0], [1, 2**32 - 1, 70_000] * 50):
        assert blocks.stretch(blocks.squeeze(np.array(numbers, np.uint32))).tolist() == numbers
    for parts in ([], [b""], [b"a", b"", b"\n\x00"]):
        assert blocks.stretch_strings(blocks.squeeze_strings(parts)) == parts


@pytest.mark.parametrize("block_tokens", [20, bpe.BLOCK_TOKENS])
def test_odd_rows(odd, nothing, model, block_tokens):
    out = bpe.decode(bpe.encode(odd, block_tokens=block_tokens, shares=7))
    assert out.columns == [*(c for c in odd.columns if c != "text"), "ids", "decoded"]
    got = sorted(((r["slot"], list(r["ids"]), bytes(r["decoded"]), r["row"], r["doc_id"]) for r in out.collect()))
    want = sorted(((r["slot"], model.encode_ordinary(r["text"] or ""), (r["text"] or "").encode(), r["row"], r["doc_id"]) for r in odd.collect()))
    assert got == want
    assert bpe.decode(bpe.encode(nothing)).count() == 0


def test_ids_without_a_token(spark):
    rows = spark.createDataFrame([([0, 1],), (None,), ([10**9],), ([],)], "`my ids` array<int>")
    got = [r[0] for r in bpe.decode(rows, "my ids").select("decoded").collect()]
    assert got[1] is None and got[2] is None and bytes(got[3]) == b"" and got[0] is not None


def test_names_and_own_column(spark, model):
    docs = spark.createDataFrame([(1, "one two", [5], 2)], "`a.b` int, text string, ids array<int>, block int")
    row = bpe.encode(docs).first()
    assert row.asDict() == {"a.b": 1, "block": 2, "ids": model.encode_ordinary("one two")}


def test_no_exchange_of_texts(odd):
    plan = bpe.encode(odd)._jdf.queryExecution().executedPlan().toString()
    assert "share#" in plan and plan.count("Exchange hashpartitioning(block") == 1 and plan.count("Exchange hashpartitioning(share") == 1


def test_query(spark, model):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op13_bpe(spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = model.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_query_keeps_columns(spark):
    got = queries.op13_bpe(spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert got.filter(F.col("n_tokens") < 0).count() == 0
