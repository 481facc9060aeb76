"""BPE by distinct words against the tokenizer itself on whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from claimforge.llm import bpe, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string"
WHOLE = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
TEXTS = [
    "Hello World's  café, 12 times! don't we'LL 'tis o'clock",
    "a\u0085b c　d\x1cq \x00 éé ̈y   ​",
    "<|endoftext|>x <|STARTOFTEXT|> y<|endoftext|>z a<|startoftext|>,b|<|endoftext|>|",
    "日本語テキスト \U0001f600\U0001f600 İSTANBUL ΣΣΣ ﬁne ẞ",
    "x" * 3000 + " " + "ab," * 2000,
    "　 \u0085", " \n\t\r\f\v", "", None, "same words same words SAME Words", "Å Ḅ̇ ċ̣ Ḱ-ḱ",
]


def wanted(text: str | None) -> tuple[bytes, str]:
    ids = WHOLE.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), WHOLE.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("block", [1, 60, bpe.BLOCK])
def test_agrees_with_the_tokenizer(spark, block):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(i, "word " * (i % 9), "en") for i in range(100, 140)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in bpe.decode(bpe.encode(table, block=block, row=min(block, 7)), row=min(block, 7)).collect()}
    assert got == {i: wanted(t) for i, t, _ in rows}


def test_digests(spark):
    got = {r["doc_id"]: r for r in bpe.digests(bpe.decode(bpe.encode(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")))).collect()}
    for i, t in enumerate(TEXTS):
        ids, said = wanted(t)
        assert got[i][1:] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'<|>.,!abcSTLMDRVÉ̈İÅÅ"))))
def test_words_encode_like_whole_texts(text):
    ids = [i for w in bpe._WORD.findall(text) for i in WHOLE.encode(w, add_special_tokens=False).ids]
    assert ids == WHOLE.encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark):
    """Null and repeated ids, ids that are texts, and clashing column names."""
    rows = [("k", "one two"), ("k", "one two"), ("k", "two"), (None, None), (None, "three")]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    table = table.withColumns({c: bpe.F.lit("x") for c in ("block", "doc", "no", "word", "places", "ids", "decoded", "said", "id")})
    got = sorted(((r["doc_id"], r["decoded"]) for r in bpe.decode(bpe.encode(table)).collect()), key=str)
    assert got == sorted(((k, wanted(t)[1]) for k, t in rows), key=str)


def test_empty_table(spark):
    assert bpe.digests(bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA)))).count() == 0


@pytest.mark.parametrize("back", [1, 3, bpe.BACK])
def test_words_of_all_blocks(spark, back):
    said = ["the", "caté,", "x" * 50, "\u0085"]
    rows = [(b, k, w) for b in range(5) for k, w in enumerate(said)]
    out = bpe.encoded_words(spark.createDataFrame(rows, "block long, no int, word string"), back=back).toArrow()
    for b in range(5):
        flat, starts, n = bpe.word_ids(out.filter(bpe.pc.equal(out["of_block"], b)))
        assert [flat[starts[k] : starts[k] + n[k]].tobytes() for k in range(len(said))] == [wanted(w)[0] for w in said]


def test_decoding_alone(spark):
    rows = [(1, np.array([49406, 320, 49407], "<u4").tobytes()), (2, b""), (3, None)]
    got = {r["k"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "k int, ids binary")).collect()}
    assert got == {1: "<|startoftext|> " + WHOLE.id_to_token(320) + " <|endoftext|>", 2: "", 3: ""}


def test_query_over_the_driver_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r[1:] for r in queries.op11_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, said = wanted(r["text"])
        assert got.pop(r["doc_id"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert not got
