import os
import random

import pytest
from pyspark.sql import functions as F

from wayspring.llm.token_ids import TOKENIZERS, encoder, token_counts, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files")

TEXTS = [
    "", " ", "hello world", "Hello  there\n\n  I'll  don't WE'VE 2024年", "景埠市的西湖，日落很美。", "ราคาไม่แพงเลย 281 บาท", "रास्ता थोड़ा कठिन है", "입장료는 22.3천 원", "é̀ﬁ​\x85x\xa0y　z\x1c\x1d",
    "👨‍👩‍👧‍👦🏮", "<|endoftext|>", "a" * 5000, "ab" * 3000, "漢字かな交じり" * 400, "1234567890" * 300, "\t\t \n \r\n x", "�", "x" * 511 + " " * 700,
]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def lists(enc, texts):
    flat, ends = enc.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_against_the_library_and_round_trip():
    got = lists(encoder(), TEXTS)
    assert got == reference()(TEXTS)
    assert lists(encoder(), TEXTS[::-1]) == got[::-1]


def letters(n, seed, alphabet="etaoinshr"):
    return "".join(random.Random(seed).choices(alphabet, k=n))


LONG = {
    "20,000 letters": letters(20_000, 1), "200,000 letters": letters(200_000, 2), "two letters": letters(30_000, 3, "ab"), "equal letters": "a" * 100_001, "blanks": " " * 70_001 + "x",
    "period": "abc" * 20_001, "a line of 1 MB": " ".join(letters(1 + i % 11, i) for i in range(160_000)), "a line of 1 MB without blanks": letters(1_000_000, 4, "abcdefghijklmnopqrstuvwxyz0123456789"),
    "hex": letters(50_000, 5, "0123456789abcdef"), "thai": letters(20_000, 6, "กขคงจฉชาิีเแ"), "han": letters(40_000, 7, "山水城門東西南北的一是"),
}


@pytest.mark.parametrize("name", LONG)
def test_long_words(name):
    assert lists(encoder(), [LONG[name]]) == reference()([LONG[name]])


def test_slices_and_begun_anew_change_nothing(monkeypatch):
    from wayspring.llm import token_ids as T

    texts = TEXTS + [LONG["20,000 letters"] + " x\n\n y", "one two  three \n four's " * 50]
    monkeypatch.setattr(T, "CHARS_AT_ONCE", 20)
    monkeypatch.setattr(T, "ROWS_AT_ONCE", 1)
    e = T.Encoder(TOKENIZERS, T.NAME)
    assert [lists(e, [t])[0] for t in texts] == reference()(texts)


def test_long_words_in_workers(spark):
    df = spark.createDataFrame([(1, LONG["20,000 letters"]), (2, "a" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in token_ids(df).collect()}
    assert [got[1], got[2]] == reference()([LONG["20,000 letters"], "a" * 100_000])


def test_full_tables_change_nothing(monkeypatch):
    from wayspring.llm import token_ids as T

    monkeypatch.setattr(T, "PIECES_KEPT", 300)
    e = T.Encoder(TOKENIZERS, T.NAME)
    assert [lists(e, [t])[0] for t in TEXTS] == reference()(TEXTS)


def test_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in token_ids(rows).collect()}
    texts = {r.doc_id: r.text or "" for r in rows.select("doc_id", "text").collect()}
    keys = sorted(texts)
    assert [got[k] for k in keys] == reference()([texts[k] for k in keys])


def test_nulls_repeats_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi"), (3, "hi")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(1))
    assert sorted((r.doc_id, list(r.ids)) for r in token_ids(df).collect()) == [(1, []), (2, []), (3, [5303]), (3, [5303])]
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(df).collect()) == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert token_ids(df.where("false")).count() == 0
