"""The packed index against the postings, and what is scored in it against a row per match."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspring.functions.text import STOP_FULLTEXT, STOP_KEYWORD
from wayspring.operators import answers as A
from wayspring.operators import blocks as B
from wayspring.operators import retrieval as R
from wayspring.operators import store as S


@pytest.fixture(autouse=True)
def no_row_per_match(monkeypatch):
    """Queries must not join the questions with the postings row by row."""
    kept = R.bm25_raw, R.index

    def refuse(*_, **__):
        raise AssertionError("a row per match")

    monkeypatch.setattr(R, "bm25_raw", refuse)
    monkeypatch.setattr(R, "index", refuse)
    return kept


@pytest.fixture
def by_rows(spark, small, no_row_per_match):
    """(raw scores in the full-text form and Okapi's, scope, postings) with a row per match."""
    raw, index = no_row_per_match
    post, q = index(spark, small), R.questions(spark, small)
    s = R.scope(q, R.covered(spark, small), R.entries(spark, small))
    return raw(post, R.query_tokens(q, STOP_FULLTEXT)), raw(post, R.query_tokens(q, ()), okapi=True), s, post


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_blocks_hold_the_postings(spark, small, by_rows):
    got = []
    for b in B.blocks(spark, small).collect():
        num = lambda name, kind: np.frombuffer(b[name], kind).tolist()  # noqa: B023, E731
        rids, dl, places, tf = num("rids", np.int64), num("dl", np.int32), num("places", np.uint16), num("tf", np.int32)
        city = [c for c, a, z in zip(b.cities, b.starts, [*b.starts[1:], len(rids)]) for _ in range(a, z)]
        token = [t for t, n in zip(b.tokens, b.df) for _ in range(n)]
        got += [(rids[p], city[p], dl[p], t, n) for p, t, n in zip(places, token, tf)]
    assert sorted(got) == rows(by_rows[3].select("rid", "city", "dl", "token", "tf"))


def test_codes_are_the_tokens(spark):
    texts = ["", "a", "山", "山水", "山水园 b2b 山,c 龟龥", "\x00x\U0001f600é山", "abc山水9"]
    book = B._Codes()
    doc, code = book.of(texts)
    got = [sorted(np.array(book.names(code))[doc == i].tolist()) if (doc == i).any() else [] for i in range(len(texts))]
    want = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.sort_array(R.tokens(F.col("t"))).alias("t")).orderBy("i").collect()
    assert got == [r.t for r in want]


def test_bm25_topk_without_a_row_per_match(spark, small, by_rows, monkeypatch):
    got = rows(R.bm25_topk(spark, small))
    monkeypatch.setattr(R, "bm25_raw", lambda *_: by_rows[0])
    assert got == rows(R.ranked(R.in_scope(R.bm25_scores(None, None), by_rows[2]), positive=True)) and got


def test_bm25_and_or_without_a_row_per_match(spark, small, by_rows):
    full = F.col("matched") == F.col("n_distinct")
    want = by_rows[0].groupBy("query_id").agg(F.count("*").alias("n_any"), F.count(F.when(full, 1)).alias("n_all"))
    assert [r[:3] for r in rows(R.bm25_matches(spark, small))] == rows(want)


def test_okapi_without_a_row_per_match(spark, small, by_rows):
    want = R.ranked(R.in_scope(by_rows[1].select("query_id", "rid", "city", F.col("raw").alias("score")), by_rows[2]), positive=True)
    assert rows(R.bm25_okapi(spark, small)) == rows(want)


def test_keyword_topk_without_a_row_per_match(spark, small, by_rows):
    qt = R.query_tokens(R.questions(spark, small), STOP_KEYWORD)
    hit = by_rows[3].select("rid", "city", "token").join(qt, "token").groupBy("query_id", "rid", "city").agg((F.sum("qtf") / F.first("n_tokens")).alias("score"))
    s = by_rows[2].select("query_id", "city", F.col("has_rows").alias("hard"))
    assert rows(R.keyword_topk(spark, small)) == rows(R.ranked(R.in_scope(hit, s).withColumn("hard", F.lit(True))))


@pytest.mark.parametrize("query", [A.fallback_answer, A.citation_filter, A.prompt_render, A.relevance_filter, S.rrf_fuse])
def test_what_builds_on_the_ranking_has_no_row_per_match(spark, small, monkeypatch, query):
    monkeypatch.setattr(spark.sparkContext, "_wayspring_tables", {}, raising=False)
    assert query(spark, small).count() > 0


def _block(entries):
    """A block of (rid, city, text)."""
    book = B._Codes()
    docs, codes = book.of([t for _, _, t in entries])
    row = B._pack([r for r, _, _ in entries], [c for _, c, _ in entries], docs, codes, book)
    return B._Block(B.pa.RecordBatch.from_pylist([row]), None)


def test_places_with_all_tokens_are_cut_to_a_city_first():
    b = _block([(1, "a", "x y"), (2, "a", "x"), (3, "b", "x y"), (4, "b", "y x y"), (5, "c", "x y")])
    terms = [(b.term(t, 1.0), 1) for t in ("x", "y")]
    assert b.rids[b.with_all(terms, 2)].tolist() == [1, 3, 4, 5]
    assert b.rids[b.with_all(terms, 2, *b.range["b"])].tolist() == [3, 4]
    assert not len(b.with_all(terms, 3, *b.range["b"]))


def test_any_token_is_not_summed_once_all_tokens_were_found(monkeypatch):
    whole, part = _block([(1, "a", "x y"), (2, "a", "x")]), _block([(3, "a", "x")])
    q, kernel = {"query_id": [7], "need": [2]}, B.find_ends(False)
    terms = lambda b: [[(t, 1) for w in ("x", "y") if (t := b.term(w, 1.0))]]
    assert [r.to_pylist()[0]["n_all"] for r in kernel(whole, q, terms(whole))] == [1]
    monkeypatch.setattr(B._Block, "sums", lambda *_: pytest.fail("summed in vain"))
    assert list(kernel(part, q, terms(part))) == []


def test_only_entries_found_are_made_distinct(spark, small):
    plan = A._results(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
