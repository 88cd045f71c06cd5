"""Both channels scored in blocks: no row per match or pair, and the ranks of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayspring.operators import answers as A
from wayspring.operators import blocks as B
from wayspring.operators import retrieval as R
from wayspring.operators import store as S


@pytest.fixture
def no_row_per_match(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a row per match or pair")

    for name in ("bm25_raw", "index", "postings", "in_scope"):
        monkeypatch.setattr(R, name, refuse)


@pytest.mark.parametrize("query", [R.hybrid_topk, R.rerank_shorter, R.text_vector_topk, R.compare_matrix, R.top1_agreement])
def test_no_row_per_match_or_pair(spark, small, no_row_per_match, query):
    assert query(spark, small).count() > 0


@pytest.mark.parametrize("packs", [2, 4096])
def test_packs_of_questions_change_nothing(spark, small, monkeypatch, packs):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = [rows(q(spark, small)) for q in (R.bm25_okapi, R.keyword_topk, R.bm25_matches, R.hybrid_topk)]
    monkeypatch.setattr(B, "PACK_QUESTIONS", packs)
    monkeypatch.setattr(spark.sparkContext, "_wayspring_tables", {}, raising=False)
    assert [rows(q(spark, small)) for q in (R.bm25_okapi, R.keyword_topk, R.bm25_matches, R.hybrid_topk)] == want


def test_a_city_lies_in_few_blocks(spark):
    """Questions with a hard scope then pass over the other blocks."""
    import tempfile

    where = tempfile.mkdtemp()
    rows = [(i, f"c{i % 40}", f"t{i}", "x y", None, None, None) for i in range(4000)]
    spark.createDataFrame(rows, "rid long, city string, title string, content string, keywords array<string>, category string, sub_category string").write.parquet(f"{where}/knowledge_entries.parquet")
    b = B.blocks(spark, where)
    assert b.count() == 4
    assert b.select(F.explode("cities").alias("c")).groupBy("c").count().agg(F.sum("count")).first()[0] <= 40 + 3
    assert b.agg(F.sum("n")).first()[0] == 4000


def _column(x: list) -> dict:
    return {k: [r[k] for r in x] for k in x[0]}


def test_ranks_are_those_of_all_pairs():
    """Blocks over two tasks, ties, entries without vector or match, both kinds of scope."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    text = {rid: " ".join(rnd.choices(words, k=rnd.choice((0, 1, 2, 3)))) for rid in rnd.sample(range(10_000), 300)}
    city = {rid: rnd.choice("abc") for rid in text}
    rids = list(text)
    asked = [{"query_id": i, "city": rnd.choice(["a", "b", None]), "said": rnd.choices(words, k=i % 4)} for i in range(24)]
    for q in asked:
        q |= {"hard": q["city"] is not None and rnd.random() < 0.7, "all_terms": False, "need": len(set(q["said"])), "lo": 0.0, "hi": 3.0}
    tokens = [q["said"] for q in asked]
    depth, pool, k = 14, 4, 6  # depth is k + 2 * pool

    def tasks(kernel, qs: list):
        for part in (rids[:150], rids[150:]):
            one, told = kernel(), []
            q = _column(qs) | {"said": [B.dims(tokens[x["query_id"]]) for x in qs]}
            for at in (part[:80], part[80:]):
                book = B._Codes()
                docs, codes = book.of([text[r] for r in at])
                block = B._Block(pa.RecordBatch.from_pylist([B._pack(at, [city[r] for r in at], docs, codes, book)]), None)
                assert not list(one(block, q, [[(t, 1) for w in sorted(set(tokens[x["query_id"]])) if (t := block.term(w, 1.0))] for x in qs]))
            told += one.rest()
            yield from told

    found = B.pa.Table.from_batches(list(tasks(lambda: B.find_both(depth, 1), asked)))
    got = B.fuse(depth, pool, k)(found).to_pylist()
    open_ = []
    for q in asked:
        own = [r for r in got if r["query_id"] == q["query_id"] and None in (r["r1"], r["r2"])]
        if own:
            open_.append(q | {"rids": np.array([r["rid"] for r in own]), "bs": np.array([r["b"] for r in own], np.int32), "vs": np.array([r["v"] for r in own], np.int32), "lexical": True, "dense": True})
    assert open_
    ahead: dict = {}
    for t in tasks(B.count_ahead, open_):
        for r in t.to_pylist():
            x = ahead.setdefault((r["query_id"], r["rid"]), [1, 1])
            x[0], x[1] = x[0] + r["ahead1"], x[1] + r["ahead2"]

    vec = dict(zip(rids, B._vectors([B.dims(text[r].split()) for r in rids])))
    for q, v in zip(asked, B._vectors([B.dims(t) for t in tokens])):
        mine = [r for r in rids if not q["hard"] or city[r] == q["city"]]
        lex = {r: int(np.floor(len(set(text[r].split()) & set(tokens[q["query_id"]])) / 3 * 1e4 + 0.5)) for r in mine}
        cos = {r: int(B._quantised(vec[r] @ v)) for r in mine}
        r1, r2 = ({r: n for n, r in enumerate(sorted(mine, key=lambda r: (-c[r], r)), 1)} for c in (lex, cos))  # noqa: B023
        best = sorted(mine, key=lambda r: (-(1 / (k + r1[r]) + 1 / (k + r2[r])), r))[:pool]  # noqa: B023
        rows = {r["rid"]: r for r in got if r["query_id"] == q["query_id"]}
        assert set(best) <= set(rows)
        for rid, r in rows.items():
            p1, p2 = ahead.get((q["query_id"], rid), (None, None))
            assert (r["b"], r["v"], r["r1"] or p1, r["r2"] or p2) == (lex[rid], cos[rid], r1[rid], r2[rid])


@pytest.mark.parametrize("query", [A.citation_filter, A.prompt_render, A.relevance_filter, S.rrf_fuse])
def test_ends_are_sought_once_per_version(spark, small, monkeypatch, query):
    """The least and greatest scores are shared by all that ranks by them."""
    monkeypatch.setattr(spark.sparkContext, "_wayspring_tables", {}, raising=False)
    R.hybrid_topk(spark, small).count()
    monkeypatch.setattr(R, "find_ends", lambda *_: pytest.fail("sought again"))
    assert query(spark, small).count() > 0
