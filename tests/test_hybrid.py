"""The hybrid channel and what is built on it, against plain Python over all pairs."""

import os

import pytest

from wayspring.functions.text import STOP_FULLTEXT
from wayspring.operators import retrieval as R


@pytest.fixture(scope="module")
def medium():
    """The smallest tables with questions that have no hard scope."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no driver tables")
    return path


@pytest.fixture(scope="module")
def pairs(spark, medium):
    """Every question with every entry in scope, nothing cut: {query_id: (hard, fused
    order)}, {query_id: (city, {rid: cosine})}, {rid: city}."""
    e, q = R.entries(spark, medium), R.questions(spark, medium)
    city = {r.rid: r.city for r in e.select("rid", "city").collect()}
    post = R.index(spark, medium)
    lex, dv, qv = {}, {}, {}
    for r in R.bm25_scores(post, R.query_tokens(q, STOP_FULLTEXT)).collect():
        lex[r.query_id, r.rid] = round(r.score, 4)
    for r in R.hashed_vector(post.selectExpr("rid", "token", "tf as n"), "rid").collect():
        dv.setdefault(r.rid, {})[r.dim] = r.w
    for r in R.hashed_vector(R.query_tokens(q, ()).selectExpr("query_id", "token", "qtf as n"), "query_id").collect():
        qv.setdefault(r.query_id, {})[r.dim] = r.w
    out, cos = {}, {}
    for s in R.scope(q, R.covered(spark, medium), e).collect():
        rids = sorted(rid for rid in city if not s.hard or city[rid] == s.city)
        a = {rid: lex.get((s.query_id, rid), 0.0) for rid in rids}
        raw = {rid: sum(w * dv.get(rid, {}).get(d, 0.0) for d, w in qv.get(s.query_id, {}).items()) for rid in rids}
        b = {rid: round(x, 4) for rid, x in raw.items()}
        cos[s.query_id] = s.city, raw
        r1, r2 = ({rid: n for n, rid in enumerate(sorted(rids, key=lambda rid: (-c[rid], rid)), 1)} for c in (a, b))
        out[s.query_id] = s.hard, sorted((-round(1 / (R.RRF_K + r1[rid]) + 1 / (R.RRF_K + r2[rid]), 6), rid) for rid in rids)
    return out, cos, city


@pytest.fixture(scope="module")
def fused(pairs):
    return pairs[0]


def by_question(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.rid)
    return out


def test_rerank_sees_the_whole_recall_pool(spark, medium, fused):
    n = {r.rid: len(r.content or "") for r in R.entries(spark, medium).select("rid", "content").collect()}
    got, beyond = by_question(R.rerank_shorter(spark, medium)), 0
    for q, (hard, order) in fused.items():
        pool = [rid for _, rid in order[: R.RECALL]]
        assert got[q] == sorted(pool, key=lambda rid: (n[rid], rid))[: R.TOP_K]
        beyond += hard and bool(set(got[q]) - set(pool[: R.TOP_K]))
    assert beyond


def test_questions_without_a_hard_scope_rank_all_entries(spark, medium, fused, monkeypatch):
    monkeypatch.setattr(R, "PACK", 512)  # several blocks
    got, open_ = by_question(R.hybrid_topk(spark, medium)), 0
    assert set(got) == set(fused)
    for q, (hard, order) in fused.items():
        assert got[q] == [rid for _, rid in order[: R.TOP_K]]
        open_ += not hard
    assert open_


def test_open_ranks_are_those_of_all_pairs(spark):
    import random

    rnd = random.Random(7)
    rids = sorted(rnd.sample(range(20000), 400))
    e = spark.createDataFrame([(r,) for r in rids], "rid long")
    so = spark.createDataFrame([(q,) for q in (50, 100, 204850)], "query_id long")
    vec = lambda k: [(k, d, rnd.choice((0.1, 0.2, 0.3))) for d in rnd.sample(range(R.DIMS), 6)]
    qs, ds = [x for q in (50, 204850) for x in vec(q)], [x for r in rids[3:] for x in vec(r)]
    lx = [(50, r, rnd.choice((0.25, 0.5, 1.0))) for r in rnd.sample(rids, 12)] + [(100, r, 0.5) for r in rnd.sample(rids, 300)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, dim int, w double")
    got = R._open_ranks(so, e, spark.createDataFrame(lx, "query_id long, rid long, bm25_score double"), frame(qs, "query_id"), frame(ds, "rid"), 20).collect()
    lex, qv, dv = {(q, r): x for q, r, x in lx}, {}, {}
    for k, d, w in qs:
        qv.setdefault(k, {})[d] = w
    for k, d, w in ds:
        dv.setdefault(k, {})[d] = w
    for q in (50, 100, 204850):
        a = {r: lex.get((q, r), 0.0) for r in rids}
        b = {r: round(sum(w * dv.get(r, {}).get(d, 0.0) for d, w in qv.get(q, {}).items()), 4) for r in rids}
        r1, r2 = ({r: n for n, r in enumerate(sorted(rids, key=lambda r: (-c[r], r)), 1)} for c in (a, b))
        own = {x.rid: x for x in got if x.query_id == q}
        assert {r for r in rids if r1[r] <= 20 or r2[r] <= 20} <= set(own)
        for r, x in own.items():
            assert (x.bm25_score, round(x.vector_score, 4), x.r1, x.r2) == (a[r], b[r], r1[r], r2[r])


def test_compare_runs_the_vector_method(spark, medium, pairs, monkeypatch):
    monkeypatch.setattr(R, "PACK", 512)
    (out, cos, city), got = pairs, by_question(R.search(spark, medium, "vector"))
    assert set(got) == set(out)
    for q, (own, raw) in cos.items():
        weight = lambda rid: 1.0 if out[q][0] or own is None else R.BOOST if city[rid] == own else R.DAMP  # noqa: B023, E731
        score = {rid: round(round(x * weight(rid), 9), 4) for rid, x in raw.items()}
        assert got[q] == sorted(score, key=lambda rid: (-score[rid], rid))[: R.TOP_K]  # noqa: B023
    m = R.compare_matrix(spark, medium)
    assert [c for c in m.columns if c.startswith("rank_")] == ["rank_keyword", "rank_bm25", "rank_vector", "rank_hybrid"]
