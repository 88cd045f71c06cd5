"""Near-duplicates by cells of a city, against the form with a row per pair."""

import pytest
from pyspark.sql import functions as F

from wayspring.operators import blocks as B
from wayspring.operators import quality as Q
from wayspring.operators import store as S
from wayspring.operators.retrieval import entries


@pytest.fixture(autouse=True)
def no_row_per_pair(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a row per pair")

    kept = Q.similar_entries
    monkeypatch.setattr(Q, "similar_entries", refuse)
    return kept


@pytest.mark.parametrize("cell", [16, 16_384])
def test_near_dup_without_a_row_per_pair(spark, small, no_row_per_pair, monkeypatch, cell):
    monkeypatch.setattr(B, "CELL", cell)
    monkeypatch.setattr(B, "SUBMISSIONS", cell)
    toks = Q.content_tokens(F.col("title"), F.col("content")).alias("toks")
    own = F.filter(F.array(Q.key(F.col("id")), Q.key(F.col("submission_id"))), lambda k: k.isNotNull()).alias("own")
    want = no_row_per_pair(Q._submissions(spark, small).select("id", "city", toks), entries(spark, small).select("rid", "city", toks, own))
    assert sorted(map(tuple, Q.near_dup(spark, small).collect())) == sorted(map(tuple, want.collect()))


def test_repeats_by_hand(spark):
    new = [("a", "a", "x", "山水 园林 go"), ("b", "b", "x", "山水 园林"), ("c", "c", "x", "我们 a 山"), ("d", "d", None, "山水"), ("e", "e", "x", "山水")]
    old = [(7, ["a"], "x", "山水 园林 go"), (3, [], "x", "山水 园林 to"), (2, [], "y", "山水"), (5, [], "x", ""), (9, [], None, "山水"), (4, [], "x", "山水 一个")]
    got = B.repeats(spark.createDataFrame(new, "id string, own_key string, city string, text string"), spark.createDataFrame(old, "rid long, own array<string>, city string, text string"), 0.6, ("我们", "一个"))
    assert sorted(map(tuple, got.collect())) == [("a", 4, 1.0), ("b", 3, 1.0), ("e", 3, 1.0)]


def test_append_pipeline_without_a_row_per_pair(spark, small):
    df = S.append_pipeline(spark, small)
    assert "applyInArrow" not in df._jdf.queryExecution().optimizedPlan().toString() and "CoGroup" not in df._jdf.queryExecution().optimizedPlan().toString()  # near-duplicates are sought once
    got = {r.outcome: r.n for r in df.collect()}
    assert got["duplicate"] <= Q.near_dup(spark, small).count() and sum(got.values()) == Q._submissions(spark, small).count()


def test_review_outcomes_without_a_row_per_pair(spark, small):
    got = {(r.status, r.reason): r.n for r in Q.review_outcomes(spark, small).collect()}
    assert got["rejected", "duplicate"] <= Q.near_dup(spark, small).count() and sum(got.values()) == Q._submissions(spark, small).count()
