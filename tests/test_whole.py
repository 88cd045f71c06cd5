"""Queries of all questions of the history, not of a stride of their ids; the others as before."""

import pytest
from pyspark.sql import functions as F

from wayspring import catalog
from wayspring.operators import blocks as B
from wayspring.operators import retrieval as R
from wayspring.runtime import table

WHOLE = ["bm25_topk", "bm25_and_or", "bm25_okapi", "keyword_topk", "citation_filter", "rrf_fuse", "hybrid_topk", "rerank_pool", "top1_agreement"]
Q, O = catalog.queries(), catalog.oracle_sql()


def ids(df):
    return {r.query_id for r in df.select("query_id").distinct().collect()}


@pytest.mark.parametrize("name", WHOLE)
def test_all_questions_take_part(spark, small, name):
    every, got = ids(table(spark, small, "user_history").select(F.col("id").alias("query_id"))), ids(Q[name](spark, small))
    assert got <= every and len(got) > len(every) // 2  # a few find nothing; a stride has four


@pytest.mark.parametrize("name", WHOLE)
def test_sql_takes_all_questions(name):
    assert "% 50" not in O[name]


def test_questions_of_a_stride_get_what_they_get_among_all(spark, small, monkeypatch):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for query in (R.bm25_topk, R.hybrid_topk):
        monkeypatch.setattr(spark.sparkContext, "_wayspring_tables", {}, raising=False)
        of_stride = rows(query(spark, small, R.QUERY_STRIDE))
        assert of_stride and of_stride == [r for r in rows(query(spark, small, 1)) if r[0] % R.QUERY_STRIDE == 0]


def test_a_task_takes_a_share_of_the_packs(spark, small, monkeypatch):
    about = spark.range(20).select(F.col("id").alias("query_id"), F.lit(1).alias("need"))
    terms = about.select("query_id", F.lit("w").alias("token"), F.lit(1).alias("qtf"), F.lit(1.0).alias("idf"), F.lit(2.0).alias("avgdl"))
    packed = B.pack_questions(terms, about, 2)
    monkeypatch.setattr(B, "TASK_QUESTIONS", 6)
    shares = B._shares(packed)
    assert len(shares) > 3 and sum(len(c["query_id"]) for files in shares for _, c, *_ in B._asked(files)) == 20
    assert B._shares(packed.limit(0)) == [[]]
