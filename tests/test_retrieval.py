import pytest
from pyspark.sql import functions as F

from wayspring.functions.text import category, keywords, slug, tokens
from wayspring.operators import retrieval as R
from wayspring.operators.corpus import insert_ignore, page, upsert
from wayspring.operators.quality import entry_chunks, similar_entries


def test_tokens(spark):
    df = spark.createDataFrame([("西湖边 Cafe 12",), ("山",), (None,), ("",), ("，。",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["西湖", "湖边", "cafe", "12"], ["山"], [], [], []]


def test_category_keywords_slug(spark):
    df = spark.createDataFrame([("夜里吃火锅", None), (None, "坐地铁去故宫"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(category(F.col("a"), F.col("b"))).collect()] == ["美食", "交通", "其他"]
    assert df.select(keywords(F.lit("西湖西湖 的 a bc"))).first()[0] == ["西湖", "湖西", "bc"]
    assert df.select(slug(F.lit(" A-b 西湖! "))).first()[0] == "a_b_西湖"


def corpus(spark):
    return spark.createDataFrame(
        [(1, "j", "西湖 日落", "a", []), (2, "j", "古寺 钟声", "a", []), (3, "y", "西湖 夜市 西湖", "b", ["西湖"]), (4, "y", None, None, None)],
        "rid long, city string, title string, content string, keywords array<string>",
    ).withColumns({"category": F.lit(""), "sub_category": F.lit(None).cast("string")})


def test_bm25_all_tokens_first_then_any(spark):
    e = corpus(spark)
    q = spark.createDataFrame([(1, "西湖 夜市"), (2, "西湖 钟声"), (3, "无关"), (4, None), (5, "")], "query_id long, question string")
    got = R.bm25_scores(R.postings(e), R.query_tokens(q, ())).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rid] = round(r.score, 6)
    assert by[1] == {3: 1.0}
    assert set(by[2]) == {1, 2, 3} and min(by[2].values()) == 0.0
    assert 3 not in by and 4 not in by and 5 not in by


def test_bm25_formula(spark):
    import math

    e = corpus(spark)
    post = R.postings(e)
    raw = {(r.query_id, r.rid): r.raw for r in R.bm25_raw(post, R.query_tokens(spark.createDataFrame([(1, "钟声 钟声")], "query_id long, question string"), ())).collect()}
    docs = {r.rid: r.dl for r in post.select("rid", "dl").distinct().collect()}
    avg = sum(docs.values()) / len(docs)
    idf = math.log((len(docs) - 1 + 0.5) / 1.5)
    want = 2 * max(idf, 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * docs[2] / avg))
    assert raw[1, 2] == pytest.approx(want)


def test_rrf_order(spark):
    a = spark.createDataFrame([(1, d, r) for r, d in enumerate([0, 1, 2], 1)], "query_id long, rid long, rank int")
    b = spark.createDataFrame([(1, d, r) for r, d in enumerate([1, 2, 3], 1)], "query_id long, rid long, rank int")
    got = [r.rid for r in R.rrf([a, b]).orderBy(F.col("rrf").desc(), "rid").collect()]
    assert got == [1, 2, 0, 3]
    assert [r.rid for r in R.rrf([b, a]).orderBy(F.col("rrf").desc(), "rid").collect()] == got


def test_boost_damp_and_hard(spark):
    s = spark.createDataFrame([(1, 1, "j", 0.4, "y", False), (1, 3, "y", 0.2, "y", False), (2, 1, "j", 0.4, "j", True), (3, 1, "j", 0.4, None, False)], "query_id long, rid long, city string, score double, q_city string, hard boolean")
    got = {(r.query_id, r.rid): (r.rank, r.score) for r in R.ranked(s).collect()}
    assert got == {(1, 3): (1, 0.3), (1, 1): (2, 0.2), (2, 1): (1, 0.4), (3, 1): (1, 0.4)}


def test_scope_rules(spark):
    e = corpus(spark)
    names = spark.createDataFrame([("j", "j"), ("j", "金城"), ("y", "y"), ("y", "玉城"), ("z", "z")], "city string, name string")
    q = spark.createDataFrame([(1, "金城去哪", "j"), (2, "金城和玉城去哪", "j"), (3, "哪个更好玩", "j"), (4, "去哪", "z"), (5, "去哪", None), (6, None, "j")], "query_id long, question string, city string")
    got = {r.query_id: r.hard for r in R.scope(q, names, e).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_vectors_ties_nulls_and_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in R.vector_topk(v.where("vec_id = 2"), v, k=2).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0)]
    assert R.vector_topk(v.where("false"), v).count() == 0
    assert R.vector_topk(v.where("vec_id = 2"), v.where("false")).count() == 0


def test_vectors_match_brute_force(spark, small):
    import numpy as np

    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    m = np.array([list(r.embedding) for r in rows], dtype=float)
    got = {}
    for r in R.vector_query(spark, small).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for qid in list(got)[:5]:
        s = np.round(m @ m[ids == qid][0], 4)
        assert sorted(got[qid]) == sorted(ids[np.lexsort((ids, -s))][:5].tolist())


def test_insert_ignore_is_idempotent_and_keeps_the_first(spark):
    old = spark.createDataFrame([(1, "a")], "rid long, id string")
    new = spark.createDataFrame([(5, "b"), (4, "b"), (6, "a")], "rid long, id string").withColumn("n", F.lit("x"))
    add = insert_ignore(new, old, ["id"], "rid")
    assert [(r.rid, r.id) for r in add.collect()] == [(4, "b")]
    assert insert_ignore(new, old.unionByName(add.select("rid", "id")), ["id"], "rid").count() == 0


def test_upsert_and_page(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    got = upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r.k for r in page(got, 2, 2, ["k"]).collect()] == ["c"]
    assert page(got, 9, 2, ["k"]).count() == 0


def test_entry_chunks():
    s = "今天去看了很多地方。"
    assert entry_chunks("短") == ["短"]
    assert len(entry_chunks(s * 60 + "\n\n" + s * 60)) == 2
    many = entry_chunks(s * 120)
    assert len(many) >= 2 and all(len(c) <= 800 * 1.5 for c in many)
    assert len(entry_chunks(s * 75 + "\n完。" + "\n" + "x" * 60)) == 1
    hard = entry_chunks("x" * 2000)
    assert "".join("".join(hard).split()) == "x" * 2000
    for t in (s * 120, "a b. " * 500, "\n" * 900 + s * 90):
        assert "".join("".join(entry_chunks(t)).split()) == "".join(t.split())


def test_similar_entries_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    word = lambda: f"w{rnd.randint(0, 30)}"
    new = [(f"n{i}", rnd.choice("ab"), sorted({word() for _ in range(rnd.randint(0, 9))})) for i in range(60)]
    old = [(i, rnd.choice("ab"), sorted({word() for _ in range(rnd.randint(0, 12))})) for i in range(60)]
    got = {r.id: (r.rid, r.overlap) for r in similar_entries(spark.createDataFrame(new, "id string, city string, toks array<string>"), spark.createDataFrame(old, "rid long, city string, toks array<string>")).collect()}
    want = {}
    for i, c, x in new:
        best = [(-round(len({*x} & {*y}) / min(len(x), len(y)), 6), r) for r, d, y in old if c == d and x and y]
        if best and -min(best)[0] >= 0.6:
            want[i] = (min(best)[1], -min(best)[0])
    assert got == want and want
