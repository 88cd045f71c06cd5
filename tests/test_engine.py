import pytest
from pyspark.sql import functions as F

from wayspring.engine import Engine

COLS = "rid long, id string, city string, title string, content string, keywords array<string>, category string, sub_category string, source string"
LONG = "山路边的糖炒栗子很香，排队的人不少，记得带上零钱和雨伞再去。"


def embedder(calls):
    def run(df):
        calls.append(1)
        x = F.when(F.col("text").contains("西湖"), 1.0).otherwise(0.1)
        return df.select("key", F.array(x.cast("float"), F.lit(0.5).cast("float")).alias("embedding"))

    return run


@pytest.fixture
def parts(spark):
    e = spark.createDataFrame(
        [(1, "j-1", "j", "西湖 日落", "湖边散步", ["西湖"], "景点", None, "a"), (2, "j-2", "j", "古寺 钟声", "早上开门", None, "", "", "a"), (3, "y-1", "y", "西湖 夜市", "晚上热闹", [], "美食", "", None), (4, "y-2", "y", None, None, None, None, None, None)], COLS
    )
    m = spark.createDataFrame([("j", ["金城", "", None]), ("y", None)], "city string, aliases array<string>")
    q = spark.createDataFrame([(1, "西湖日落", "j"), (2, "西湖和古寺哪个更好", "j"), (3, "无关的话题", "z"), (4, None, None)], "query_id long, question string, city string")
    return e, m, q


def ids(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.rid)
    return out


def test_methods_and_degradation(parts):
    e, m, q = parts
    plain = Engine(e, m)
    assert ids(plain.search(q))[1] == [1]
    assert ids(plain.search(q, "hybrid")) == ids(plain.search(q, "no such")) == ids(plain.search(q))
    assert plain.status()["vector"] == "unavailable"
    assert 3 not in ids(plain.search(q, "keyword"))
    full = Engine(e, m, embedder=embedder([]))
    assert ids(full.search(q, "vector"))[1] == [1, 2]
    assert ids(full.search(q, "hybrid"))[1] == [1, 2]
    assert set(ids(full.search(q, "hybrid"))[2]) == {1, 2, 3, 4}
    plain.close()
    full.close()


def test_reranker_reorders_and_keeps_scores(parts):
    e, m, q = parts
    q = q.where("query_id = 1")
    calls = []
    turned = Engine(e, m, embedder=embedder(calls), reranker=lambda question, text: F.when(text.contains("古寺"), 0.9).otherwise(0.1))
    got = turned.search(q, "hybrid", 1).collect()
    plain = {r.rid: r.score for r in Engine(e, m, embedder=embedder([])).search(q, "hybrid").collect()}
    assert [(r.rid, r.score) for r in got] == [(2, plain[2])]


def test_ask_with_and_without_generator(parts):
    e, m, q = parts
    got = {r.query_id: r for r in Engine(e, m).ask(q).collect()}
    assert got[1].answer.startswith("⚠️") and "\n【1】西湖 日落（j）\n" in got[1].answer and got[1].sources == [1]
    assert got[4].answer.startswith("抱歉") and "已覆盖城市：" in got[4].answer and got[4].sources == []
    seen = {r.query_id: r.answer for r in Engine(e, m, generator=lambda p: p).ask(q).collect()}
    assert seen[1].startswith("【参考资料】\n[来源1] 《西湖 日落》(j) - 来源：") and seen[1].endswith("请回答：") and "（暂无相关参考资料）" in seen[4]
    cited = {r.query_id: r.sources for r in Engine(e, m, generator=lambda p: F.lit("见[来源2]")).ask(q.where("query_id = 2")).collect()}
    assert len(cited[2]) == 1


def test_add(spark, parts):
    e, m, _ = parts
    new = spark.createDataFrame(
        [(10, "n-1", "j", "新", LONG, None, "", "", ""), (11, "n-2", "j", "短", "短", None, "", "", ""), (12, "j-1", "j", "异", "完全不同的另一段关于山路和茶园的介绍文字，足够长了吧。", None, "", "", ""), (13, "n-1", "j", "后", "第二个同键条目写的是博物馆的开放时间和门票价格等等。", None, "", "", "")], COLS
    )
    grown, out = Engine(e, m).add(new)
    assert {r.rid: r.outcome for r in out.collect()} == {10: "inserted", 11: "too_short", 12: "known", 13: "known"}
    assert grown.entries.count() == 5
    again, out = grown.add(new.where("rid = 10"))
    assert [r.outcome for r in out.collect()] == ["known"] and again.entries.count() == 5


def test_empty(parts):
    e, m, q = parts
    assert Engine(e.where("false"), m).search(q).count() == 0
    assert Engine(e, m.where("false")).search(q.where("false")).count() == 0
