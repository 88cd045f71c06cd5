import pytest
from pyspark.sql import functions as F

from wayspring.llm.qa_defects import defects, language, length_limits, shortened

FINE = "从折柳灯塔走到墨池塔大约31分钟，光线柔和。"
CASES = [
    ("西湖几点开门？", None, "empty"), ("西湖几点开门？", " ​", "empty"), ("西湖几点开门？", "<p></p>", "empty"), ("西湖几点开门？", "N/A", "empty"), ("西湖几点开门？", "（无）", "empty"),
    ("西湖几点开门？", "……", "empty"), ("西湖几点开门？", "西湖几点开门", "copy"), ("西湖3点开门？", "您的问题是：西湖３点开门？[2]", "copy"), ("西湖几点开门？", "西湖几点开门？西湖几点开门？", "copy"),
    ("西湖几点开门？", "抱歉，我无法回答这个问题。祝您旅途愉快！", "refusal"), ("When?", "Apologies: I have to pass on this one, please ask a human agent.", "refusal"),
    ("Wann öffnet das?", "Es tut mir leid, dabei kann ich nicht helfen.", "refusal"), ("何時に開きますか？", "そのご質問には対応しかねます。", "refusal"),
    ("西湖几点开门？", "The walk from the lake to the tower takes about 30 minutes.", "language"), ("When does the lake open?", FINE, "language"), ("Wann öffnet die Brücke?", "Le bus s'arrête juste devant le pont et la gare.", "language"),
    ("西湖几点开门？", FINE[:-4], "truncated"), ("西湖几点开门？", FINE + "守门人说：“西湖", "truncated"), ("When does the lake open?", "Tickets for the lake cost 9 yuan, i.e.", "truncated"),
    ("When does the lake open?", "The sign said \"Closed.", "truncated"), ("西湖几点开门？", FINE + "停车场离…", "truncated"),
    ("西湖几点开门？", "可以。", None), ("西湖几点开门？", "有的。[1] 😊", None), ("西湖几点开门？", "西湖几点开门？\n" + FINE, None), ("西湖几点开门？", "抱歉让您久等了，" + FINE, None),
    ("西湖几点开门？", "虽然我无法确认实时情况，但资料显示：" + FINE, None), ("请用英文介绍西湖", "The lake is near the tower and it has a bridge.", None),
    ("Please answer in Chinese: what is it like?", FINE, None), ("西湖几点开门？", FINE + "（来源：社区投稿）", None), (None, FINE, None), ("西湖几点开门？", FINE * 400, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, q, a) for i, (q, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:3], "id long, question string, answer string").withColumn("body", F.lit("clash")).withColumn("cut", F.lit(1))
    return {r.id: r.defect for r in defects(df).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(found, n):
    assert found.get(n) == CASES[n][2], CASES[n]


def test_shortened_versions_are_found_across_ranges(spark):
    full = [f"第{i:04d}段：先到桥边，e.g. the old one." for i in range(300)]
    cut = [t[: t.index(" the")] for t in full[::7]]
    got = {r.body for r in shortened(spark.createDataFrame([(x,) for x in full + cut], "body string")).collect()}
    assert got == set(cut)


def test_any_longer_version_counts_not_only_the_next(spark):
    texts = ["Go at 6.", "Go at 6. Bring water.", "Go at 6. Always.", "Go at 6., or later.", "He left at 9.", "He left at 9.\nNew line."]
    assert [r.body for r in shortened(spark.createDataFrame([(x,) for x in texts], "body string")).collect()] == ["Go at 6."]


def test_neighbours_and_limits_decide_what_the_ending_leaves_open(spark, monkeypatch):
    from wayspring.llm import qa_defects as Q

    rows = [(1, "When?", "The lake opens at 6."), (2, "When?", "The lake opens at 6., the bridge at 7 and it is near."), (3, "When?", "The tower opens at 7.")]
    rows += [(100 + i, "When?", "The " + f"{i:04d}" + "y" * 72) for i in range(60)] + [(200 + i, "When?", "The " + f"{i:04d}" + "z" * n) for i, n in enumerate(range(40, 110))]
    rows += [(300, "When?", "The bridge " + "w" * 61 + " is 30 m."), (301, "When?", "The bridge " + "w" * 30 + " is 30 m.")]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    on = {r.id for r in defects(df).collect() if r.defect == "truncated"}
    assert 1 in on and 3 not in on and 301 not in on and len(rows[-2][2]) == 81
    limited = spark.createDataFrame([*rows[:-2], (300, "When?", "The bridge " + "w" * 60 + " is 30 m.")], "id long, question string, answer string")
    assert 300 in {r.id for r in defects(limited).collect()}
    monkeypatch.setattr(Q, "shortened", lambda texts: texts.where("false").select("body"))
    monkeypatch.setattr(Q, "length_limits", lambda texts: texts.where("false").select("n_chars"))
    off = {r.id for r in defects(limited).collect()}
    assert 1 not in off and 300 not in off


def test_repeated_placeholders_are_no_limit(spark):
    rows = [(i, "Is it open?", "n/a") for i in range(200)] + [(500, "Is it open?", "No."), (501, "Is it open?", "Yes.")]
    got = {r.id: r.defect for r in defects(spark.createDataFrame(rows, "id long, question string, answer string")).collect()}
    assert got[0] == "empty" and 500 not in got and 501 not in got


def test_long_answers_without_marks(spark):
    rows = [(1, "几点？", "无法" * 50_000 + "。"), (2, "几点？", "无法" * 50_000 + "回答。"), (3, "When?", "i can't " * 20_000 + "help."), (4, "When?", "kann " * 20_000 + "."), (5, "几点？", "很抱歉，我目前无法就您提出的这个有关票价和开放时间以及交通路线等内容的问题作出任何形式的回答。")]
    got = {r.id: r.defect for r in defects(spark.createDataFrame(rows, "id long, question string, answer string")).collect()}
    assert got[2] == got[3] == got[5] == "refusal" and got.get(1) is None


def test_length_limit_spike(spark):
    rows = [(n, False) for n in range(20, 60)] + [(41, False)] * 80 + [(50, True)] * 200
    assert [r[0] for r in length_limits(spark.createDataFrame(rows, "n_chars int, closed boolean")).collect()] == [41]


def test_language_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), ("123",), ("입장료는 얼마입니까",)], "t string")
    assert [r[0] for r in df.select(language(F.col("t"))).collect()] == [None, None, None, "ko"]


def test_empty(spark):
    assert defects(spark.createDataFrame([], "id long, question string, answer string")).count() == 0
