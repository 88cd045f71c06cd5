import random

import pytest
from pyspark.sql import functions as F

from wayspring.llm.han import tables
from wayspring.llm.history_dedup import History, statements

S = "rid long, content string, batch_no int"
A = [f"从第{i}号码头走到北桥大约{i + 20}分钟，讲解很细。" for i in range(60)]


def frame(spark, rows):
    return spark.createDataFrame(rows, S).withColumn("key", F.lit("clash")).withColumn("h", F.lit(0)).withColumn("class", F.lit("x"))


def pairs(history, df):
    return sorted((int(r.key), int(r.stored)) for r in history.match(df, "rid").collect())


def test_normal_form(spark):
    df = spark.createDataFrame([("半天足够，推荐带伞，差不多12.5公里。",), ("<p>半日足夠，建议带伞，大约１２.５公里</p>".replace("夠", "够"),), ("半天足够，推荐带伞，差不多13.5公里。",), (None,), ("！",)], "t string")
    h = [r[0] for r in df.select(statements(F.col("t"), tables(spark))).collect()]
    assert h[0] == h[1] != h[2] and h[3] == h[4] == []


def test_short_statements_whole_copies_and_titles(spark):
    short = "好吃。不贵。人少。下次还来。"
    h = History(spark)
    h.append(spark.createDataFrame([(1, None, short, 0), (2, "从北桥到南门走路大约十分钟。", A[0] + A[1] + A[2], 0), (3, "x", "一二三，四五六", 0), (4, A[40], None, 0)], "rid long, title string, content string, batch_no int"), title="title")
    new = [
        (10, short, 1), (11, "好吃！不贵！\n人少！下次还来", 1), (12, "好吃。很贵。人多。再也不来。", 1), (13, "从北桥到南门走路大约十分钟\n" + A[0] + A[1] + A[20] + A[21], 1),
        (14, A[0] + A[20] + "从北桥到南门走路大约十分钟", 1), (15, "一二三。四五六！", 1), (16, A[40], 1), (17, A[0] + A[1] + A[20] + A[21], 1),
    ]
    assert pairs(h, frame(spark, new)) == [(10, 1), (11, 1), (13, 2), (15, 3), (16, 4)]
    h.drop()


def test_a_small_batch_reads_no_text_and_no_aggregate_of_history(spark):
    h = History(spark)
    h.append(frame(spark, [(i, A[i % 50] + A[(i + 7) % 50], 0) for i in range(300)]))
    found = h.match(frame(spark, [(1, A[0] + A[7], 1)]), "rid")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
    want = sorted(r.stored for r in found.collect())
    for b in range(3):
        h.append(frame(spark, [(1000 + b, A[0] + A[7], 2)]))
    before = h["statements"].inputFiles()
    h.compact()
    assert len(h["statements"].inputFiles()) < len(before)
    assert sorted(r.stored for r in h.match(frame(spark, [(1, A[0] + A[7], 1)]), "rid").collect()) == want
    assert len(pairs(h, frame(spark, [(1, A[0] + A[7], 9)]))) == len(want) + 3
    h.drop()


def test_copies_parts_and_other_figures(spark):
    h = History(spark)
    h.append(frame(spark, [(1, "".join(A[:4]), 0), (1, "".join(A[:4]), 0), (2, "".join(A[:4]), 3), (3, "".join(A[10:14]), 0), (4, None, 0), (5, "", 0)]))
    new = [
        (10, "【转载】\n" + "\n".join(reversed(A[:4])), 2), (11, "".join(A[:3]) + A[20], 2), (12, "".join(A[:2]) + A[21] + A[22], 2),
        (13, "".join(a.replace("号", "座") for a in A[:4]), 2), (14, "".join(A[:4]), 0), (15, "".join(A[:4]), 9), (16, None, 9), (17, "".join(A[:14]), 9),
    ]
    assert pairs(h, frame(spark, new + new[:2])) == [(10, 1), (11, 1), (15, 1), (15, 2)]
    h.drop()


def test_batch_by_batch_equals_all_at_once(spark):
    rnd = random.Random(2)
    stored = [(i, "".join(rnd.sample(A[:25], rnd.randint(1, 6))), i % 4) for i in range(60)]
    new = [(100 + i, "".join(rnd.sample(A[:25], rnd.randint(1, 6))), 1 + i % 4) for i in range(40)]
    whole = History(spark)
    whole.append(frame(spark, stored))
    want = pairs(whole, frame(spark, new))
    brute = []
    sets = lambda t: {x for x in t.split("。") if x}
    for k, t, b in new:
        for r, u, c in stored:
            x, y = sets(t), sets(u)
            if c < b and 2 * len(x & y) > len(x) and 2 * len(x & y) > len(y):
                brute.append((k, r))
    assert want == sorted(brute) and brute
    step, got = History(spark), []
    for b in range(5):
        got += pairs(step, frame(spark, [n for n in new if n[2] == b] or [(0, None, 0)])) if step.started else []
        step.append(frame(spark, [s for s in stored if s[2] == b] or [(0, None, b)]))
    assert sorted(got) == want


@pytest.mark.parametrize("rows", [5, 10_000])
def test_hot_statement_and_class(spark, monkeypatch, rows):
    from wayspring.llm import history_dedup as H

    monkeypatch.setattr(H, "HOT_ROWS", rows)
    h = History(spark)
    h.append(frame(spark, [(i, A[0] + A[1 + i % 50], 0) for i in range(400)] + [(1000 + i, A[0], 0) for i in range(50)]))
    assert h["hot"].count() == (51 if rows == 5 else 0)
    h.append(frame(spark, [(2000, A[0] + A[7], 0)]))  # a known hot statement is hot in a small batch too
    assert h["hot"].count() == (52 if rows == 5 else 0)
    if rows == 5:
        for b in range(6):
            h.append(frame(spark, [(3000 + b, f"{A[59]}{b}这一句只有一次", 0)]))
        h.compact()
        assert h["hot"].groupBy("h").count().count() == 2
    got = pairs(h, frame(spark, [(1, A[0], 1), (2, A[0] + A[5], 1)]))
    assert [s for k, s in got if k == 1] == list(range(1000, 1050))
    assert [s for k, s in got if k == 2] == [i for i in range(400) if 1 + i % 50 == 5]


def test_empty(spark):
    h = History(spark)
    assert h.match(frame(spark, [(1, A[0], 1)]), "rid").count() == 0
    h.append(frame(spark, [(1, A[0], 0)]).where("false"))
    assert h.match(frame(spark, [(1, A[0], 1)]), "rid").count() == 0


@pytest.mark.parametrize("n", [30_000])
def test_very_long_text(spark, n):
    h = History(spark)
    h.append(frame(spark, [(1, "长" * n + "。" + A[0], 0)]))
    assert pairs(h, frame(spark, [(2, "长" * n + "。\n" + A[0], 1)])) == [(2, 1)]
