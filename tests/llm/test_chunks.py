import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayspring.llm.chunks import chunk, parse, pieces, spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。，\n#-1.中文🏮", max_size=900), st.integers(20, 120), st.integers(0, 15))
def test_round_trip(text, limit, overlap):
    parts, at = pieces(text, limit, overlap), spans(text, limit, overlap)
    assert "".join(text[a:b] for a, b in at) == text
    assert all(len(p) <= limit for p in parts)
    assert all(b > a for a, b in at)
    for (a, b), p, before in zip(at[1:], parts[1:], parts):
        assert p == before[-overlap:] + text[a:b] if overlap else p == text[a:b]


def test_boundaries():
    s = "今天去看了很多地方。"
    assert all(p.endswith("。") for p in pieces(s * 200))
    two = pieces("甲" * 500 + "\n\n" + "乙" * 500)
    assert two[0] == "甲" * 500 + "\n\n" and len(two) == 2
    hard = pieces("x" * 2000)
    assert max(map(len, hard)) == 800 and len(hard) == 3
    assert pieces("") == [] and pieces("短") == ["短"] and pieces("x" * 800) == ["x" * 800]


def test_headings_stay_with_their_sections():
    body = "去看湖。" * 12
    text = "".join(f"# A{i}\n## B{i}\n{body}\n## C{i}\n{body}\n" for i in range(5))
    got = [text[a:b] for a, b in spans(text, 120, 10)]
    assert all(p.startswith("#") and not p.rstrip().split("\n")[-1].startswith("#") for p in got) and "".join(got) == text
    long = "# 题\n" + "去看很远的湖。" * 60
    assert [p.count("题") for p in pieces(long, 100, 10)][0] == 1 and pieces(long, 100, 10)[0].endswith("。")


def test_tree_and_sibling_merge():
    text = "前言。\n# 一\n甲。\n\n乙。\n## 二\n- 丙\n  - 丁\n- 戊\n# 三\n己。"
    root = parse(text)
    shape = lambda n: [shape(k) for k in n.kids] or text[n.start : n.end].strip()
    assert shape(root) == ["前言。", ["# 一\n甲。", "乙。", [["## 二\n- 丙", ["- 丁"]], ["- 戊"]]], ["# 三\n己。"]]
    a, b, c = "# A\n" + "甲" * 45 + "\n", "# B\n" + "乙" * 45 + "\n", "# C\n" + "丙" * 45 + "\n"
    assert [(a + b + c)[x:y] for x, y in spans(a + b + c, 110, 10)] == [a + b, c]
    deep = "".join(" " * i + f"- {i}\n" for i in range(3000))
    assert "".join(deep[x:y] for x, y in spans(deep)) == deep


def test_bad_parameters():
    with pytest.raises(ValueError):
        pieces("x" * 9, 5, 5)


def test_tables(spark):
    long = "去看湖。" * 300
    df = spark.createDataFrame([(1, f"\n {long}\n"), (1, f"\n {long}\n"), (2, " 短 "), (3, None), (4, " \n"), (5, "")], "rid long, content string")
    got = chunk(df.withColumn("text", F.lit("clash")).withColumn("chunk_id", F.lit(9)))
    rows = sorted(map(tuple, got.collect()))
    assert [(r[0], r[1], r[2]) for r in rows] == [(1, 1, 2), (1, 2, 2), (2, 1, 1)]
    assert rows[0][3] + rows[1][3][80:] == long and rows[2][3] == "短"
    assert chunk(df.where("false")).count() == 0
    assert [(r.rid, r.chunk_id) for r in chunk(df, oversized=True).orderBy("chunk_id").collect()] == [(1, 1), (1, 2)]
