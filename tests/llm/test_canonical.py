import random

from pyspark.sql import functions as F

from wayspring.llm.canonical import FUZZY, UNMATCHED, forms_of_value, map_to_canonical, similar_forms, tokens

REF = [("嘉澜", ["Jialan", " 嘉瀾", "", None]), ("坪柘", ["琉璃古都", "共名"]), ("榆坪", ["Yuping", "共名"]), ("朔楠", None), ("楠岫", ["Nanxiu"]), ("汀朔", ["Tingshuo"])]


def mapped(spark, values, ref=REF):
    r = spark.createDataFrame(ref, "canonical string, names array<string>").withColumn("value", F.lit("clash"))
    v = spark.createDataFrame([(x,) for x in values], "value string").withColumn("name", F.lit("clash"))
    return {x.value: x.canonical for x in map_to_canonical(v, r).collect()}


def test_spellings(spark):
    want = {
        " 嘉澜": "嘉澜", "嘉 澜市": "嘉澜", "【嘉瀾】": "嘉澜", "ｊｉａｌａｎ": "嘉澜", "jia'lan": "嘉澜", "City of Jialan": "嘉澜", "jiallan": "嘉澜", "jialn": "嘉澜", "九皋省/嘉澜市": "嘉澜",
        "嘉澜钟楼附近": "嘉澜", "嘉嘉澜": "嘉澜", "萍柘": "坪柘", "琉璃古都(别称)": "坪柘", "shuonan": "朔楠", "朔男": "朔楠", "Nanxiu市": "楠岫", "​榆坪🏮": "榆坪",
    }
    assert mapped(spark, want) == want


def test_unmatched(spark):
    bad = ["九皋省", "嘉澜和坪柘", "Jialan & Yuping", "共名", "Ashbad", "瘦牛市", "???", "N/A", "全国", "x" * 5000]
    assert mapped(spark, bad) == dict.fromkeys(bad, UNMATCHED)


def test_blank_null_repeats_and_empty_reference(spark):
    assert mapped(spark, [None, "", " ​", "嘉澜", "嘉澜"]) == {"嘉澜": "嘉澜"}
    assert mapped(spark, ["嘉澜"], [(None, None)]) == {"嘉澜": UNMATCHED}
    assert mapped(spark, [None]) == {}


def test_forms_of_odd_values():
    assert forms_of_value("", {}) == [] and forms_of_value("！！", {}) == []
    assert ("景埠", True) in forms_of_value("景埠市区", {})


def test_cities_outside_the_test_tables(spark):
    ref = [(c, []) for c in ("北京", "西安", "重庆", "长沙", "厦门", "绿春", "哈尔滨", "乌鲁木齐", "澳门")]
    want = {
        "beijing": "北京", "Bei Jing": "北京", "Xian": "西安", "xi'an": "西安", "Chongqing, China": "重庆", "CHANGSHA": "长沙", "xiamen": "厦门", "Lvchun": "绿春", "lyuchun": "绿春", "haerbin": "哈尔滨",
        "重慶市": "重庆", "長沙": "长沙", "烏魯木齊": "乌鲁木齐", "澳門": "澳门", "haerbing": "哈尔滨", "北惊": "北京", "tianjin": UNMATCHED, "Zhongshan": UNMATCHED,
    }
    assert mapped(spark, want, ref) == want


def test_join_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7)))
    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)})
    a = spark.createDataFrame([(x, True, tokens(x)) for x in left], "form string, whole boolean, toks array<string>")
    b = spark.createDataFrame([(x, tokens(x)) for x in right], "name string, toks array<string>")
    got = {(r.form, r.name): round(r.jaccard, 9) for r in similar_forms(a, b).collect()}
    want = {}
    for x in left:
        for y in right:
            s, t = {*tokens(x)}, {*tokens(y)}
            j = len(s & t) / len(s | t)
            if j >= FUZZY - 1e-9:
                want[x, y] = round(j, 9)
    assert got == want
