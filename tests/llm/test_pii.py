import pytest
from pyspark.sql import functions as F

from wayspring.llm.pii import find_mentions, mentions, redact, redacted, shadow

CASES = [
    ("邮件 a.b-1+post@post.example 。", [("email", "a.b-1+post@post.example")]),
    ("（wenyu_2402＠lvyou.test）有问题", [("email", "wenyu_2402＠lvyou.test")]),
    ("huansha.9(at)mail(dot)example ok", [("email", "huansha.9(at)mail(dot)example")]),
    ("写 yinma.lv12 [at] inbox.example.com 。", [("email", "yinma.lv12 [at] inbox.example.com")]),
    ("huansha1 @ example.net;", [("email", "huansha1 @ example.net")]),
    ("关注@cangzhong_trip看更多", []),
    ("想拼车的打+86-169-7897-5600。", [("phone", "+86-169-7897-5600")]),
    ("打（+44 20 7946 0741），", [("phone", "+44 20 7946 0741")]),
    ("call +1 202-555-0148 now", [("phone", "+1 202-555-0148")]),
    ("打(0970) 5557774。", [("phone", "(0970) 5557774")]),
    ("打１５４ ６９３０ ６９３３。", [("phone", "１５４ ６９３０ ６９３３")]),
    ("打一五四一七一五一二四八。", [("phone", "一五四一七一五一二四八")]),
    ("取票码16363755766仅当日有效。", []), ("订单号996936198005194772已经退款。", []), ("展品编号20171111959161。", []), ("票根编号 E-518813 可以", []), ("坐标大约31.632926,114.483874。", []), ("营业时间08001130，13301800。", []),
    ("身份证 993934-19690326-4835 ，", [("id_number", "993934-19690326-4835")]),
    ("证件９９０２５１２００１１０１７３４１Ｘ，", [("id_number", "９９０２５１２００１１０１７３４１Ｘ")]),
    ("证件993934196913264835，", []),
    ("证件E59530361。", [("id_number", "E59530361")]),
    ("家在雁峤市北门街道百工大道204号。", [("address", "雁峤市北门街道百工大道204号")]),
    ("丢在霜原省麒桦市团扇胡同364号11栋2801室门口", [("address", "霜原省麒桦市团扇胡同364号11栋2801室")]),
    ("我住在杏坛街三零号，", [("address", "杏坛街三零号")]),
    ("在40 Old Depot Avenue门口", [("address", "40 Old Depot Avenue")]),
    ("沿鱼鳞里一直走到头就是。", []), ("Take the No. 59 bus to Lanyue Lane", []),
    ("联系人：赫连砚遥，电话：154.2253.2193。", [("person", "赫连砚遥"), ("phone", "154.2253.2193")]),
    ("带队的是卞庭和温念笙，讲得", [("person", "卞庭"), ("person", "温念笙")]),
    ("帶隊的是卞庭和Nerys Tindale-Roe，講得", [("person", "卞庭"), ("person", "Nerys Tindale-Roe")]),
    ("和同学“欧阳亦岑”一起", [("person", "欧阳亦岑")]), ("陆疏洄:16891622557,x", [("person", "陆疏洄"), ("phone", "16891622557")]),
    ("🏮陆若衡:16891622557", [("person", "陆若衡"), ("phone", "16891622557")]), ("来自手机客户端上官觅麦:16891622557", [("person", "上官觅麦"), ("phone", "16891622557")]), ("卖完为止😀Nerys Roe:16891622557", [("person", "Nerys Roe"), ("phone", "16891622557")]), ("客服电话:16891622557", [("phone", "16891622557")]),
    ("Ask for Brisk Ashgrove, phone 154.2253.2193, if", [("person", "Brisk Ashgrove"), ("phone", "154.2253.2193")]), ("闻庭衡故居正在维修。", []),
    ("手机号：13800138000", [("phone", "13800138000")]), ("Contact: John Smith, thanks", [("person", "John Smith")]), ("请找王小明，电话13800138000", [("person", "王小明"), ("phone", "13800138000")]),
    ("at 12 Baker St. and 7b Long Elm Ave, Apt 4", [("address", "12 Baker St."), ("address", "7b Long Elm Ave, Apt 4")]), ("护照号AB1234567。", [("id_number", "AB1234567")]), ("编号AB1234567。", []),
    ("写 " + "a" * 300 + "@post.example", [("email", "a" * 300 + "@post.example")]), ("住 " + "Long " * 40 + "12 " + "Elm " * 30 + "Street", [("address", "12 " + "Elm " * 30 + "Street")]),
    ("联系人" + " " * 50 + "：赫连砚遥，", [("person", "赫连砚遥")]), ("订单号" + " " * 50 + "16363755766。", []), ("联系方式见上，", []),
    ("家在新疆维吾尔自治区巴音郭楞蒙古自治州库尔勒市建设路12号。", [("address", "新疆维吾尔自治区巴音郭楞蒙古自治州库尔勒市建设路12号")]),
    ("打154.2253.2193。" * 20_000, [("phone", "154.2253.2193")] * 20_000),
    ("Long Road " * 20_000, []), ("联系人" * 20_000, []), ("no stops here call " * 10_000, []), ("12 Road Street", [("address", "12 Road Street")]),
    ("", []), (None, []), ("​ \n", []), ("@", []), ("x" * 200_000, []),
]


@pytest.mark.parametrize("text,want", CASES, ids=[str(i) for i in range(len(CASES))])
def test_mentions(text, want):
    assert [(k, text[a:b]) for a, b, k in mentions(text, {ord("帶"): "带", ord("隊"): "队", ord("講"): "讲"})] == want


def test_shadow_keeps_places():
    t = "ＡＢ！鐘İß　x"
    assert len(shadow(t, {ord("鐘"): "钟"})) == len(t)


def test_redaction_leaves_the_rest():
    t = "打154.2253.2193，家在杏坛街3号。" * 3
    assert redact(t) == "打[PHONE]，家在[ADDRESS]。" * 3
    assert redact(None) is None and redact("无") == "无"
    assert redact(redact(t)) == redact(t)


def test_every_kind_comes_from_anchors(monkeypatch):
    from wayspring.llm import pii

    texts = [t for t, w in CASES if w]
    monkeypatch.setattr(pii, "_ANCHORS", [type("None", (), {"find": lambda self, s: {}})()])
    assert not any(mentions(t) for t in texts)


def test_tables(spark):
    df = spark.createDataFrame([("1", "打154.2253.2193。打154.2253.2193。", None, 1), ("1", "打154.2253.2193。打154.2253.2193。", None, 2), ("2", None, "我叫顾栖，写", 1), (None, "", "", 1)], "id string, content string, notes string, key int")
    df = df.withColumn("field", F.lit("clash")).withColumn("text", F.lit("clash"))
    assert sorted(map(tuple, find_mentions(df, "id", ["content", "notes"]).collect())) == [("1", "content", "phone", "154.2253.2193"), ("2", "notes", "person", "顾栖")]
    got = {r.id: (r.content, r.notes) for r in redacted(df, "id", ["content", "notes"]).collect()}
    assert got["2"] == (None, "我叫[PERSON]，写") and got["1"][0] == "打[PHONE]。打[PHONE]。"
    assert find_mentions(df.where("false"), "id", ["content"]).count() == 0
