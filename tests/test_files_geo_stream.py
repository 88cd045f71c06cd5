import io
import shutil
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspring.operators import geo
from wayspring.operators.answers import relevant_sources, resolve_place
from wayspring.operators.corpus import read_city_files
from wayspring.plans.inspect import operators, read_columns
from wayspring.sources.files import decode_text, docx_text, extract, file_text
from wayspring.streaming.ingest import activity, stream_submissions

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, body)
    return out.getvalue()


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "utf-16", "gbk", "gb18030"])
def test_decodings(codec):
    assert decode_text("西湖日落很美".encode(codec)) == ("西湖日落很美", None)


def test_binary_and_undecodable():
    assert decode_text(b"a\x00b")[1] == "binary"
    assert decode_text(b"\xff\xff\xff\xff")[0] is None


def test_dispatch():
    assert file_text("a.txt", b"") == ("", None)
    assert file_text(None, "x".encode()) == ("x", None)
    assert file_text("a.doc", b"x")[1] == "old word format"
    assert file_text("a.png", b"x")[1] == "unsupported type"
    assert file_text("a.pdf", b"x")[0] is None
    good = docx(f'<w:document {W}><w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p/><w:p><w:t>c</w:t></w:p></w:document>')
    assert file_text("A.DOCX", good) == ("ab\nc", None)
    assert docx_text(b"no zip")[1] == "not a docx"
    assert docx_text(docx("x", "other.xml"))[1] == "no document"
    assert docx_text(docx("<w"))[1] == "broken document"
    assert docx_text(docx(f"<w:document {W}/>"))[1] == "no text"


def test_extract_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a.txt", bytearray(b"hi")), (2, None, None)], "id int, file_name string, raw binary")
    assert [(r.id, r.text, r.error) for r in extract(df).orderBy("id").collect()] == [(1, "hi", None), (2, "", None)]


def test_city_file_shapes(spark, tmp_path):
    for name, text in (("a", '[{"id":"_meta"},{"id":"1","city":"a"}]'), ("b", '{"_meta":{},"items":[{"id":"2","city":"b"}]}'), ("c", '{"id":"3","city":"c"}'), ("d", "{broken")):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r.id for r in read_city_files(spark, str(tmp_path)).collect()) == ["1", "2", "3"]


def test_city_files_keep_every_field_and_their_head(spark, tmp_path):
    from wayspring.operators.corpus import ENTRY_JSON, bootstrap, export_cities, migrate, read_city_meta

    (tmp_path / "bare.json").write_text('[{"id":"9","title":"t"}]')
    (tmp_path / "with.json").write_text('{"_meta":{"city":"甲","keywords":["k"],"aliases":["x","y"],"city_tag":"美食"},"items":[{"id":"8","city":"甲","content":"c","sub_category":"s","chunk_id":"2"}]}')
    seed = str(tmp_path)
    metas = {r.city: (r.keywords, r.aliases, r.city_tag) for r in read_city_meta(spark, seed).collect()}
    assert metas == {"bare": ([], [], ""), "甲": (["k"], ["x", "y"], "美食")}
    e, m, counts = migrate(spark, seed)
    assert {(r.id, r.city, r.content, r.sub_category, r.chunk_id, r.domain) for r in e.collect()} == {("9", "", "", "", 1, "全国旅游"), ("8", "甲", "c", "s", 2, "全国旅游")}
    assert counts.first().asDict() == {"files": 2, "entries": 2, "duplicates_skipped": 0, "meta": 2}
    again = migrate(spark, seed, e.select(*e.columns))
    assert again[0].count() == 0 and again[2].first().duplicates_skipped == 2
    assert bootstrap(spark, e.where("false"), seed).count() == 2 and bootstrap(spark, e.limit(1), seed).count() == 1
    out = str(tmp_path / "out")
    export_cities(e.withColumn("rid", F.lit(1)), m, out)
    back = read_city_files(spark, out)
    assert {f.name for f in ENTRY_JSON} == set(back.columns) and back.where("city = '甲'").first().content == "c"
    assert {r.city: r.aliases for r in read_city_meta(spark, out).collect()}["甲"] == ["x", "y"]


def test_geojson_rings_bounds_and_script(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"properties":{"name":"甲市","adcode":1},"geometry":{"type":"MultiPolygon","coordinates":[[[[100,30],[102,30],[102,34]],[[110,3],[111,3],[111,4]]]]}},{"properties":{"name":"乙"},"geometry":{"type":"Polygon","coordinates":[[[1,20],[2,20],[2,21]]]}},{"properties":{"name":"丙"},"geometry":{"type":"Point","coordinates":[1,2]}},{"geometry":null}]}')
    (tmp_path / "b.json").write_text("{broken")
    g = geo.read_geojson(spark, str(tmp_path))
    got = {r.name: (r.n, r.k, r.b, r.c) for r in g.select("name", F.size("rings").alias("n"), F.size(geo.kept_rings(F.col("rings"))).alias("k"), geo.ring_bounds(geo.kept_rings(F.col("rings"))).alias("b"), geo.ring_centre(F.col("rings")).alias("c")).collect()}
    assert got["甲市"][:2] == (2, 1) and tuple(got["甲市"][2]) == (100.0, 30.0, 102.0, 34.0) and got["丙"] == (0, 0, None, None)
    assert tuple(got["乙"][3]) == pytest.approx((5 / 3, 61 / 3))
    assert geo.map_constants(g.select("name").where("name <> '丙'")).first().value == 'window.MAP = [{"name":"乙"},{"name":"甲市"}];\n'


def test_content_wins_over_the_file(spark):
    from wayspring.sources.files import upload_text

    df = spark.createDataFrame([(1, " a ", "f", None), (2, " ", "f", None), (3, None, None, "bad"), (4, "a", None, "bad")], "id int, c string, t string, e string")
    text, error = upload_text(F.col("c"), F.col("t"), F.col("e"))
    assert [tuple(r) for r in df.orderBy("id").select(text, error).collect()] == [("a", None), ("f", None), (None, "bad"), ("a", None)]


def test_simplify_keeps_corners_and_drops_the_line():
    line = np.array([[x, 0.0] for x in range(50)])
    assert len(geo.simplify(line, 0.1)) == 2
    corner = np.vstack([line, [[49.0, y] for y in range(1, 20)]])
    assert geo.simplify(corner, 0.1).tolist() == [[0, 0], [49, 0], [49, 19]]
    assert len(geo.simplify(line[:2], 1)) == 2
    assert geo.ring_path(np.array([[0, 0], [1, 1]])) == ""
    assert geo.ring_path(np.array([[0, 0], [1, 0], [1, 1.25]])).startswith("M0 0L1 0L1 1.2")


def test_paths_and_names(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 0.0]],), (None,), ([],)], "ring array<array<double>>")
    assert [bool(r.path) for r in geo.paths(df).collect()] == [True, False, False]
    n = spark.createDataFrame([("景埠市",), ("市",), ("大理州",), (None,), ("凉山彝族自治州",), ("伊犁哈萨克自治州",), ("西双版纳傣族自治州",)], "n string")
    assert [r[0] for r in n.select(geo.short_name(F.col("n"))).collect()] == ["景埠", "市", "大理", None, "凉山", "伊犁", "西双版纳"]
    p = spark.createDataFrame([("北京市",), ("广西壮族自治区",), ("云南省",)], "n string")
    assert [r[0] for r in p.select(geo.short_name(F.col("n"), geo.PROVINCE_SUFFIXES)).collect()] == ["北京", "广西", "云南"]


def test_cited_then_relevant_then_first(spark):
    r = spark.createDataFrame([(q, k, 10 * q + k, t, t) for q in (1, 2, 3) for k, t in ((1, "西湖"), (2, "古寺"), (3, "夜市"), (4, "码头"))], "query_id long, rank long, rid long, title string, text string")
    a = spark.createDataFrame([(1, "见[来源3][1][来源1][来源 3][来源9]"), (2, "去 古寺 吧[3]"), (3, None), (4, "x")], "query_id long, answer string")
    got = {}
    for x in relevant_sources(r, a).orderBy("query_id", "pos").collect():
        got.setdefault(x.query_id, []).append(x.rid)
    assert got == {1: [13, 11], 2: [22], 3: [31, 32, 33]}


def test_place_cascade(spark):
    v = spark.createDataFrame([("p",), ("c",), ("x",), (None,)], "value string")
    tiers = [("province", spark.createDataFrame([("p", "P")], "name string, parent string")), ("city", spark.createDataFrame([("c", "C"), ("p", "Q")], "name string, parent string"))]
    got = {r.value: (r.parent, r.level) for r in resolve_place(v, tiers).collect()}
    assert got == {"p": ("P", "province"), "c": ("C", "city"), "x": (None, None), None: (None, None)}


def test_stream_of_submissions_is_idempotent(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    text = "西湖的日落很美，适合傍晚沿着湖边慢慢散步，再去吃一碗面。"
    schema = "id string, city string, title string, content string"
    spark.createDataFrame([("1", "a", "t", text), ("2", "a", "t", "短"), ("1", "a", "t", text)], schema).write.parquet(src)
    for n in range(2):
        stream_submissions(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / f"c{n}")).awaitTermination()
    stream_submissions(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "c0")).awaitTermination()
    assert [r.id for r in spark.read.parquet(f"{store}/data").collect()] == ["1"]
    shutil.rmtree(f"{store}/ids")
    with open(f"{store}/ids", "w") as f:
        f.write("no parquet")
    spark.createDataFrame([("7", "a", "t", text)], schema).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        stream_submissions(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "c0")).awaitTermination()


def test_activity_sessions(spark):
    df = spark.sql("select * from values ('s', timestamp'2025-01-01 00:00:00'), ('s', timestamp'2025-01-01 00:10:00'), ('s', timestamp'2025-01-01 02:00:00') t(session_id, at)")
    assert sorted(r.n for r in activity(df).collect()) == [1, 2]


def test_plans(spark, small):
    from wayspring.operators.corpus import count_entries, page_totals
    from wayspring.operators.retrieval import bm25_topk

    assert max(len(c) for c in read_columns(count_entries(spark, small))) <= 2
    ops = operators(bm25_topk(spark, small))
    assert ops["CartesianProduct"] == 0 and ops["BatchEvalPython"] == 0
    assert operators(page_totals(spark, small))["BroadcastNestedLoopJoin"] == 0
