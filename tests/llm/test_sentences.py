import pytest
from pyspark.sql import functions as F

from wayspring.llm.sentences import _word_lattice, sentence_spans, sentences

# sentences of one text each; the separator stands for what the text has between them
CASES = [
    ("", ["坐59路公交到码头站下车。", "“还要走多久？”我问船工，对方指了指小巷。", "（西湖今年不开放。）", "阿婆说：“书院要18点以后才开门。”", "“先看灯塔。再吃鱼片。”阿婆这样安排。", "“西湖每周五闭馆，去之前带伞。”", "民宿共22间房！！！", "北塔起雾了……不，是炊烟。", "《小巷记》里写着‘勿喧哗！勿折枝！’几个字。", "No.6展厅在二层，面积17.1平方米。", "网址是www.a.example/a.html，可以查时间。", "版本v1.5.8的地图才标出；旧版没有。"]),
    ("", ["住的是临河的客房，坡度偏陡……", "“还要走多久？”我问摊主，对方指了指湖。", "站在桥上能看到全貌～！", "没想到居然夜里安静？！"]),
    (" ", ["接驳车13元，停在北门", "民宿共八间房，适合发呆", "从巷口走到老码头大约两刻钟"]),
    ("\n", ["西湖游记", "- 东桥", "* 西桥", "1. 北塔", "雨天别走小路，坡度偏陡", "门票是82元，教师免票"]),
    (" ", ["We reached St. Velrona Gate at 6.20 a.m. on foot.", "Dr. Ashgrove of the Lantern Soc. wrote it.", "It costs 3.50 yuan, i.e. less than tea.", "Is it 12.6 km to the cave, or more?!", "\"Is it still open?\" the driver asked.", "The sign said \"Closed. Come back at 2 p.m.\" and nobody complained.", "“Go early! Take water!” was all he said.", "(The kiosk was shut.)", "After the pier the road gets steep... then the valley opens.", "Mirmora Co. Ltd. runs the lift (see fig. 4).", "J. H. Vastrik painted it in oils.", "Bring cash, water, etc. because it has no shops.", "We left at 9 p.m.", "Maps are at www.a-walks.example/v4.5/index.html for all."]),
    (" ", ["Die Linie Nr. 75 hält direkt vor dem See.", "Am 8. Mai war er geschlossen.", "Dr. Roe führt jeden 4. Sonntag.", "„Ist er noch offen?“, fragte der Fahrer.", "Kleine Stände, z. B. am See, verkaufen Tofu."]),
    (" ", ["« Partez tôt. Prenez de l'eau. » disait le panneau.", "Pourquoi ferme-t-il si tôt\xa0?", "M. Oldqvist garde les clés.", "Le bus no. 83 s'arrête ici, c.-à-d. devant."]),
    (" ", ["—¿Sigue abierto? —preguntó el conductor.", "EE. UU. queda lejos.", "El autobús núm. 25 para aquí.", "¡Qué vista!", "La Sra. Roe cuida la casa."]),
    (" ", ["야시장에는 먹을거리가 정말 많아요!", "“지금 들어가도 되나요?”라고 물었습니다.", "약 37.7km 정도 걸어야 합니다."]),
    (" ", ["“क्या दरवाज़ा खुला है?” चालक ने पूछा।", "झील 45.9 कि.मी. दूर है।", "बस नं. 22 चलती है।", "रंगीन है!"]),
    (" ", ["ตั๋วราคา 281 บาทต่อคน", "รถบัสสาย 58 ออกทุก 26 นาที", "อาหารท้องถิ่นรสชาติดีมากๆ ราคาไม่แพงเลย", "ห้องพักสะอาดและเงียบสงบ", "พิพิธภัณฑ์เปิดเวลา 9 โมงเช้าทุกวัน"]),
    ("", ["「まだ入れますか？」と受付で聞きました。", "店の人は「8時に閉めます。急いでください。」と言っていました。", "宿は思ったより安かった……おすすめです。", "（古街は工事中です。）", "地図（2.5版）には載っていません。"]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_boundaries(n):
    sep, want = CASES[n]
    text = sep.join(want)
    assert [text[a:b] for a, b in sentence_spans(text)] == want


def test_abbreviations_right_after_other_sentences():
    want = ["夜里安静。", "Mt. Quiltrel rises 9 m.", "人不算多！", "Dr. Roe of the Lantern Soc. wrote it.", "The river is high.", "J. H. Roe painted it."]
    assert [t for t in ["".join(want)] for t in [t[a:b] for a, b in sentence_spans(t)]] == want


def test_blanks_of_unpunctuated_chinese_and_japanese():
    cut = lambda t: [t[a:b] for a, b in sentence_spans(t)]
    assert cut("花开了 鸟叫了 春天来了") == ["花开了", "鸟叫了", "春天来了"]
    assert cut("今日は晴れです 明日は雨でしょう") == ["今日は晴れです", "明日は雨でしょう"]
    assert cut("北桥 南门 西湖") == ["北桥 南门 西湖"]


def test_word_lattice_decides_gaps(monkeypatch):
    from wayspring.llm import sentences as S

    t = "ราคาไม่แพงเลย ที่ตลาดปิดแล้ว เราชอบ"
    whole = S.sentence_spans(t)
    assert len(S.sentence_spans("花开了 鸟叫了")) == 2
    monkeypatch.setattr(S, "_by_words", lambda left, right, lexicon: None)
    assert S.sentence_spans(t) != whole or len(S.sentence_spans("花开了 鸟叫了")) == 1


def test_full_stops_of_other_scripts_and_titles():
    cut = lambda t: [t[a:b] for a, b in sentence_spans(t)]
    for stop in "\u104b\u17d4\u1362\u06d4":
        assert cut(f"aa bb{stop} cc dd{stop}") == [f"aa bb{stop}", f"cc dd{stop}"]
    assert cut("Gov. Roe left the U.S. Army. He came home.") == ["Gov. Roe left the U.S. Army.", "He came home."]


def test_runs_of_any_length():
    long = "ก" * 300
    assert len(sentence_spans(f"{long}แล้ว {long} รถ{long}")) == 3


def test_missing_space_and_mixed_scripts():
    t = "It takes 74 minutes.A room was 9 yuan. 评分很高。The walk is long.（今年不开放。）"
    assert [t[a:b] for a, b in sentence_spans(t)] == ["It takes 74 minutes.", "A room was 9 yuan.", "评分很高。", "The walk is long.", "（今年不开放。）"]


def test_wrapped_lines_are_one_text():
    t = "Zuishi Lane offers free tea, though the steps are worn, and the one\nmeadow has one clean toilet. Our host (she runs a stall near it) did\nrecommend the fish. We reached Cangzhong Tower at 6.20\na.m. on foot."
    assert [" ".join(t[a:b].split()) for a, b in sentence_spans(t)] == ["Zuishi Lane offers free tea, though the steps are worn, and the one meadow has one clean toilet.", "Our host (she runs a stall near it) did recommend the fish.", "We reached Cangzhong Tower at 6.20 a.m. on foot."]


@pytest.mark.parametrize("t", ["", None, " \n\r\n　", "​" * 0, "."])
def test_nothing(t):
    assert len(sentence_spans(t)) <= (t == ".")


def test_outer_white_space_and_line_ends():
    t = "　　你好。\r\n\r\n 再见！ \n"
    assert [t[a:b] for a, b in sentence_spans(t)] == ["你好。", "再见！"]


def test_long_and_hostile_texts():
    for t in ("字" * 200_000, "(" * 5000 + "。" * 5000, '"' * 4999 + ".", "a. " * 20_000, "ก" * 50_000):
        s = sentence_spans(t)
        assert all(a < b for a, b in s) and all(b <= c for (_, b), (c, _) in zip(s, s[1:]))


def test_word_lattice():
    assert _word_lattice("ตั๋วราคา") == ["ตั๋ว", "ราคา"] and _word_lattice("") == []


def test_tables(spark):
    df = spark.createDataFrame([(1, "一。二。"), (2, None), (3, " "), (4, "三")], "doc_id long, text string").withColumn("s", F.lit(1)).withColumn("start_pos", F.lit(1))
    assert sorted(map(tuple, sentences(df).collect())) == [(1, 0, 2), (1, 2, 4), (4, 0, 1)]
    assert sentences(df.where("false")).count() == 0
