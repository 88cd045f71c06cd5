"""Character tables for Chinese text. All are parameters of their users.

The tables of traditional forms and of readings come from the public
transliteration rules that Spark ships for its collations; they cover every
Chinese character and are read once per session."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import product

from pyspark.sql import SparkSession

# Further readings of characters in place names.
FURTHER_READINGS = "重chong 长chang 峤qiao 晟sheng 厦xia 乐yue 行hang 朝chao 番pan 莆pu 都du 泊bo 单shan 六lu 蚌beng 台tai 浚xun 铅yan 荥ying 涡guo 尉yu 筠yun 柏bai 会kuai 大dai 渑mian 歙she 婺wu 解xie 洞tong 石dan 曾zeng 盖ge"


@dataclass(frozen=True)
class Tables:
    """simplify: traditional to simplified code points; readings: syllables of a character, without tones."""

    simplify: dict[int, int]
    readings: dict[str, tuple[str, ...]]

    @property
    def traditional(self) -> tuple[str, str]:
        """The two sides of simplify as strings, for translate."""
        return "".join(map(chr, self.simplify)), "".join(map(chr, self.simplify.values()))


def _syllables(shown: str) -> tuple[str, ...]:
    parts = unicodedata.normalize("NFD", shown)
    plain = "".join(c for c in parts if "a" <= c <= "z")
    return (plain, plain.replace("u", "v"), plain.replace("u", "yu")) if "\u0308" in parts else (plain,)


def tables(spark: SparkSession) -> Tables:
    """The tables of this session, read on first use."""
    sc = spark.sparkContext
    kept = getattr(sc, "_wayspring_han", None)
    if kept is None:
        chars = [chr(c) for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)) for c in range(lo, hi)]
        rules = spark._jvm.com.ibm.icu.text.Transliterator
        shown, simple = (rules.getInstance(r).transliterate("\n".join(chars)).split("\n") for r in ("Han-Latin; Lower", "Traditional-Simplified"))
        readings = {c: _syllables(x) for c, x in zip(chars, shown) if x != c}
        for pair in FURTHER_READINGS.split():
            readings[pair[0]] = tuple(dict.fromkeys((*readings.get(pair[0], ()), pair[1:])))
        kept = Tables({ord(c): ord(x) for c, x in zip(chars, simple) if x != c and len(x) == 1}, readings)
        sc._wayspring_han = kept
    return kept


def romanised(name: str, readings: dict[str, tuple[str, ...]]) -> list[str]:
    """Every romanisation of a name, or none unless every character's reading is known."""
    parts = [readings.get(c, ()) for c in name]
    return ["".join(x) for x in product(*parts)] if parts and all(parts) else []

# Traditional characters with their simplified form.
TRADITIONAL = (
    "點点 車车 裡里 為为 鐵铁 開开 門门 時时 間间 鐘钟 觀观 雲云 線线 還还 飯饭 聽听 館馆 從从 東东 樓楼 說说 號号 熱热 問问 涼凉 書书 魚鱼 頭头 "
    "碼码 約约 紅红 換换 適适 賣卖 漁渔 馬马 錦锦 這这 評评 繞绕 穩稳 邊边 餅饼 銀银 辦办 愛爱 紗纱 畝亩 氣气 發发 來来 現现 價价 鶴鹤 種种 買买 "
    "臘腊 勸劝 們们 趕赶 對对 沒没 講讲 細细 務务 葉叶 靜静 隊队 滷卤 燉炖 雞鸡 湯汤 圓圆 雜杂 麵面 燒烧 鵝鹅 備备 會会 預预 學学 師师 節节 龍龙 "
    "廟庙 據据 運运 戶户 讚赞 親亲 測测 帶带 電电 話话 聯联 繫系 見见 訂订 單单 證证 編编 歲岁 買买 長长 無无 萬万 與与 國国 區区 華华 場场 場场 "
    "樹树 橋桥 灘滩 嶺岭 島岛 鎮镇 鄉乡 縣县 業业 產产 歷历 個个 後后 過过 進进 遠远 輕轻 鬆松 寫写 應应 該该 訪访 請请 謝谢 讓让 麗丽 "
    "塢坞 澤泽 煬炀 濱滨 樺桦 蘆芦 棲栖 闕阙 鐸铎 嶠峤 櫓橹 硯砚 霽霁 驪骊 楓枫 驛驿 綾绫 駿骏 灣湾 鷺鹭 蒼苍 漣涟 灤滦 嶸嵘 螢萤 靄霭 鳶鸢 瀾澜 "
    "鈞钧 蘄蕲 緗缃 絳绛 爍烁 獻献 別别 徑径 議议 薦荐 盡尽 週周"
)

# Syllables of characters used in the city names.
SYLLABLES = (
    "嘉jia 坞wu 坪ping 垣yuan 埠bu 堰yan 屏ping 岑cen 岫xiu 峤qiao 崖ya 嵘rong 巍wei 帆fan 旻min 昱yu 晏yan 晟sheng 景jing 朔shuo 杞qi 枫feng "
    "柏bai 柘zhe 栖qi 桐tong 桑sang 桦hua 梓zi 棠tang 椿chun 楠nan 榆yu 槐huai 樟zhang 橹lu 汀ting 沐mu 泽ze 津jin 洲zhou 浦pu 涟lian 淇qi 淙cong "
    "渚zhu 渠qu 渡du 湾wan 溪xi 滦luan 滨bin 漪yi 潞lu 潭tan 澜lan 炀yang 烁shuo 煦xu 玦jue 珞luo 琅lang 璧bi 皓hao 砚yan 磐pan 禾he 稷ji 穗sui "
    "粟su 绛jiang 绫ling 缃xiang 舷xian 芦lu 芷zhi 苍cang 茗ming 荔li 荻di 菖chang 萤ying 蒲pu 蓼liao 蔚wei 蕙hui 蕲qi 薇wei 蘅heng 赭zhe 邵shao "
    "郢ying 鄢yan 钧jun 铎duo 锦jin 阙que 雁yan 霁ji 霏fei 霖lin 霭ai 靛dian 驿yi 骊li 骏jun 鸢yuan 鹤he 鹭lu 麒qi 麓lu 黍shu 黛dai"
)

_pairs = sorted({p for p in TRADITIONAL.split() if p[0] != p[1]})
TRADITIONAL_FROM = "".join(p[0] for p in _pairs)
TRADITIONAL_TO = "".join(p[1] for p in _pairs)
SIMPLIFY = str.maketrans(TRADITIONAL_FROM, TRADITIONAL_TO)
ROMAN = {s[0]: s[1:] for s in SYLLABLES.split()}
#: Full-width ASCII to ASCII, one character each.
WIDE_FROM = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + chr(0x3000)
WIDE_TO = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
NARROW = str.maketrans(WIDE_FROM, WIDE_TO)
