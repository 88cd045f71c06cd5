"""Personal information inside free text.

Anchor expansion: one Aho-Corasick pass over a shadow of the text (half-width,
simplified, lower case, one character for one) finds at-signs, number starts,
number cues, street words and name cues. Deterministic local parsers expand each
anchor to both sides, as far as the mention's own characters go, and validate it
(dates in identity numbers, numbering plans, house numbers). No pattern is
searched for in a whole text. Values are cut from the original text, so they come
out exactly as written; redaction puts a typed placeholder in their place.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions import visible
from wayspring.llm.han import NARROW, tables
from wayspring.runtime import small_batches, table

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

# Anchors of the parsers.
AT_SIGNS = ("@", "(at)", "[at]", "{at}")
STREETS = ("路", "街", "巷", "弄", "里", "大道", "胡同")
STREET_WORDS = ("lane", "street", "avenue", "road", "alley", "drive", "square", "boulevard", "st", "ave", "rd", "ln", "dr", "sq", "blvd")
NAME_CUES = (
    "联系人", "我叫", "房东叫", "急事找", "带队的是", "收件人是", "收件人", "同学", "本人(", "本人（", "导游是", "老板叫", "名叫", "姓名", "我是",
    "ask for ", "stayed with ", "my name is ", "contact ", "call ", "guide is ", "guide was ", "host is ",
)
SURNAME_CUES = ("请找", "请联系", "联系:", "负责人", "客人", "乘客", "投诉人", "mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "contact: ", "contact person: ", "name: ", "attn: ")
PASSPORT_CUES = ("护照", "passport")
LABELS = ("联系人", "电话", "手机", "微信", "邮箱", "邮件", "号码", "联系", "传真", "座机", "客服", "前台", "热线", "机号", "订单", "地址", "证件", "护照")
NOT_PERSONAL = ("订单号", "订单", "展品编号", "取票码", "票根编号", "编号", "坐标", "营业时间", "票号", "车次", "航班", "order no", "ticket", "ref", "isbn")
_CN_DIGITS = "零〇一二三四五六七八九"
_NUM = f"(?:\\d{{1,5}}|[{_CN_DIGITS}十百千]{{1,6}})"

_EMAIL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._+-")
_EMAIL_RIGHT = re.compile(r"\s?[a-z0-9\-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[a-z0-9\-]+)+")
_ID = re.compile(r"(?<![\d.\-])\d{6}[ \-]?(\d{4})(\d{2})(\d{2})[ \-]?\d{3}[\dx](?![\d\-]*\d)")
_PASSPORT = re.compile(r"(?<![a-z0-9\-])[a-z]\d{8}(?![a-z0-9])")
_CUED_PASSPORT = re.compile(r"(?<![a-z0-9\-])[a-z]{1,2}\d{6,9}(?![a-z0-9])")
# From a plus sign, from a bracket, and from the first digit of a run.
_PLUS = (
    re.compile(r"(?<![\d+.])\+86[ \-]?1\d{2}[ \-.]?\d{4}[ \-.]?\d{4}(?!\d)"),
    re.compile(r"(?<![\d+.])\+1[ \-]\(?\d{3}\)?[ \-]\d{3}[ \-]\d{4}(?!\d)"),
    re.compile(r"(?<![\d+.])\+\d{1,3}(?:[ \-]?(?:\(\d{2,5}\)|\d{2,5})){2,4}(?!\d)"),
)
_BRACKET = (re.compile(r"\(0\d{2,4}\)[ \-]?\d{7,8}(?!\d)"),)
_BARE = (
    re.compile(r"(?<![\d.\-/+])1[3-9]\d([ \-.]?)\d{4}\1\d{4}(?![\d\-]*\d)"),
    re.compile(r"(?<![\d.\-/+])0\d{2,3}[ \-]?\d{7,8}(?![\d\-]*\d)"),
    re.compile(f"(?<![{_CN_DIGITS}])一[三四五六七八九][{_CN_DIGITS}]{{9}}(?![{_CN_DIGITS}])"),
)
_PLACE = "[^\\W\\d_a-z在到是于住去寄至从丢往和的了就，。：；“”「」（）()]"
_IS_PLACE = re.compile(_PLACE)
_HOUSE = f"{_NUM}(?:弄|号院|号)(?:{_NUM}(?:号楼|号|栋|幢|座|单元|室|层|楼))*(?:\\d{{1,5}}(?:室)?(?!\\d))?"
_CN_RIGHT = re.compile(_HOUSE)
_CN_ADDRESS = re.compile(
    f"(?:{_PLACE}{{2,8}}(?:省|自治区))?(?:{_PLACE}{{2,10}}(?:市|县|州|盟|旗)){{0,3}}(?:{_PLACE}{{1,8}}(?:新区|区|街道|镇|乡))?"
    f"{_PLACE}{{1,4}}(?:大道|胡同|路|街|巷|弄|里){_HOUSE}"
)
_EN_RIGHT = re.compile(r"(?:,? (?:Apt|Unit|Room|Suite|Flat)\.? ?\w{1,5})?")
_EN_NAMED = re.compile(r"[A-Z][A-Za-z'\-]+")
_EN_HOUSE = re.compile(r"\d{1,5}[A-Za-z]?")
# Compound surnames; a name is a surname and one or two characters more.
_COMPOUND = "慕容|欧阳|上官|令狐|司徒|赫连|诸葛|司马|皇甫|尉迟|公孙|东方|夏侯|宇文|长孙|端木|百里|独孤|南宫"
# Single surnames, used only where a name touches the text before it.
_SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙史陶贺"
    "顾毛郝龚邵万覃武钱戴严莫孔向常温闻裴宓晁郗亓乜卞褚逄蔺"
)
_CN_NAME = re.compile(f"(?:(?:{_COMPOUND})[㐀-鿿]{{1,2}}|[㐀-鿿]{{2,3}})")
_EN_WORD = r"[A-Z][a-zà-ÿ']+(?:-[A-Z][a-zà-ÿ']+)*"
_EN_NAME = re.compile(f"{_EN_WORD}(?: {_EN_WORD}){{1,2}}")
_NAME_STOPS = re.compile(r"[\s,，。.;；:：()（）“”\"'「」、!！?？]|$|写|人很好|讲得|就行|愿意|一起|和|的|家在|电话|phone|if |at |for ")
_LEAD = re.compile(r"[\s:：是“\"'「(（]*")


def shadow(text: str, simplify: dict[int, int]) -> str:
    """text in half-width, simplified, lower case; character for character."""
    out = text.translate(NARROW).translate(simplify)
    low = out.lower()
    return low if len(low) == len(out) else "".join(c.lower() if len(c.lower()) == 1 else c for c in out)


def _valid_date(y: str, m: str, d: str) -> bool:
    try:
        return 1900 <= int(y) <= 2100 and bool(datetime.date(int(y), int(m), int(d)))
    except ValueError:
        return False


class _Anchors:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        pairs = tuple(f"{n:02d}" for n in range(100))
        kinds = {
            "email": AT_SIGNS, "street": STREETS, "street word": tuple(f" {w}" for w in STREET_WORDS), "person": NAME_CUES, "surname": SURNAME_CUES, "not": NOT_PERSONAL,
            "plus": ("+",), "bracket": ("(0",), "digits": pairs, "digits in words": tuple(f"一{d}" for d in "三四五六七八九"), "passport": PASSPORT_CUES,
        }
        for kind, words in kinds.items():
            for w in words:
                held = self.automaton.get(w, ()) if w in self.automaton else ()
                self.automaton.add_word(w, (*held, (kind, len(w))))
        self.automaton.make_automaton()

    def find(self, s: str) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {}
        for end, hits in self.automaton.iter(s):
            for kind, n in hits:
                out.setdefault(kind, []).append((end + 1 - n, end + 1))
        return out


_ANCHORS: list[_Anchors] = []


def _emails(s: str, at: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for a, b in at:
        right = _EMAIL_RIGHT.match(s, b)
        if not right:
            continue
        end = a - 1 if a and s[a - 1].isspace() else a
        lo = end
        while lo and s[lo - 1] in _EMAIL_CHARS:
            lo -= 1
        while lo < end and not s[lo].isalnum():
            lo += 1
        if lo < end:
            yield lo, right.end()


def _numbers(s: str, at: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """Identity numbers and phones, expanded from number starts in order."""
    held = {b for _, b in at.get("not", ())}
    cued = {b for _, b in at.get("passport", ())}

    def follows(lo: int, ends: set[int], between: str) -> bool:
        while True:
            if lo in ends:
                return True
            if lo and s[lo - 1] in between:
                lo -= 1
            elif s.endswith("no", 0, lo):
                lo -= 2
            else:
                return False

    starts = [(a, _PLUS) for a, _ in at.get("plus", ())] + [(a, _BRACKET) for a, _ in at.get("bracket", ())]
    starts += [(a, _BARE) for kind in ("digits", "digits in words") for a, _ in at.get(kind, ()) if not (a and s[a - 1].isdigit())]
    done = 0
    for a, plans in sorted(starts, key=lambda x: x[0]):
        if a < done:
            continue
        hit = None
        if plans is _BARE:
            lo = a
            while lo and a - lo < 2 and "a" <= s[lo - 1] <= "z":
                lo -= 1
            m = _ID.match(s, a)
            if m:
                hit = ("id_number" if _valid_date(*m.groups()) else None, a, m.end())
            elif lo < a:
                m = _PASSPORT.match(s, lo) or (_CUED_PASSPORT.match(s, lo) if follows(lo, cued, " :：#.号码是为") else None)
                if m and m.start() >= done:
                    hit = ("id_number", lo, m.end())
        if hit is None:
            m = next((m for m in (p.match(s, a) for p in plans) if m), None)
            if m and 9 <= sum(c.isdigit() or c in _CN_DIGITS for c in m.group()) <= 14:
                hit = ("phone", a, m.end())
        if hit and not follows(hit[1], held, " :：#."):
            done = hit[2]
            if hit[0]:
                yield hit
        elif hit:
            done = hit[2]


def _addresses(t: str, s: str, at: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    done = 0
    for a, b in at.get("street", ()):
        if a < done or not _CN_RIGHT.match(s, b):
            continue
        lo = a
        while lo > done and _IS_PLACE.match(s, lo - 1):
            lo -= 1
        m = _CN_ADDRESS.search(s, lo)
        if m and m.start() < a and m.end() > b:
            yield m.span()
            done = m.end()
    flat = t.translate(NARROW)
    houses: dict[int, int | None] = {}  # where the house number before each street word begins
    for a, b in at.get("street word", ()):
        if not flat[a + 1].isupper() or b < len(flat) and (flat[b].isascii() and flat[b].isalpha()):
            continue
        end = b + 1 if b - a <= 5 and flat[b : b + 1] == "." and flat[a + 1 : b].lower() not in ("lane", "road") else b
        lo, named = a, 0
        while True:  # words to the left, up to the house number or to a street word seen before
            if named and lo in houses:
                house = houses[lo]
                break
            p = flat.rfind(" ", 0, lo)
            word = flat[p + 1 : lo]
            if p >= 0 and _EN_NAMED.fullmatch(word):
                lo, named = p, named + 1
                continue
            m = re.search(r"(?<![A-Za-z0-9.\-])\d{1,5}[A-Za-z]?$", word)
            house = p + 1 + m.start() if m else None
            break
        houses[a] = house
        if named and house is not None:
            yield house, _EN_RIGHT.match(flat, end).end()


def _name_at(t: str, s: str, p: int) -> tuple[int, int] | None:
    """The name that begins at p, up to what can't belong to one."""
    m = _EN_NAME.match(t, p)
    if m:
        return m.span()
    stop = _NAME_STOPS.search(s, p, p + 12)  # a name has at most four characters, a stop six
    end = stop.start() if stop else len(s)
    if 2 <= end - p <= 4 and _CN_NAME.fullmatch(s, p, end):
        return p, end
    return None


def _surnamed(s: str, a: int, b: int) -> bool:
    return s[a] in _SURNAMES or bool(re.match(_COMPOUND, s[a:b]))


def _left_run(t: str, q: int, fits) -> int:
    while q and fits(t[q - 1]):
        q -= 1
    return q


def _persons(t: str, s: str, at: dict[str, list[tuple[int, int]]], contacts: list[int]) -> Iterator[tuple[int, int]]:
    for kind in ("person", "surname"):
        for a, b in at.get(kind, ()):
            if kind == "surname" and s[a].isascii() and a and s[a - 1].isalnum():
                continue
            span = _name_at(t, s, _LEAD.match(s, b).end())
            if not span:
                continue
            english = _EN_NAME.fullmatch(t, *span)
            if s.startswith(("我是", "call ", "contact "), a) and not english:
                continue
            if kind == "surname" and not english and not _surnamed(s, *span) or s[span[0] : span[1]].endswith(LABELS):
                continue
            if s.startswith("故居", span[1]):
                continue
            yield span
            if s.startswith("带队的是", a) and s.startswith("和", span[1]):
                second = _name_at(t, s, span[1] + 1)
                if second:
                    yield second
    for p in contacts:  # "name:number,mail;"
        q = p
        while q and s[q - 1] in ":： ":
            q -= 1
        if q == p or s[q:p].strip(" ") not in (":", "："):
            continue
        lo = _left_run(t, q, lambda c: "㐀" <= c <= "鿿")
        if lo == q:
            m = re.search(f"{_EN_WORD} {_EN_WORD}$", t[_left_run(t, q, lambda c: c in " '-" or c.isalpha() and not "㐀" <= c <= "鿿") : q])
            if m:
                yield q - len(m.group()), q
            continue
        if s[lo:q].endswith(LABELS):
            continue
        if q - lo > 4 or not _CN_NAME.fullmatch(s, lo, q):  # it touches the text before it
            lo = next((q - n for n in (4, 3, 2) if re.match(f"(?:{_COMPOUND})", s[q - n : q]) or n < 4 and s[q - n] in _SURNAMES), q)
        if lo < q:
            yield lo, q


def mentions(text: str | None, simplify: dict[int, int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the mentions of text, in order, not overlapping.
    simplify: traditional to simplified code points, if cues may be in either."""
    if not text:
        return []
    if not _ANCHORS:
        _ANCHORS.append(_Anchors())
    s = shadow(text, simplify or {})
    at = _ANCHORS[0].find(s)
    found: list[tuple[int, int, str]] = [(a, b, "email") for a, b in _emails(s, at.get("email", []))]
    found += [(a, b, k) for k, a, b in _numbers(s, at)]
    found += [(a, b, "address") for a, b in _addresses(text, s, at)]
    contacts = [a for a, _, k in found if k in ("phone", "email")]
    found += [(a, b, "person") for a, b in _persons(text, s, at, contacts)]
    rank = {k: i for i, k in enumerate(KINDS)}
    found.sort(key=lambda x: (rank[x[2]], x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []  # in order, so a mention can only meet its neighbours
    for a, b, k in found:
        i = bisect_left(kept, (a, b, k))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or b <= kept[i][0]):
            insort(kept, (a, b, k))
    return kept


def redact(text: str | None, simplify: dict[int, int] | None = None) -> str | None:
    """text with each mention replaced by its typed placeholder; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in mentions(text, simplify):
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join([*out, text[at:]])


def _mention_column(text, simplify: dict[int, int]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[f"{k}\t{t[a:b]}" for a, b, k in mentions(t, simplify)] if isinstance(t, str) else [] for t in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(text)


def _redacted_column(text, simplify: dict[int, int]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([redact(t, simplify) if isinstance(t, str) else None for t in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text)


def find_mentions(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kind, value): the distinct mentions in the named text fields.

    Null and blank texts have none; a text repeated under one key is read once.
    Columns other than key and fields are ignored."""
    small_batches(df.sparkSession)
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x"))
    long = long.select("key", "x.field", "x.text").where(visible(F.col("text"))).dropDuplicates(["key", "field", "text"])
    found = long.select("key", "field", F.explode(_mention_column(F.col("text"), tables(df.sparkSession).simplify)).alias("m"))
    part = F.split("m", "\t", 2)
    return found.select(F.col("key").alias(key), "field", part[0].alias("kind"), part[1].alias("value")).distinct()


def redacted(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields...): one row per key with redacted texts; of rows that
    differ under one key the latest (updated_at, if there is one) is taken."""
    small_batches(df.sparkSession)
    if "updated_at" in df.columns:
        w = Window.partitionBy(key).orderBy(F.col("updated_at").desc_nulls_last(), *(F.col(f) for f in fields))
        df = df.select(key, "updated_at", *fields).withColumn("nth_version", F.row_number().over(w)).where("nth_version = 1")
    else:
        df = df.select(key, *fields).dropDuplicates([key])
    return df.select(key, *(_redacted_column(F.col(f), tables(df.sparkSession).simplify).alias(f) for f in fields))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return find_mentions(table(spark, sf_dir, "contributions"), "id", ["content", "notes"]).withColumnRenamed("id", "contribution_id")


def p4_redacted(spark, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "contributions"), "id", ["content", "notes"]).withColumnRenamed("id", "contribution_id")


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLE: dict[str, str] = {}
