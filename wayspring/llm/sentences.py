"""Sentence boundaries across languages and scripts.

A text is read in blocks: a heading or list item on its own line is a unit, a
line break inside a hard-wrapped paragraph is a space, any other line end
closes the block. In a block, spaced scripts (and scripts with full stops of
their own) are cut by a lattice of terminators: quotations and brackets are
paired first, then every terminator is judged by what stands before it
(abbreviations, initials, ordinals, decimals) and after it (case, attribution
of a quotation). Scripts that use neither spaces between words nor full stops
are segmented by a word lattice over a small dictionary, and each gap is
classified through the final word before it and the opening word behind it; so
are the blanks of Chinese and Japanese blocks without full stops, where a gap
without either word counts if both sides are as long as a clause.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspring.runtime import small_batches, table

_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
_BULLET = re.compile(r"\s*(?:[-*•·●○▪‣–]\s+|#{1,6}\s|\d{1,3}[.)]\s+|\d{1,3}、|[一二三四五六七八九十]{1,3}、|[（(]\d{1,3}[)）]\s*|[①-⑳])")
_NUMBER_BULLET = re.compile(r"\s*\d{1,3}[.)]\s")
_TERMINATOR = re.compile("[。！？!?｡।॥…؟။។៕።۔།༎]+|\\.+")  # the last: Burmese, Khmer, Ethiopic, Urdu, Tibetan
_CJK = "㐀-䶿一-鿿豈-﫿々぀-ヿ"
_IS_CJK = re.compile(f"[{_CJK}]")
_IS_THAI = re.compile("[฀-๿]")
_DEVANAGARI = re.compile("[ऀ-ॿ]")
_SENTENCE_END = re.compile(f"[。！？!?｡।॥….؟～:：။។៕።۔།༎][”’」』）)\\]\"'»“]*$")
_CONTINUES = re.compile("[,，、;；\\-]$")
_OPENS = re.compile(f"[{_CJK}“「『（《A-Z]")
_CLAUSE = 7  # characters: the least on both sides of a space between unpunctuated sentences
_STRONG = re.compile("[。！？!?…\n]")
_AFTERTHOUGHT = 7  # characters: a shorter clause behind an ellipsis belongs to the sentence before it
_CLOSERS = "”’」』）)]\"»"
_PAIRS = {"“": "”", "„": "“”", "‘": "’", "「": "」", "『": "』", "«": "»", "（": "）", "(": ")", "《": "》", "【": "】", "[": "]"}
_BRACKETS = "（([【《"

# Abbreviations that never, and that may, end a sentence.
_NEVER = frozenset(
    "mt st dr mr mrs ms mme mlle mm prof sra sr srta dª nr no nos núm num art fig figs ca approx env aprox vs e.g i.e eg ie c.-à-d p.ej cf "
    "gov sen rep pres supt bzw av avda ave tel vol pp gen rev hon capt lt col sgt dept est ed eds jan feb mar apr jun jul aug sep sept oct nov dec abb str "
    "hr fr hrn co ee z.b d.h u.a v.a s.o min max inkl exkl ggf evtl sog bd pág cap ej".split()
)
_MAYBE = frozenset("etc a.m p.m am pm u.k u.n e.u d.c ltd inc soc corp usw uu u.s jr bros llc plc gmbh usf km cm kg".split())
# Initialisms that end a sentence only before a word that opens one.
_INITIALISMS = frozenset("u.s u.k u.n e.u d.c".split())
_OPENERS = re.compile(r"\s+(?:The|This|That|These|Those|There|It|He|She|We|They|I|You|But|And|In|On|At|A|An|After|Before|When|If|As|No|Our|My|His|Her|Their|So|Then|For|To|From|With)\b")
_ORDINAL_LEAD = frozenset("am vom zum bis dem den der jeden jeder jedem im ab seit beim des die das".split())
_MONTH_OR_DAY = re.compile(r"\s+(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez|Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonn|Jahrhundert|Stock|Etage|Klasse)")

# Clauses that attribute a quotation standing before them.
_ZH_SAYS = re.compile(f"(?!听说|据说|你知道)(?:[{_CJK}]{{0,8}}?)(?:我问|他问|她问|问道|说道|喊道|答道|叫道|笑道|这样安排|這樣安排|这样说|這樣說|(?:老人|孩子|工|主|员|人|婆|台|机|他|她|我|爷|妈|师傅|导游)(?:[^，。！？]{{0,3}})?(?:说|說|问|問|喊|答|道|提醒|告诉|安排|叮嘱|回答))(?!道?[：:])")
_JA_SAYS = re.compile("と|って|という|など|の|は|が|を|に|で")
_KO_SAYS = re.compile("라고|이라고|하고|라는|고 ")
_HI_SAYS = re.compile("[^।!?]*(?:पूछा|कहा|बोला|बोली|बताया|चिल्लाया)")

# Thai dictionary of the word lattice, with the roles of its words.
_TH_OPEN = (
    "เจ้าของ แนะนำ ตั๋ว รถบัส รถไฟ รถ ตลาด พิพิธภัณฑ์ ฝน ห้องพัก ห้อง ระยะทาง อาหาร โรงแรม ร้าน วัด สถานี เรา ฉัน ผม คุณ เขา ที่นี่ วันนี้ เมื่อ ถ้า ควร ทะเลสาบ สะพาน เส้นทาง ทาง นักท่องเที่ยว ค่า เปิด ปิด ไม่ควร อย่า เวลา "
    "แต่ว่า อย่างไรก็ตาม นอกจากนี้ ดังนั้น เพราะฉะนั้น หลังจาก หลังจากนั้น ก่อนอื่น จากนั้น ต่อมา สุดท้าย ขณะที่ แม้ว่า หาก หากว่า พวกเขา พวกเรา เธอ มัน นี่ นั่น พรุ่งนี้ เมื่อวาน ตอนนี้ ตอนเช้า ตอนเย็น โปรด กรุณา ทุกคน ใคร ทำไม"
).split()
_TH_FINAL = (
    "ครับ ค่ะ คะ นะ จ้ะ แล้ว ได้ ตก ร่ม มากมาย สงบ ทุกวัน กิโลเมตร นาที ต่อคน คน เลย มาก บาท ชั่วโมง เมตร โมง "
    "นะคะ นะครับ จ้า จ๊ะ สิ ล่ะ ด้วย ไหม มั้ย หรือเปล่า หรือยัง เท่านั้น เสมอ วัน ปี เดือน คืน ชั้น"
).split()
_TH_JOIN = (
    "และ หรือ แต่ ที่ ซึ่ง เพราะ โดย กับ ของ จาก ถึง ใน ราคา จึง ก็ ว่า เพื่อ ตั้งแต่ จนถึง ออก ประมาณ "
    "ทั้ง เช่น ต่อ ตาม บน ใต้ เหนือ ระหว่าง สำหรับ รวมถึง ไปยัง เป็น คือ จะ ต้อง กำลัง ได้แก่"
).split()
# The same for Chinese and Japanese.
_CJ_OPEN = "我 你 他 她 它 我们 你们 他们 她们 咱们 这 那 这里 那里 这个 那个 今天 明天 昨天 后来 然后 最后 如果 要是 虽然 因为 所以 但是 不过 可是 建议 记得 从 第 わたし 私 僕 彼 彼女 これ それ あれ ここ そこ この その また でも しかし だから 今日 明日 昨日".split()
_CJ_FINAL = "了 吗 呢 吧 啊 呀 嘛 哦 啦 喽 哟 です ます でした ました ません だった だ よ ね か わ ください でしょう だろう".split()
_CJ_JOIN = "的 和 与 及 或 在 把 被 对 向 是 有 也 都 は が を に で と も の へ や から まで より".split()


class Lexicon:
    """Words of a spaceless script with the roles that classify gaps."""

    def __init__(self, opening, final, joining):
        self.opening, self.final, self.joining = frozenset(opening), frozenset(final), frozenset(joining)
        self.words = self.opening | self.final | self.joining
        self.longest = max(map(len, self.words))


THAI, CHINESE_JAPANESE = Lexicon(_TH_OPEN, _TH_FINAL, _TH_JOIN), Lexicon(_CJ_OPEN, _CJ_FINAL, _CJ_JOIN)


def _word_lattice(s: str, lexicon: Lexicon = THAI) -> list[str]:
    """The words of s on the path through the dictionary lattice that leaves the
    fewest characters unknown, then has the fewest words."""
    n = len(s)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(n + 1, 0, 0)] * n
    for i in range(n):
        miss, words, _ = best[i]
        if (c := (miss + 1, words + 1, i)) < best[i + 1]:
            best[i + 1] = c
        for k in range(1, min(lexicon.longest, n - i) + 1):
            if s[i : i + k] in lexicon.words and (c := (miss, words + 1, i)) < best[i + k]:
                best[i + k] = c
    out, i = [], n
    while i:
        out.append(s[best[i][2] : i])
        i = best[i][2]
    return out[::-1]


def _thai_gap(left: str, right: str) -> bool:
    """Whether the gap between two unbroken runs of Thai text ends a sentence."""
    if left[-1] == "ๆ" or left[-1].isdigit() or right[0].isdigit():
        return False
    if not _IS_THAI.match(left[-1]) and left[-1].isalnum() and not _SENTENCE_END.search(left):
        return False
    if not _IS_THAI.match(right[0]):
        return right[0].isupper() or bool(re.match(r"[“\"«¿¡（(「《]", right)) or bool(_IS_CJK.match(right[0]))
    sure = _by_words(left, right, THAI)
    return len(left) > 3 if sure is None else sure


def _by_words(left: str, right: str, lexicon: Lexicon) -> bool | None:
    """Whether the words at a gap make it a sentence's end; null if they don't tell."""
    tail, head = _word_lattice(left, lexicon)[-1], _word_lattice(right, lexicon)[0]
    if head in lexicon.joining and tail not in lexicon.final:
        return False
    if tail in lexicon.joining and head not in lexicon.opening:
        return False
    if head in lexicon.opening or tail in lexicon.final:
        return True
    return None


def _bare_gap(left: str, right: str, said: int) -> bool:
    """The same for a Chinese or Japanese block without full stops; said: length of
    the sentence before the gap."""
    if not _IS_CJK.search(left[-6:]) or not _OPENS.match(right) or left[-1] in "，、；：,;:":
        return False
    if _IS_CJK.match(left[-1]) and _IS_CJK.match(right[0]):
        sure = _by_words(left, right, CHINESE_JAPANESE)
        if sure is not None and (sure or min(said, len(right)) < _CLAUSE):
            return sure
    return said >= _CLAUSE and len(right) >= _CLAUSE


def _enclosed(t: str) -> list[tuple[int, int]]:
    """Outermost (open, close) positions of the quotations and brackets of t."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    straight = [m.start() for m in re.finditer('"', t)]
    straight_open = {p: q for p, q in zip(straight[::2], straight[1::2])}
    straight_close = {q: p for p, q in straight_open.items()}
    for m in re.finditer("[“”„‘’「」『』«»（）()《》【】\\[\\]\"]", t):
        c, p = m.group(), m.start()
        if c == '"':
            if p in straight_open:
                stack.append(('"', p))
            elif p in straight_close:
                while stack:
                    o, at = stack.pop()
                    if o == '"':
                        if not any(a == '"' for a, _ in stack):
                            out.append((at, p))
                        break
            continue
        for k in range(len(stack) - 1, -1, -1):
            if c in _PAIRS.get(stack[k][0], ""):
                out.append((stack[k][1], p))
                del stack[k:]
                break
        else:
            if c in _PAIRS and not (c == "‘" and p and t[p - 1].isalnum() and not _IS_CJK.match(t[p - 1])):
                stack.append((c, p))
    out.sort(key=lambda x: (x[0], -x[1]))
    top: list[tuple[int, int]] = []
    for a, b in out:
        if not top or a > top[-1][1]:
            top.append((a, b))
    return top


_GAP, _RUN = re.compile(r"\s+"), re.compile(r"\S+")


def _run_start(t: str, p: int, lo: int) -> int:
    """Where the unbroken run that ends at p begins, not before lo."""
    while p > lo and not t[p - 1].isspace():
        p -= 1
    return p


def _next_visible(t: str, p: int) -> int:
    while p < len(t) and t[p].isspace():
        p += 1
    return p


def _lower(t: str, p: int) -> bool:
    """Whether a lower-case word begins at p; a letter stuck to CJK text is none."""
    return p < len(t) and t[p].islower() and not _IS_CJK.search(t, p, p + 4)


def _dot_ends(t: str, p: int, start: int = 0) -> bool:
    """Whether the single full stop at t[p] ends the sentence begun at start."""
    q = p + 1
    before = t[p - 1] if p else " "
    if _DEVANAGARI.match(before):
        return False
    if q < len(t) and t[q] in _CLOSERS:
        while q < len(t) and t[q] in _CLOSERS:
            q += 1
        n = _next_visible(t, q)
        return n >= len(t) or not (_lower(t, n) or t[n] in ",，;:、")
    i = p
    while i > start and not t[i - 1].isspace() and t[i - 1] not in "(（“\"„«[。！？，；：、”」』）…～" and not _IS_CJK.match(t[i - 1]):
        i -= 1
    token = t[i:p]
    word = unicodedata.normalize("NFC", re.sub("^[^\\w]+", "", token).lower())
    if q >= len(t):
        return True
    nxt = t[q]
    if not nxt.isspace():
        if nxt.isdigit() or nxt in "/,;:-_@、，。！？!?)）":
            return False
        if _IS_CJK.match(nxt) or _IS_THAI.match(nxt):
            return not (word in _NEVER or before.isdigit() and len(token) <= 2 or not before.isalnum() or bool(_IS_CJK.match(before)))
        if nxt.isupper():
            if re.search(r"(?:www|https?|[/@])", token) or word in _NEVER or "." in token.strip("."):
                return "." in token and word in ("a.m", "p.m")
            return before.isdigit() or len(word) > 1 and (before.islower() or not before.isascii())
        return nxt in "“\"«¿¡„「（(《—" or not nxt.isalnum() and not nxt.isascii()
    n = _next_visible(t, q)
    if n >= len(t):
        return True
    if _lower(t, n):
        return False
    if t[n] in "—–-" and n + 1 < len(t) and t[n + 1].islower():
        return False
    if word in _NEVER:
        return False
    if len(word) == 1 and word.isalpha() and word.isascii():
        return False
    if re.fullmatch(r"[a-zà-ÿ](?:\.[a-zà-ÿ])+", word) and word not in _MAYBE:
        return False
    if token.isdigit() and len(token) <= 2:
        j = i
        while j and t[j - 1].isspace():
            j -= 1
        if _MONTH_OR_DAY.match(t, q) or t[_run_start(t, j, 0) : j].lower() in _ORDINAL_LEAD:
            return False
    if word in _INITIALISMS and not _OPENERS.match(t, q):
        return False
    if t[n] in "0123456789" and word in _MAYBE:
        return False
    return True


def _ellipsis_ends(t: str, q: int) -> bool:
    """Whether an ellipsis before t[q] ends a sentence: it does before a line's
    end or a capital, and in spaceless scripts before a quotation or a clause
    long enough to be a sentence, not before a short afterthought."""
    while q < len(t) and t[q] in _CLOSERS:
        q += 1
    n = _next_visible(t, q)
    if n >= len(t) or n > q and t[n].isupper():
        return True
    if not _IS_CJK.match(t[q - 1 - (t[q - 1] in _CLOSERS)]) and t[q - 1] != "…":
        return False
    if t[n] in "“「『（《":
        return True
    if t[n] in "，、,；;：" or _lower(t, n):
        return False
    stop = _STRONG.search(t, n)
    clause = t[n : stop.start() if stop else len(t)]
    return len(clause) >= _AFTERTHOUGHT - (not re.search("[぀-ヿ]", clause))


def _quote_ends(t: str, start: int, a: int, b: int) -> bool:
    """Whether a quotation or bracket t[a..b] that holds a terminator right
    before its end closes the sentence begun at start."""
    q = b + 1
    n = _next_visible(t, q)
    if n >= len(t):
        return True
    c = t[n]
    if c in ",，、;；:：.。！？!?।…" or _lower(t, n):
        return False
    if c in "—–-" and n + 1 < len(t) and (t[n + 1].islower() or t[n + 1].isspace()):
        return False
    whole = a == start
    lead = t[start:a].rstrip()
    if t[a] in _BRACKETS:
        return whole or lead.endswith(("，", ",")) and t[b - 1] in "。！？"
    if not whole and not lead.endswith(("，", ",")):
        if lead.endswith(("：", ":")):
            return not (_JA_SAYS.match(t, n) and re.search("[぀-ヿ]", t[n : n + 12]) and t[a] in "「『")
        return n > q and not (_IS_CJK.match(c) or _DEVANAGARI.match(c))
    if t[a] in "「『":
        return not _JA_SAYS.match(t, n)
    if _IS_CJK.match(c):
        return not _ZH_SAYS.match(t, n)
    if "가" <= c <= "힣":
        return n > q or not _KO_SAYS.match(t, n)
    if _DEVANAGARI.match(c):
        return not _HI_SAYS.match(t, n)
    return True


def _cut(t: str) -> list[int]:
    """Ends of the sentences of a block, the last one's excepted."""
    pairs = _enclosed(t)
    thai = bool(_IS_THAI.search(t))
    bare = not thai and bool(_IS_CJK.search(t)) and not re.search("[。！？｡]", re.sub("[“‘（《「][^”’）》」]*[”’）》」]", "", t))
    marks = [(m.start(), m.end(), m.group()) for m in _TERMINATOR.finditer(t)]
    ends: list[int] = []
    start = _next_visible(t, 0)
    k = 0

    def gaps(lo: int, hi: int) -> None:
        nonlocal start
        if not thai and not bare:
            return
        for m in _GAP.finditer(t, lo, hi):
            p, q = m.span()
            if p <= start or q >= len(t):
                continue
            left, right = t[_run_start(t, p, start) : p], _RUN.match(t, q).group()
            if bare and _bare_gap(left, right, p - start) or thai and _IS_THAI.search(left + right) and _thai_gap(left, right):
                ends.append(p)
                start = q

    at = 0
    i = 0
    while i < len(marks):
        p, q, mark = marks[i]
        i += 1
        if p < at:
            continue
        gaps(at, p)
        at = q
        while k < len(pairs) and pairs[k][1] < p:
            k += 1
        if k < len(pairs) and pairs[k][0] < p < pairs[k][1]:
            a, b = pairs[k]
            inner = t[p:b]
            if inner.strip("  　" + _CLOSERS).strip("。！？!?｡।॥….؟～။។៕።۔།༎") == "":
                if mark == "." and p and _DEVANAGARI.match(t[p - 1]):
                    continue
                e = b + 1
                while e < len(t) and t[e] in "。！？!?।" + _CLOSERS.replace('"', ""):
                    e += 1
                if e > b + 1 and t[e - 1] in "。！？!?।":
                    done = True
                else:
                    done = _quote_ends(t, start, a, e - 1)
                at = max(at, e)
                if done:
                    ends.append(e)
                    start = _next_visible(t, e)
            continue
        if set(mark) <= {"…", "."} and (len(mark) > 1 or mark == "…"):
            done = _ellipsis_ends(t, q)
        elif mark == ".":
            done = _dot_ends(t, p, start)
        else:
            while q < len(t) and t[q] == ".":
                q += 1
            n = _next_visible(t, q)
            done = True
            if n < len(t):
                if mark[-1] in "!?" and _lower(t, n) or t[n] in ",，、;；":
                    done = False
                elif t[n] in "—–-" and n + 1 < len(t) and t[n + 1].islower():
                    done = False
        if done:
            e = q
            while e < len(t) and (t[e] in _CLOSERS and t[e] != '"' or t[e] in "。！？!?"):
                e += 1
            at = max(at, e)
            ends.append(e)
            start = _next_visible(t, e)
    gaps(at, len(t))
    return ends


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, unit) of the blocks of text; a unit is never cut."""
    lines: list[tuple[int, int]] = []
    at = 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    group: list[tuple[int, int]] = []

    def flush() -> Iterator[tuple[int, int, bool]]:
        if not group:
            return
        bodies = [text[a:b].strip() for a, b in group]
        widest = max(map(len, bodies))
        full = []
        for k in range(len(group) - 1):
            first = bodies[k + 1].split(None, 1)[0]
            full.append(len(bodies[k]) + 1 + len(first) > widest)
        spaced = [not _IS_CJK.search(x[-2:]) and not _IS_THAI.search(x[-2:]) for x in bodies]
        plain = [k for k in range(len(full)) if spaced[k] and not _BULLET.match(bodies[k])]
        wrapped = widest >= 45 and bool(plain) and sum(full[k] for k in plain) >= 0.5 * len(plain)
        start = group[0][0]
        unit = bool(_BULLET.match(bodies[0]))
        for k in range(len(group) - 1):
            a, b = bodies[k], bodies[k + 1]
            bullet = bool(_BULLET.match(b))
            flows = spaced[k] and (wrapped and full[k] or b[0].islower() and len(a) >= 30)
            if bullet and flows and _NUMBER_BULLET.match(b) and not _SENTENCE_END.search(a):
                bullet = False
            if unit or bullet:
                join = False
            elif flows:
                join = True
            else:
                join = bool(_CONTINUES.search(a)) and not _SENTENCE_END.search(a)
            if not join:
                yield start, group[k][1], unit
                start, unit = group[k + 1][0], bullet
        yield start, group[-1][1], unit

    for a, b in lines:
        if text[a:b].strip():
            group.append((a, b))
        else:
            yield from flush()
            group = []
    yield from flush()


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """[start, end) of the sentences of text in code points, in order, without
    outer white space. Null and blank texts have none."""
    out: list[tuple[int, int]] = []
    if not text:
        return out

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for a, b, unit in _blocks(text):
        if unit:
            add(a, b)
            continue
        at = a
        for e in _cut(text[a:b]):
            add(at, a + e)
            at = a + e
        add(at, b)
    return out


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos): the sentences of every row. Null and blank
    texts have no rows; repeated rows repeat theirs; other columns are ignored."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[x for span in sentence_spans(t) for x in span] if isinstance(t, str) else [] for t in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    flat = df.select(F.col(key), F.pandas_udf(run, "array<int>").asNondeterministic()(F.col(text)).alias("s"))  # else the filter evaluates it again
    spans = F.transform(F.sequence(F.lit(0), (F.size("s") / 2 - 1).cast("int")), lambda i: F.struct(F.get("s", (i * 2).cast("int")).alias("a"), F.get("s", (i * 2 + 1).cast("int")).alias("b")))
    one = flat.where(F.size("s") > 0).select(key, F.explode(spans).alias("x"))
    return one.select(key, F.col("x.a").cast("long").alias("start_pos"), F.col("x.b").cast("long").alias("end_pos"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found}
ORACLE: dict[str, str] = {}
