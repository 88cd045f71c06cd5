"""Broken prompt and response pairs.

Shortened responses: distinct responses are range-partitioned and sorted by text
in an order that puts what goes on within a sentence first, so a response that is
cut short stands right before a version that continues it, if there is any;
comparing neighbours' common prefixes finds it. Length limits: a length at which
unclosed responses pile up far beyond the lengths around it is a limit that cuts
responses off. Both decide where an ending may be either (an abbreviation, a
figure, a full stop that a longer version carries on); a response that ends
without any mark, or in the middle of a quotation, is cut off by itself. Then the
rules for copies of the question, refusals and languages apply. All of it is
JVM-side column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions import strip
from wayspring.llm.han import WIDE_FROM, WIDE_TO, Tables, tables
from wayspring.runtime import materialize, table

# Words that stand for no answer, letters and digits only.
PLACEHOLDERS = ("none", "null", "na", "nan", "nil", "undefined", "empty", "tbd", "todo", "noanswer", "无", "暂无", "空", "待补充", "略", "无内容", "暂无回答", "なし", "keine", "aucun", "ninguno")
# What may stand around a question that is only given back.
ECHOES = ("您的问题是", "你的问题是", "您问的是", "你问的是", "问题是", "问题", "您问", "yourquestion", "yourquestionis", "yourquestionwas", "youasked", "question", "ihrefrage", "ihrefragelautet", "frage", "votrequestion", "supregunta", "ご質問", "ご質問は", "質問")

# Ways to decline, per language: words that are one by themselves, and pairs of words with
# anything but the end of a clause between them.
_REFUSAL_WORDS = (
    "暂不支持|不予(?:讨论|回答|提供|置评)|只能拒绝|拒绝回答|帮不上|没有权限|不在服务范围|没有可以告诉|无从(?:作答|回答)|此类请求",
    "must decline|pass on this|outside (?:of )?(?:what i|my)|beyond what i can|not something i (?:may|can)|against my (?:policy|guidelines)",
)
_REFUSAL_PAIRS = (
    ("无法|不能|不便|没法|没办法|無法|不會|不会|不被允许|不允许|恕难", "，。！？", "回答|作答|解答|提供|说|說|协助|帮|处理|答复|讨论|建议|透露|告诉|评论|给出"),
    ("超出", "，。！？", "能力|范围"),
    ("can(?:no|')t|can not|unable to|not able to|not allowed to|not permitted to|won't be able to|will not be able to|refuse to|decline to", ".!?", "help|answer|assist|share|discuss|provide|say|tell|respond|comment|do"),
    ("(?:kann|darf|möchte)(?:(?!kann|darf|möchte)[^.!?])*?nicht", ".!?", "helfen|beantworten|antworten|auskunft|sagen"), ("nicht", ".!?", "helfen|beantworten"),
    ("ne (?:peux|puis|pouvons)(?: pas)?|impossible de|pas autorisée? à", ".!?", "répondre|aider|fournir|dire|discuter"),
    ("no puedo|no podemos|no estoy autorizad[oa] a|imposible", ".!?", "ayudar|responder|contestar|proporcionar|decir|hablar"),
    ("お答え|対応|回答|ご案内|お手伝い|提供", "。！？", "できません|しかねます|いたしかねます|できかねます|ません"),
)
# The first word of a pair never stands between: the last one before the second decides as well, in linear time.
_REFUSAL = "|".join([*_REFUSAL_WORDS, *(f"(?:{a})(?:(?!{a if '*' not in a else 'nicht'})[^{stop}])*?(?:{b})" for a, stop, b in _REFUSAL_PAIRS)])
_POLITE = "如有|欢迎|祝您|祝你|谢谢|感谢|抱歉|对不起|不好意思|很遗憾|您好|换个|咨询|客服|anything else|have a nice|thank|sorry|hello|apolog|unfortunately|human agent|bon voyage|gute reise|buen viaje|merci|danke|gracias|désol|leid|lo siento|ありがとう|申し訳"
_BUT = "但|不过|资料显示|[0-9０-９]|however|aber|mais|pero"

# Frequent words of four languages written in Latin letters.
_WORDS = {
    "en": "the is a of in to how do i get from where can eat for and what does near worth when reply please at on by was were it has so but or this that we only an be not my you your are with as until which while sorry no yes",
    "fr": "le la les des du est une un pour où quelle comment aller ouvre dans je il ne pas que sur qui se trouve jusqu près depuis et entre avec devant car on si au votre répondre",
    "de": "der die das ist und ein eine nach von wie komme ich zu wo man im es nicht wann hat den dem mit am vor bei so wegen war dauert kann diese sehr noch öffnet",
    "es": "el los las de es y una para cómo llego qué hora abre dónde con por del no al hay desde dura posada muy pero había lleve sin se lo esta",
}
# Requests for an answer in a named language.
_ASKED = {
    "en": "(?:in|into) english|用英[文语]|英語で|auf englisch|en inglés|en anglais",
    "zh": "(?:in|into) chinese|用中文|用汉语|中国語で|auf chinesisch|en chino|en chinois",
    "ja": "(?:in|into) japanese|用日[文语]|日本語で|auf japanisch|en japonés|en japonais",
    "fr": "(?:in|into) french|用法[文语]|フランス語で|auf französisch|en francés|en français",
    "de": "(?:in|into) german|用德[文语]|ドイツ語で|auf deutsch|en alemán|en allemand",
    "es": "(?:in|into) spanish|用西班牙[文语]|スペイン語で|auf spanisch|en español|en espagnol",
}
_TAIL = r"(?:\s*(?:\[\d+\]|（来源[^（）]*）|\((?:source|来源|quelle|fuente)[^()]*\)|</?[a-zA-Z][^<>]*>|[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]|[\s\p{Z}\p{Cf}]))+$"
_CLOSED = r"[。！？.!?～~।][”’」』）)\]\"'»“]*$"
_TRAILS = r"(?:^|[^…])…$|(?:^|[^.])\.\.\.$|[，、；：,;:“‘「『（(«„]$"
# Abbreviations that never, and that may, end a sentence.
_BEFORE = r"(?i)(?:^|[\s(（“\"„«¿])"
_NEVER_LAST = _BEFORE + r"(?:e\.g|i\.e|mt|st|dr|mr|mrs|ms|nr|núm|approx|aprox|ca|env|vs|fig|c\.-à-d|d\. ?h|z\. ?B|bzw|sra?|prof)\.$"
_EITHER = _BEFORE + r"(?:no|etc|co|z|d|p|a|m|EE|EE\. UU|\d{1,4}(?:[.:]\d{1,2})?)\.$"


def _letters(c: Column, han: Tables) -> Column:
    """Letters and digits of a text: half-width, lower case, simplified."""
    old, new = han.traditional
    c = F.translate(F.coalesce(c, F.lit("")), WIDE_FROM + old, WIDE_TO + new)
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"</?[A-Za-z][^<>]*>|&nbsp;", ""), r"[^\p{L}\p{N}]", ""))


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def language(text: Column) -> Column:
    """zh, ja, ko, en, fr, de, es by script and frequent words; null if unsure."""
    t = F.coalesce(text, F.lit(""))
    kana, hangul, han, latin = (_count(t, p) for p in (r"[\x{3040}-\x{30ff}]", r"[\x{ac00}-\x{d7a3}]", r"[\x{4e00}-\x{9fff}]", r"[A-Za-zÀ-ÿ]"))
    words = F.array_distinct(F.split(F.regexp_replace(F.lower(t), r"[^\p{L}\p{M}]+", " "), " "))

    def hits(w: Column) -> Column:  # the most hits; of equals the language named first
        per = (F.struct(F.size(F.array_intersect(w, F.array(*map(F.lit, v.split())))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(_WORDS.items()))
        return F.array_max(F.array(*per))

    best = F.transform(F.array(words), hits)[0]  # binds the words, so they are split once
    known = F.transform(F.array(best), lambda x: F.when(x["n"] > 0, x["k"]))[0]
    return (
        F.when((kana >= 2) & (kana * 8 >= han), "ja")
        .when(hangul * 3 > latin, "ko")
        .when((han > 0) & (han * 6 >= latin), "zh")
        .otherwise(known)
    )


def asked_language(question: Column) -> Column:
    q, out = F.lower(F.coalesce(question, F.lit(""))), F.lit(None).cast("string")
    for k, p in _ASKED.items():
        out = F.when(q.rlike(p), k).otherwise(out)
    return out


_ON = r"\s*[\p{Ll}，、；：,;:”’」』）)]"  # what carries a sentence on
_FIRST = "\x01"  # sorts before every visible character


def shortened(texts: DataFrame) -> DataFrame:
    """Distinct texts (column body) that some longer one continues within a
    sentence: (body).

    In the order used, what carries a sentence on sorts first, so of all texts with
    a common prefix the next neighbour is one that goes on, if any does."""
    spark = texts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = F.regexp_replace("body", f"({_ON})", f"{_FIRST}$1")
    placed = texts.select("body").where(F.length("body") > 0).distinct().select(order.alias("body")).repartitionByRange(n, "body").withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "bodies")
    first = placed.groupBy("part").agg(F.min("body").alias("head"))  # one row per range
    after = first.select("part", F.lead("head").over(Window.orderBy("part")).alias("next_head"))
    near = placed.withColumn("next", F.lead("body").over(Window.partitionBy("part").orderBy("body")))
    near = near.join(F.broadcast(after), "part").select("body", F.coalesce("next", "next_head").alias("next"))
    return near.where(F.col("next").startswith(F.concat("body", F.lit(_FIRST)))).select(F.replace("body", F.lit(_FIRST), F.lit("")).alias("body"))


def length_limits(texts: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """(n_chars): lengths at which unclosed rows of (n_chars, closed) are more than
    the mean of the ten lengths around explains: by `sigmas` times its spread, one
    row more than seen counted in, so that few rows prove nothing."""
    per = texts.where("not closed").groupBy("n_chars").agg(F.count("*").alias("n"))
    around = Window.orderBy("n_chars").rangeBetween(-5, 5)  # one row per length
    near = per.withColumn("others", (F.sum("n").over(around) - F.col("n")) / 10)
    return near.where(F.col("n") > F.col("others") + sigmas * F.sqrt(F.col("others") + 1)).select("n_chars")


def _open(body: Column) -> Column:
    """Whether a text ends without a closing mark, trails off, or ends on what never ends a sentence."""
    return ~body.rlike(_CLOSED) | F.substring(body, -4, 4).rlike(_TRAILS) | body.rlike(_NEVER_LAST)


def defects(history: DataFrame, key: str = "id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(key, defect) of the defective pairs: empty, copy, refusal, language or
    truncated, the first that applies in this order.

    Rows repeated under one key count once; a null or blank answer is empty; a
    null question is no language and no copy. Other columns are ignored."""
    han = tables(history.sparkSession)
    h = history.select(F.col(key), F.col(question).alias("q"), F.col(answer).alias("a"))
    body = F.regexp_replace(strip(F.regexp_replace(F.coalesce("a", F.lit("")), r"</?[A-Za-z][^<>]*>", " ")), _TAIL, "")
    told = h.dropDuplicates([key]).withColumn("body", body)
    told = told.withColumn("either", F.col("body").rlike(_EITHER)).withColumn("open", _open(F.col("body"))).withColumn("n_chars", F.length("body"))
    h = materialize(told, "bodies")  # read three times, cleaned once
    cut = materialize(shortened(h.select("body")).withColumn("cut", F.lit(True)), "cut")  # written, so that the planner knows their size
    # texts that repeat (placeholders, say) count once: they are no sign of a limit
    unclosed = h.where("n_chars > 0 and (open or either)").select("n_chars", "body").distinct().select("n_chars", F.lit(False).alias("closed"))
    limits = materialize(length_limits(unclosed).withColumn("at_limit", F.lit(True)), "limits")
    b = F.col("body")

    def nothing_new(both: Column) -> Column:
        echo = F.replace(both["said"], both["ask"], F.lit(""))
        copy = (F.length(both["ask"]) > 0) & both["said"].contains(both["ask"]) & ((F.length(echo) == 0) | echo.isin(*ECHOES))
        return F.when((F.length(both["said"]) == 0) | both["said"].isin(*PLACEHOLDERS), "empty").when(copy, "copy")

    plain = F.transform(F.array(F.struct(_letters(F.col("q"), han).alias("ask"), _letters(b, han).alias("said"))), nothing_new)[0]
    sentence = F.filter(F.split(F.lower(F.regexp_replace(F.translate(b, "’", "'"), r"([。！？!?]|\.(?=\s|$))", "$1\n")), "\n"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    declines = lambda s: s.rlike(_REFUSAL) & ~s.rlike(_BUT)
    polite = lambda s: s.rlike(_POLITE) & ~s.rlike(_BUT)
    refusal = F.transform(F.array(sentence), lambda x: F.forall(x, lambda s: polite(s) | declines(s)) & F.exists(x, declines))[0]
    both = F.struct(language(F.col("q")).alias("q"), language(b).alias("a"))
    other = F.transform(F.array(both), lambda x: F.coalesce((x["q"] != x["a"]) & ~F.coalesce(asked_language(F.col("q")) == x["a"], F.lit(False)), F.lit(False)))[0]
    odd = lambda p: _count(b, p) % 2 == 1
    more = lambda o, c: _count(b, o) > _count(b, c)
    halved = odd("[“”„]") | odd('"') | more("«", "»") | more("（", "）") | more(r"\(", r"\)") | more("「", "」") | more("『", "』")
    cut_off = F.col("open") | b.rlike('[“”„"«（(「『]') & halved
    kind = F.coalesce(plain, F.when(refusal, "refusal").when(other, "language").when(cut_off, "truncated"))
    h = h.select(key, "body", "n_chars", "either", kind.alias("kind"))
    h = h.join(cut, "body", "left").join(limits, "n_chars", "left")
    late = F.coalesce("cut", F.lit(False)) | F.coalesce(F.col("at_limit") & F.col("either"), F.lit(False))
    return h.select(key, F.coalesce("kind", F.when(late, "truncated")).alias("defect")).where("defect is not null")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "user_history")).select(F.col("id").alias("history_id"), "defect")


QUERIES = {"p2_found": p2_found}
ORACLE: dict[str, str] = {}
