"""Tokens, stop lists, search text, keywords and categories as column expressions,
each next to the SQL text of the same computation for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the full-text channel.
STOP_FULLTEXT = (
    "的 了 是 在 和 与 及 或 而 之 也 都 很 更 最 不 没 有 个 我 你 他 她 它 这 那 哪 等 吧 吗 呢 啊 哦 从 对 到 为 于 以 把 被 让 给 向 由 并 且 但 却 又 就 才 只 还 请 "
    "问 想 要 什么 怎么 如何 哪里 多少 可以 需要 请问 一下"
).split()
# Stop words of the keyword channel.
STOP_KEYWORD = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这".split()
# Stop words of duplicate detection and keyword extraction.
STOP_CONTENT = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 里 于 为 从 以 但 呢 啊 吧 我们 他们 它们".split()
# Words that make a question a comparison.
COMPARISON = ("对比", "比较", "不同", "区别", "哪个更", "还是")
# Category rules in order, the first that matches wins.
CATEGORIES = (
    ("美食", "火锅 餐厅 美食 小吃 酒店 住宿 早餐 晚餐".split()),
    ("交通", "地铁 火车 高铁 公交 机场 交通 租车 路线 打车".split()),
    ("景点", "景点 博物馆 公园 长城 故宫 寺庙 山 水 游玩 攻略".split()),
    ("行程", "行程 游玩 三天 攻略 路线 景点 推荐".split()),
)
# Words that reject a submission.
FORBIDDEN = "黄赌毒 赌博 色情 违法 暴力 攻击 危害 诈骗 非法".split()

RUNS = r"[\x{4e00}-\x{9fff}]+|[a-z0-9]+"


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def tokens(text: Column) -> Column:
    """array<string>: lower-case words of Latin letters and digits, and all pairs
    of neighbouring characters of Chinese runs (a lone character stands alone),
    in order, repeats kept. Null gives the empty array. Any tokenizer that yields
    array<string> can take its place in the operators."""

    def pairs(run: Column) -> Column:
        alone = run.rlike("^[a-z0-9]") | (F.length(run) == 1)
        return F.when(alone, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({RUNS})"), F.lit(1)), pairs))


def tokens_sql(text: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '{RUNS}'), lambda r: "
        "case when regexp_matches(r, '^[a-z0-9]') or length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) end))"
    )


def without(tokens_: Column, words) -> Column:
    stop = F.array(*map(F.lit, words))
    return F.filter(tokens_, lambda t: ~F.array_contains(stop, t))


def search_text(title="title", content="content", keywords="keywords", category="category", sub_category="sub_category") -> Column:
    """Title, content, keywords and categories, empty ones left out, one space between."""
    keep = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws(" ", keep(F.col(title)), keep(F.col(content)), keep(F.array_join(keywords, " ")), keep(F.col(category)), keep(F.col(sub_category)))


SEARCH_TEXT_SQL = (
    "concat_ws(' ', nullif(title, ''), nullif(content, ''), nullif(array_to_string(list_filter(keywords, lambda k: k is not null), ' '), ''), nullif(category, ''), nullif(sub_category, ''))"
)


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def category(title: Column, content: Column, fallback: str = "其他") -> Column:
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    out = F.lit(fallback)
    for name, words in reversed(CATEGORIES):
        out = F.when(contains_any(t, words), name).otherwise(out)
    return out


def category_sql(title: str, content: str, fallback: str = "其他") -> str:
    t = f"lower(coalesce({title}, '') || ' ' || coalesce({content}, ''))"
    return "case " + " ".join(f"when regexp_matches({t}, '{'|'.join(words)}') then '{name}'" for name, words in CATEGORIES) + f" else '{fallback}' end"


def keywords(text: Column, most: int = 10) -> Column:
    """The first `most` distinct tokens of two characters or more, no stop words."""
    good = F.filter(without(tokens(text), STOP_CONTENT), lambda t: F.length(t) > 1)
    return F.slice(F.array_distinct(good), 1, most)


def slug(text: Column) -> Column:
    """Lower case, anything but letters, digits and Chinese as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "_"), r"^_+|_+$", "")
