"""Content quality: chunking of entries, near-duplicate search, keywords,
categories, moderation rules and the review of submissions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions import key
from wayspring.functions.text import FORBIDDEN, STOP_CONTENT, category, category_sql, contains_any, keywords, sql_list, tokens, tokens_sql, without
from wayspring.operators.blocks import repeats
from wayspring.operators.retrieval import E_SQL, entries
from wayspring.runtime import small_batches, table

MAX_CHARS, MIN_CHARS, THRESHOLD, LEAST_CHARS = 800, 200, 0.6, 20


# ---------------------------------------------------------------- chunks


class _Packer:
    """Greedy packing of lines; every line is charged one character more."""

    def __init__(self, most: int):
        self.most, self.done, self.open, self.used = most, [], [], 0

    def fits(self, text: str) -> bool:
        return self.used + len(text) + 1 <= self.most

    def close(self) -> None:
        if self.open:
            self.done.append("\n".join(self.open))
        self.open, self.used = [], 0

    def add(self, text: str) -> None:
        if not self.fits(text):
            self.close()
        self.open.append(text)
        self.used += len(text) + 1


def entry_chunks(content: str, most: int = MAX_CHARS, least: int = MIN_CHARS) -> list[str]:
    """Chunks of a text: paragraphs packed up to `most`; a longer paragraph by
    sentences, a longer sentence by characters; a chunk under `least` joins the
    one before unless both exceed one and a half times `most`."""
    if len(content) <= most:
        return [content]
    p = _Packer(most)
    for para in filter(None, map(str.strip, content.split("\n"))):
        if len(para) <= most:
            p.add(para)
            continue
        p.close()
        for sentence in filter(None, map(str.strip, re.split(r"(?<=[。！？；.!?;])", para))):
            if len(sentence) <= most:
                p.add(sentence)
            else:
                p.close()
                p.done += filter(None, (sentence[i : i + most].strip() for i in range(0, len(sentence), most)))
    p.close()
    out: list[str] = []
    for c in p.done:
        if out and len(c) < least and len(out[-1]) + len(c) <= most * 1.5:
            out[-1] = f"{out[-1]}\n{c}"
        else:
            out.append(c)
    return out


def chunked(df: DataFrame, key: str, title: str, content: str, most: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """(key, chunk_id, title, content): chunks numbered from 1 under the key; from
    the second on the title names its part. Blank contents have none."""
    small_batches(df.sparkSession)

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([entry_chunks(t, most, least) if isinstance(t, str) and t.strip() else [] for t in s], dtype=object)

    cut.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    c = df.select(F.col(key), F.coalesce(title, F.lit("")).alias("the_title"), F.pandas_udf(cut, "array<string>")(F.col(content)).alias("parts"))
    c = c.select(key, "the_title", F.posexplode("parts").alias("pos", "content"))
    part = F.when(F.col("pos") > 0, F.concat("the_title", F.lit("（第"), (F.col("pos") + 1).cast("string"), F.lit("部分）"))).otherwise(F.col("the_title"))
    return c.select(key, (F.col("pos") + 1).cast("long").alias("chunk_id"), part.alias("title"), "content")


def chunk_rows(spark, sf_dir: str) -> DataFrame:
    c = chunked(entries(spark, sf_dir), "rid", "title", "content")
    return c.select("rid", "chunk_id", "title", F.length("content").cast("long").alias("n_chars"))


def chunk_counts(spark, sf_dir: str) -> DataFrame:
    """Entries by number of chunks."""
    per = chunk_rows(spark, sf_dir).groupBy("rid").agg(F.count("*").alias("chunks"))
    return per.groupBy("chunks").agg(F.count("*").alias("n"))


def paragraph_stats(spark, sf_dir: str) -> DataFrame:
    """Paragraphs and sentences per entry: what chunking works on."""
    e = entries(spark, sf_dir)
    paras = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), F.trim), lambda p: F.length(p) > 0)
    ends = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("([。！？；.!?;])"), F.lit(1))
    return e.select("rid", F.size(paras).cast("long").alias("paragraphs"), F.size(ends).cast("long").alias("ends"))


# ---------------------------------------------------------------- near duplicates


def content_tokens(title: Column, content: Column) -> Column:
    """Distinct tokens of two characters or more, no stop words."""
    t = without(tokens(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))), STOP_CONTENT)
    return F.array_distinct(F.filter(t, lambda x: F.length(x) >= 2))


def similar_entries(new: DataFrame, old: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, rid, overlap): for each row of new (id, city, toks) the entry of old
    (rid, city, toks) of the same city with the largest overlap coefficient
    |A∩B| / min(|A|, |B|), if at least threshold; ties: the smaller rid. If old has
    `own` (array<string>), rows whose id is in it are not compared with it.

    Exact prefix filter: whichever set is smaller must meet the other in its
    rarest |A| - ceil(threshold |A|) + 1 tokens, so only those are joined, once
    from each side. Empty sets match nothing."""
    a = new.where(F.size("toks") > 0).select("id", "city", F.col("toks").alias("x"))
    own = F.col("own") if "own" in old.columns else F.array().cast("array<string>")
    b = old.where(F.size("toks") > 0).select("rid", "city", F.col("toks").alias("y"), own.alias("own"))
    ea, eb = a.select("id", "city", F.explode("x").alias("t")), b.select("rid", "city", F.explode("y").alias("t"))
    df = ea.select("city", "t").unionByName(eb.select("city", "t")).groupBy("city", "t").agg(F.count("*").alias("df"))

    def prefix(e: DataFrame, key: str) -> DataFrame:
        o = e.join(df, ["city", "t"]).groupBy(key, "city").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o"))
        n = F.size("o")
        keep = (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
        return o.select(key, "city", F.explode(F.transform(F.slice("o", F.lit(1), keep), lambda s: s["t"])).alias("t"))

    pairs = prefix(ea, "id").join(eb, ["city", "t"]).select("id", "rid").unionByName(ea.join(prefix(eb, "rid"), ["city", "t"]).select("id", "rid")).distinct()
    both = pairs.join(a.select("id", "x"), "id").join(b.select("rid", "y", "own"), "rid").where(~F.array_contains("own", key(F.col("id").cast("string"))) | F.col("id").isNull())
    overlap = F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y"))
    hit = both.select("id", "rid", F.round(overlap, 6).alias("overlap")).where(F.col("overlap") >= threshold)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("overlap").desc(), "rid"))
    return hit.withColumn("n", best).where("n = 1").select("id", "rid", "overlap")


def _submissions(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "contributions").select("id", "city", "title", "content", "category", "file_name", "source").dropDuplicates(["id"])


def near_dup(spark, sf_dir: str) -> DataFrame:
    """Submissions that repeat an entry of their city other than their own."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))).alias("text")
    own = F.filter(F.array(key(F.col("id")), key(F.col("submission_id"))), lambda k: k.isNotNull())
    new = _submissions(spark, sf_dir).select("id", key(F.col("id").cast("string")).alias("own_key"), "city", text)
    old = entries(spark, sf_dir).where("rid is not null").select("rid", own.alias("own"), "city", text)
    return repeats(new, old, THRESHOLD, tuple(STOP_CONTENT))


def keywords_top10(spark, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.select("rid", F.array_join(keywords(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))), ",").alias("keywords"))


def category_rules(spark, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("rid", category(F.col("title"), F.col("content")).alias("category"))


def moderation(city: Column, content: Column) -> Column:
    """The first rule a submission fails, or null."""
    text = F.trim(F.coalesce(content, F.lit("")))
    return (
        F.when(F.length(F.trim(F.coalesce(city, F.lit("")))) == 0, "no_city").when(F.length(text) == 0, "no_content")
        .when(contains_any(text, FORBIDDEN), "forbidden").when(F.length(text) < LEAST_CHARS, "too_short")
    )


def moderation_rules(spark, sf_dir: str) -> DataFrame:
    s = _submissions(spark, sf_dir)
    return s.select("id", F.coalesce(moderation(F.col("city"), F.col("content")), F.lit("ok")).alias("rule"))


def review(spark, sf_dir: str) -> DataFrame:
    """Outcome of every submission: rules, then near-duplicates, else approved with
    its category and number of chunks."""
    s = _submissions(spark, sf_dir)
    rule = moderation(F.col("city"), F.col("content"))
    dup = near_dup(spark, sf_dir).select("id", F.col("rid").alias("repeats"))
    n = chunked(s, "id", "title", "content").groupBy("id").agg(F.count("*").alias("chunks"))
    j = s.withColumn("rule", rule).join(dup, "id", "left").join(n, "id", "left")
    ok = F.col("rule").isNull() & F.col("repeats").isNull()
    cat = F.when(F.length(F.coalesce("category", F.lit(""))) > 0, F.col("category")).otherwise(category(F.col("title"), F.col("content")))
    return j.select("id", F.when(ok, "approved").otherwise("rejected").alias("status"), F.coalesce("rule", F.when(F.col("repeats").isNotNull(), "duplicate"), F.lit("ok")).alias("reason"), F.when(ok, cat).alias("category"), F.when(ok, F.col("chunks")).alias("chunks"))


def review_outcomes(spark, sf_dir: str) -> DataFrame:
    return review(spark, sf_dir).groupBy("status", "reason").agg(F.count("*").alias("n"))


QUERIES = {
    "chunk_rows": chunk_rows, "chunk_counts": chunk_counts, "paragraph_stats": paragraph_stats, "near_dup": near_dup, "keywords_top10": keywords_top10,
    "category_rules": category_rules, "moderation_rules": moderation_rules, "review_outcomes": review_outcomes,
}

SUB = "sub as (select id, any_value(city) as city, any_value(title) as title, any_value(content) as content, any_value(category) as category from contributions group by id)"
_TOK = "list_distinct(list_filter({0}, lambda t: length(t) >= 2 and t not in {1}))".format(tokens_sql("coalesce(title, '') || ' ' || coalesce(content, '')"), sql_list(STOP_CONTENT))
_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '', 'g')), '')"
_NEAR = f"""a as (select id, city, {_TOK} as x from sub), b as (select rid, city, {_TOK} as y from e),
keys as (select rid, any_value({_KEY.format('id')}) as k1, any_value({_KEY.format('submission_id')}) as k2 from knowledge_entries group by rid),
o as (select id, rid, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) as overlap from a join b using (city) join keys using (rid)
  where len(x) > 0 and len(y) > 0 and k1 is distinct from {_KEY.format('a.id')} and k2 is distinct from {_KEY.format('a.id')}),
near as (select id, rid, overlap from (select *, row_number() over (partition by id order by overlap desc, rid) as n from o where overlap >= {THRESHOLD}) where n = 1)"""
_RULE = f"""case when length(trim(coalesce(city, ''), ' ')) = 0 then 'no_city' when length(trim(coalesce(content, ''), ' ')) = 0 then 'no_content'
when regexp_matches(content, '{"|".join(FORBIDDEN)}') then 'forbidden' when length(trim(content, ' ')) < {LEAST_CHARS} then 'too_short' end"""
ORACLE = {
    "paragraph_stats": f"with {E_SQL} select rid, len(list_filter(string_split(coalesce(content, ''), chr(10)), lambda p: length(trim(p, ' ')) > 0)) as paragraphs, len(regexp_extract_all(coalesce(content, ''), '[。！？；.!?;]')) as ends from e",
    "near_dup": f"with {E_SQL}, {SUB}, {_NEAR} select * from near",
    "keywords_top10": f"""with {E_SQL}, t as (select rid, {tokens_sql("coalesce(title, '') || ' ' || coalesce(content, '')")} as toks from e),
u as (select rid, unnest(toks) as t, generate_subscripts(toks, 1) as i from t), f as (select rid, t, min(i) as i from u where length(t) > 1 and t not in {sql_list(STOP_CONTENT)} group by 1, 2),
r as (select *, row_number() over (partition by rid order by i) as n from f)
select e.rid, coalesce(string_agg(t, ',' order by i), '') as keywords from e left join (select * from r where n <= 10) r using (rid) group by 1""",
    "category_rules": f"with {E_SQL} select rid, {category_sql('title', 'content')} as category from e",
    "moderation_rules": f"with {SUB} select id, coalesce({_RULE}, 'ok') as rule from sub",
    "review_outcomes": f"""with {E_SQL}, {SUB}, {_NEAR}, j as (select sub.id, {_RULE} as rule, near.rid from sub left join near using (id))
select case when rule is null and rid is null then 'approved' else 'rejected' end as status, coalesce(rule, case when rid is not null then 'duplicate' end, 'ok') as reason, count(*) as n from j group by 1, 2""",
}
