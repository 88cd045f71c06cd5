"""Session, message and history analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions import key, micros, moment, visible
from wayspring.runtime import table

RECENT, LAST_HISTORY, TTL_DAYS = 6, 20, 30


def messages(spark, sf_dir: str) -> DataFrame:
    """Distinct messages: (id, session_id, role, content, city, at)."""
    m = table(spark, sf_dir, "messages")
    return m.select("id", key(F.col("session_id")).alias("session_id"), "role", "content", F.col("detected_city").alias("city"), moment(F.col("created_at")).alias("at")).where("session_id is not null").distinct()


def sessions(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sessions")
    return s.select(key(F.col("session_id")).alias("session_id"), key(F.col("user_id")).alias("user_id"), "last_city", micros(F.col("updated_at")).alias("updated")).distinct()


def history(spark, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "user_history")
    return h.select("id", key(F.col("user_id")).alias("user_id"), "question", "answer", "detected_city", micros(F.col("created_at")).alias("at")).distinct()


def recent_messages(spark, sf_dir: str) -> DataFrame:
    """The last six messages of every session, in order."""
    w = Window.partitionBy("session_id").orderBy(F.col("at").desc_nulls_last(), F.col("id").desc())
    top = messages(spark, sf_dir).withColumn("back", F.row_number().over(w)).where(F.col("back") <= RECENT)
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("back").desc()))
    return top.select("session_id", pos.cast("long").alias("pos"), "id", "role")


def session_summary(spark, sf_dir: str) -> DataFrame:
    """Per session with messages: count, first question, last city named."""
    m = messages(spark, sf_dir)
    at = F.struct(F.coalesce("at", F.lit(-(2**62))), F.col("id"))
    asked = (F.col("role") == "user") & visible(F.col("content"))
    return m.groupBy("session_id").agg(
        F.count("*").alias("n_messages"),
        F.min_by(F.when(asked, F.col("content")), F.when(asked, at)).alias("first_question"),
        F.max_by("city", F.when(F.col("city").isNotNull(), at)).alias("last_city"),
    )


def session_context(spark, sf_dir: str) -> DataFrame:
    """Cities of a session in order of first mention, and the last three questions."""
    m = messages(spark, sf_dir).select("session_id", "city", "content", "role", F.struct(F.coalesce("at", F.lit(-(2**62))).alias("at"), F.col("id")).alias("k"))
    first = m.where("city is not null").groupBy("session_id", "city").agg(F.min("k").alias("k"))
    cities = first.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "city"))), lambda s: s["city"]), ",").alias("cities"))
    asked = m.where("role = 'user'").where(visible(F.col("content")))
    w = Window.partitionBy("session_id").orderBy(F.col("k").desc())
    last = asked.withColumn("back", F.row_number().over(w)).where("back <= 3")
    texts = last.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("back"), F.col("content")))), lambda s: s["content"]), " | ").alias("last_questions"))
    return cities.join(texts, "session_id", "full_outer").select("session_id", F.coalesce("cities", F.lit("")).alias("cities"), F.coalesce("last_questions", F.lit("")).alias("last_questions"))


def sessions_of_users(spark, sf_dir: str) -> DataFrame:
    """The 20 most recently updated sessions of every user, with message counts."""
    n = messages(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n_messages"))
    w = Window.partitionBy("user_id").orderBy(F.col("updated").desc(), "session_id")
    s = sessions(spark, sf_dir).where("user_id is not null").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20")
    return s.join(n, "session_id", "left").select("user_id", "rank", "session_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def session_state(spark, sf_dir: str) -> DataFrame:
    """Session rows after their messages: updated by the latest one, last city the
    latest named, the first user kept."""
    m = messages(spark, sf_dir).groupBy("session_id").agg(F.max("at").alias("last_at"), F.max_by("city", F.when(F.col("city").isNotNull(), F.struct("at", "id"))).alias("city"))
    s = sessions(spark, sf_dir).groupBy("session_id").agg(F.max("updated").alias("updated"), F.max_by("last_city", F.when(F.col("last_city").isNotNull(), F.struct("updated", "last_city"))).alias("old_city"), F.min(F.when(F.col("user_id").isNotNull(), F.struct("updated", "user_id")))["user_id"].alias("user_id"))
    j = s.join(m, "session_id", "full_outer")
    return j.select("session_id", F.greatest("updated", "last_at").alias("updated_us"), F.coalesce("city", "old_city").alias("last_city"), "user_id")


def orphan_messages(spark, sf_dir: str) -> DataFrame:
    """Messages whose session does not exist."""
    return messages(spark, sf_dir).join(sessions(spark, sf_dir).select("session_id").distinct(), "session_id", "left_anti").select("id", "session_id")


def expire_sessions(spark, sf_dir: str) -> DataFrame:
    """Clean-up 30 days before the latest update: sessions dropped with messages."""
    s = sessions(spark, sf_dir).groupBy("session_id").agg(F.max("updated").alias("updated"))
    now = s.agg(F.max("updated").alias("now"))  # one row
    old = s.crossJoin(F.broadcast(now)).where(F.col("updated") < F.col("now") - TTL_DAYS * 86_400_000_000)
    m = messages(spark, sf_dir).join(old, "session_id").groupBy("session_id").agg(F.count("*").alias("n_messages"))
    return old.join(m, "session_id", "left").select("session_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def history_last20(spark, sf_dir: str) -> DataFrame:
    """The latest 20 questions of every user."""
    w = Window.partitionBy("user_id").orderBy(F.col("at").desc(), F.col("id").desc())
    h = history(spark, sf_dir).where("user_id is not null").withColumn("rank", F.row_number().over(w).cast("long"))
    return h.where(F.col("rank") <= LAST_HISTORY).select("user_id", "rank", "id", F.when(F.length("answer") > 100, F.concat(F.substring("answer", 1, 100), F.lit("..."))).otherwise(F.col("answer")).alias("answer"))


def history_per_city(spark, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return h.groupBy("detected_city").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


def full_data_methods(spark, sf_dir: str) -> DataFrame:
    """Methods named in the JSON payload of history rows; broken JSON counts as none."""
    h = table(spark, sf_dir, "user_history").select("id", "full_data").distinct()
    d = F.from_json("full_data", "method string, top_k int")
    return h.select(d.alias("d")).groupBy(F.coalesce("d.method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"), F.sum("d.top_k").alias("top_k_sum"))


def relative_time(spark, sf_dir: str) -> DataFrame:
    """Age of history rows before a fixed moment, in the buckets of the interface."""
    age = (F.lit(1_777_000_000) - F.floor(F.col("at") / 1_000_000)).cast("long")
    b = F.when(age < 60, "now").when(age < 3600, "minutes").when(age < 86400, "hours").otherwise("date")
    return history(spark, sf_dir).select(b.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


QUERIES = {
    "recent_messages": recent_messages, "session_summary": session_summary, "session_context": session_context, "sessions_of_users": sessions_of_users,
    "session_state": session_state, "orphan_messages": orphan_messages, "expire_sessions": expire_sessions, "history_last20": history_last20,
    "history_per_city": history_per_city, "full_data_methods": full_data_methods, "relative_time": relative_time,
}

_INV = r"[\s\p{Z}\p{Cc}\p{Cf}]"
_KEY = "nullif(lower(regexp_replace({0}, '^" + _INV.replace("{", "{{").replace("}", "}}") + "+|" + _INV.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')), '')"
_VIS = f"length(regexp_replace(coalesce(content, ''), '{_INV}', '', 'g')) > 0"
_AT = (
    "case when regexp_matches(created_at, '^-?[0-9]+$') then epoch_ms(try_cast(created_at as bigint)) "
    "when regexp_matches(created_at, '([Zz]|[+-][0-9]{2}:?[0-9]{2})$') and regexp_matches(created_at, ':') then (try_cast(created_at as timestamptz) at time zone 'UTC') "
    "else try_cast(created_at as timestamp) end"
)
M = f"m as (select distinct id, {_KEY.format('session_id')} as session_id, role, content, detected_city as city, epoch_us({_AT}) as tick from messages where {_KEY.format('session_id')} is not null)"
S = f"s as (select distinct {_KEY.format('session_id')} as session_id, {_KEY.format('user_id')} as user_id, last_city, epoch_us(updated_at) as updated from sessions)"
H = f"h as (select distinct id, {_KEY.format('user_id')} as user_id, question, answer, detected_city, epoch_us(created_at) as tick from user_history)"
ORACLE = {
    "recent_messages": f"""with {M}, r as (select *, row_number() over (partition by session_id order by tick desc nulls last, id desc) as back from m)
select session_id, row_number() over (partition by session_id order by back desc) as pos, id, role from r where back <= {RECENT}""",
    "session_summary": f"""with {M} select session_id, count(*) as n_messages, (list(content order by tick nulls first, id) filter (role = 'user' and {_VIS}))[1] as first_question,
(list(city order by tick desc nulls last, id desc) filter (city is not null))[1] as last_city from m group by 1""",
    "session_context": f"""with {M}, f as (select session_id, city, min((coalesce(tick, -4611686018427387904), id)) as k from m where city is not null group by 1, 2),
c as (select session_id, string_agg(city, ',' order by k, city) as cities from f group by 1),
a as (select *, row_number() over (partition by session_id order by tick desc nulls last, id desc) as back from m where role = 'user' and {_VIS}),
t as (select session_id, string_agg(content, ' | ' order by back desc) as last_questions from a where back <= 3 group by 1)
select coalesce(c.session_id, t.session_id) as session_id, coalesce(cities, '') as cities, coalesce(last_questions, '') as last_questions from c full join t using (session_id)""",
    "sessions_of_users": f"""with {M}, {S}, n as (select session_id, count(*) as n_messages from m group by 1), r as (select *, row_number() over (partition by user_id order by updated desc, session_id) as rank from s where user_id is not null)
select user_id, rank, session_id, coalesce(n_messages, 0) as n_messages from r left join n using (session_id) where rank <= 20""",
    "session_state": f"""with {M}, {S}, a as (select session_id, max(tick) as last_at, (list(city order by tick desc nulls last, id desc) filter (city is not null))[1] as city from m group by 1),
b as (select session_id, max(updated) as updated, arg_max(last_city, (updated, last_city)) filter (last_city is not null) as old_city, arg_min(user_id, (updated, user_id)) filter (user_id is not null) as user_id from s group by 1)
select coalesce(a.session_id, b.session_id) as session_id, greatest(updated, last_at) as updated_us, coalesce(city, old_city) as last_city, user_id from b full join a using (session_id)""",
    "orphan_messages": f"with {M}, {S} select id, session_id from m where session_id not in (select session_id from s where session_id is not null)",
    "expire_sessions": f"""with {M}, {S}, u as (select session_id, max(updated) as updated from s group by 1), o as (select session_id from u where updated < (select max(updated) from u) - {TTL_DAYS}::bigint * 86400000000)
select o.session_id, count(m.id) as n_messages from o left join m using (session_id) group by 1""",
    "history_last20": f"""with {H}, r as (select *, row_number() over (partition by user_id order by tick desc, id desc) as rank from h where user_id is not null)
select user_id, rank, id, case when length(answer) > 100 then substring(answer, 1, 100) || '...' else answer end as answer from r where rank <= {LAST_HISTORY}""",
    "history_per_city": f"with {H} select detected_city, count(*) as n, count(distinct user_id) as n_users from h group by 1",
    "full_data_methods": """with d as (select distinct id, full_data from user_history), j as (select case when json_valid(full_data) then full_data end as x from d)
select coalesce(json_extract_string(x, '$.method'), 'none') as method, count(*) as n, sum(try_cast(json_extract_string(x, '$.top_k') as int))::bigint as top_k_sum from j group by 1""",
    "relative_time": f"""with {H}, a as (select 1777000000 - floor(tick / 1000000)::bigint as age from h)
select case when age < 60 then 'now' when age < 3600 then 'minutes' when age < 86400 then 'hours' else 'date' end as bucket, count(*) as n from a group by 1""",
}
