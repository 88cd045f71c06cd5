"""Store upkeep: deletions, state bumps, incremental postings, versioned vector
snapshots with validation, look-ups and small projections of the service layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions import visible
from wayspring.functions.text import STOP_FULLTEXT, sql_list, tokens, tokens_sql, without
from wayspring.operators.corpus import C_SQL, KEY, corpus, insert_ignore
from wayspring.operators.quality import ORACLE as QUALITY
from wayspring.operators.quality import SUB, moderation, near_dup
from wayspring.operators.retrieval import ORACLE_OF_STRIDE as RETRIEVAL
from wayspring.operators.retrieval import E_SQL, NAMED_SQL, NAMES_SQL, POST_SQL, Q_SQL, QUERY_STRIDE, covered, entries, named_city, keyword_topk, of_all, of_every, postings, questions, ranking, rrf
from wayspring.operators.sessions import ORACLE as SESSIONS
from wayspring.operators.sessions import H, M, S, history, messages, session_context, sessions
from wayspring.runtime import materialize, scratch_path, table

SNAPSHOT_VERSION = 2


def rrf_fuse(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """Reciprocal rank fusion of the keyword and the BM25 rankings."""
    f = rrf([keyword_topk(spark, sf_dir, stride), ranking(spark, sf_dir, stride)]).withColumn("score", F.round("rrf", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rid"))
    return f.select("query_id", rank.cast("long").alias("rank"), "rid", "score")


def delete_sessions(spark, sf_dir: str) -> DataFrame:
    """Messages that remain after the sessions marked as deleted are removed."""
    gone = table(spark, sf_dir, "sessions").where("deleted_at is not null").select(F.lower(F.trim("session_id")).alias("session_id")).distinct()
    return messages(spark, sf_dir).join(gone, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n"))


def clear_history(spark, sf_dir: str) -> DataFrame:
    """History left per user after the users marked as deleted are cleared."""
    gone = table(spark, sf_dir, "users").where("deleted_at is not null").select(F.lower(F.trim("id")).alias("user_id")).distinct()
    return history(spark, sf_dir).where("user_id is not null").join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


def first_writer(spark, sf_dir: str) -> DataFrame:
    """Get-or-create: every session named by messages or rows; the user of its first
    row in time that has one stays."""
    known = F.when(F.col("user_id").isNotNull(), F.struct("updated", "user_id"))
    s = sessions(spark, sf_dir).groupBy("session_id").agg(F.min(known)["user_id"].alias("user_id"))
    named = messages(spark, sf_dir).select("session_id").distinct()
    return named.join(s, "session_id", "full_outer").select("session_id", "user_id", F.col("user_id").isNull().alias("anonymous"))


def postings_increment(spark, sf_dir: str) -> DataFrame:
    """Index upkeep: postings of the first load plus those of later entries only,
    by batch; together they are the postings of the whole corpus."""
    e = entries(spark, sf_dir)
    b = corpus(spark, sf_dir).select("rid", "batch_no")
    old, new = e.join(b.where("batch_no = 0"), "rid", "left_semi"), e.join(b.where("batch_no > 0"), "rid", "left_semi")
    both = postings(old).withColumn("part", F.lit("loaded")).unionByName(postings(new).withColumn("part", F.lit("added")))
    return both.groupBy("part").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"), F.countDistinct("rid").alias("n_entries"))


def write_snapshot(vectors: DataFrame, path: str, model: str, version: int = SNAPSHOT_VERSION) -> None:
    """Vectors (city, id, chunk_id, embedding) into a new folder; the manifest is
    written last, so a folder without one was never finished."""
    vectors.write.partitionBy("city").parquet(f"{path}/vectors")
    per = vectors.groupBy("city").agg(F.count("*").alias("count"))
    per.select("city", "count", F.lit(model).alias("model"), F.lit(version).alias("version")).coalesce(1).write.json(f"{path}/manifest")


def read_snapshot(spark, path: str, model: str, version: int = SNAPSHOT_VERSION) -> tuple[DataFrame, DataFrame]:
    """(vectors, problems): problems has a row per city whose model, version or
    count is not the manifest's; an empty one means the snapshot is valid."""
    v = spark.read.parquet(f"{path}/vectors")
    m = spark.read.schema("city string, count long, model string, version int").json(f"{path}/manifest")
    have = v.groupBy(F.col("city").cast("string").alias("city")).agg(F.count("*").alias("have"))
    j = m.join(have, "city", "full_outer")
    why = F.when(F.col("model").isNull(), "no manifest").when(F.col("model") != model, "model").when(F.col("version") != version, "version").when(~F.col("count").eqNullSafe(F.col("have")), "count")
    return v, j.select("city", why.alias("problem")).where("problem is not null")


def snapshot_round_trip(spark, sf_dir: str) -> DataFrame:
    """The embeddings written as a snapshot by label and validated on reading."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("city"), F.col("vec_id").cast("string").alias("id"), F.lit(1).alias("chunk_id"), "embedding")
    path = scratch_path(spark, "snapshot")
    write_snapshot(e, path, "table")
    v, bad = read_snapshot(spark, path, "table")
    per = v.groupBy(F.col("city").cast("string").alias("city")).agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("n_values"))
    return per.join(bad, "city", "left").select("city", "n", "n_values", F.coalesce("problem", F.lit("ok")).alias("state"))


def append_pipeline(spark, sf_dir: str) -> DataFrame:
    """Submissions that would enter the corpus: rules passed, no near-duplicate in
    their city, key new; the rest by where they stopped."""
    s = table(spark, sf_dir, "contributions").select("id", "city", "content").dropDuplicates(["id"])
    rule = s.withColumn("rule", moderation(F.col("city"), F.col("content")))
    dup = materialize(near_dup(spark, sf_dir).select("id"), "dup").select("id", F.lit(True).alias("dup"))  # read twice
    j = rule.join(dup, "id", "left")
    passed = j.where("rule is null and dup is null").select("id", "city", F.lit(1).alias("chunk_id"))
    fresh = insert_ignore(passed, corpus(spark, sf_dir), KEY, "id").select("id", F.lit(True).alias("fresh"))
    out = j.join(fresh, "id", "left")
    return out.select(F.when(F.col("rule").isNotNull(), "rules").when(F.col("dup"), "duplicate").when(F.col("fresh"), "inserted").otherwise("known").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def city_cascade(spark, sf_dir: str) -> DataFrame:
    """City of every message of a user: given, else named in the text, else the last
    one introduced earlier in the session, else the session's own last city."""
    m = messages(spark, sf_dir).where("role = 'user'")
    q = m.select(F.col("id").alias("query_id"), F.col("content").alias("question"), "city", "session_id", F.coalesce("at", F.lit(-(2**62))).alias("at"))
    found = named_city(q, covered(spark, sf_dir)).select("query_id", F.col("city").alias("named"))
    said = messages(spark, sf_dir).where("city is not null").groupBy("session_id", "city").agg(F.min(F.struct(F.coalesce("at", F.lit(-(2**62))).alias("at"), "id")).alias("k"))
    firsts = said.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("k", "city"))).alias("firsts"))  # at most one item a city
    before = F.filter("firsts", lambda x: x["k"] < F.struct(F.col("at"), F.col("query_id").alias("id")))
    context = q.join(firsts, "session_id").select("query_id", F.try_element_at(before, F.lit(-1))["city"].alias("context"))
    own = sessions(spark, sf_dir).groupBy("session_id").agg(F.max_by("last_city", F.when(F.col("last_city").isNotNull(), F.struct("updated", "last_city"))).alias("own"))
    j = q.join(found, "query_id", "left").join(context, "query_id", "left").join(own, "session_id", "left")
    tiers = ("city", "named", "context", "own")
    filled = [F.when(F.length(c) > 0, F.col(c)) for c in tiers]
    by = F.coalesce(*(F.when(x.isNotNull(), n) for x, n in zip(filled, ("given", "text", "context", "session"))), F.lit("none"))
    return j.select("query_id", by.alias("by"), F.coalesce(*filled).alias("resolved"))


def context_last_city(spark, sf_dir: str) -> DataFrame:
    """The last newly introduced city of every session's context."""
    c = session_context(spark, sf_dir)
    return c.select("session_id", F.element_at(F.split("cities", ","), -1).alias("city"))


def post_lookup(spark, sf_dir: str) -> DataFrame:
    """Entry of a post by title and city, else by title alone: the smallest rid."""
    post = table(spark, sf_dir, "contributions").select("id", "title", "city").where("title is not null").dropDuplicates(["id"])
    c = corpus(spark, sf_dir).where("title <> ''")
    exact = c.groupBy("title", "city").agg(F.min("rid").alias("r1"))
    loose = c.groupBy("title").agg(F.min("rid").alias("r2"))
    j = post.join(exact, ["title", "city"], "left").join(loose, "title", "left")
    return j.select("id", F.coalesce("r1", "r2").alias("rid"), F.when(F.col("r1").isNotNull(), "exact").when(F.col("r2").isNotNull(), "title").otherwise("none").alias("tier"))


def browse_filters(spark, sf_dir: str) -> DataFrame:
    """Entries under each combination of the optional city and category filters."""
    c = corpus(spark, sf_dir).where("category <> ''")
    return c.cube("city", "category").agg(F.count("*").alias("n"), F.min("rid").alias("first_rid"))


def presence(spark, sf_dir: str) -> DataFrame:
    """Categories present in each city, as the map colours them."""
    c = corpus(spark, sf_dir)
    has = lambda k: F.max(F.when(F.col("category") == k, 1).otherwise(0))
    return c.groupBy("city").agg(has("美食").alias("food"), has("景点").alias("sights"), has("交通").alias("transport"))


def approved_entries(spark, sf_dir: str) -> DataFrame:
    """Ids inside the JSON of approved submissions; broken JSON gives none."""
    c = table(spark, sf_dir, "contributions").select("id", "approved_entry").where("approved_entry is not null").distinct()
    e = F.from_json("approved_entry", "id string, chunk_id int")
    return c.select("id", e["id"].alias("entry_id"), e["chunk_id"].alias("chunk_id"))


def chat_history(spark, sf_dir: str) -> DataFrame:
    """Messages that go into a prompt: those with a visible content, by role."""
    m = messages(spark, sf_dir).where(visible(F.col("content")))
    return m.groupBy(F.coalesce("role", F.lit("user")).alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


def question_terms(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """Usable distinct terms of every question, in order."""
    q = questions(spark, sf_dir, stride)
    return q.select("query_id", F.array_join(F.array_distinct(without(tokens(F.col("question")), STOP_FULLTEXT)), " ").alias("terms"))


def lookup_user(spark, sf_dir: str) -> DataFrame:
    """Point look-up of the first user by name."""
    u = table(spark, sf_dir, "users").select("id", "username").distinct()
    return lookup(u, "username", sorted(u.groupBy().agg(F.min("username")).first()))


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of df whose key is one of values: a filter that reaches the scan, so
    files and row groups without them are not read."""
    return df.where(F.col(key).isin(*values))


def point_lookups(spark, sf_dir: str) -> DataFrame:
    """The store's look-ups by key, for the keys a first page shows: entry by rid,
    entries of a submission, entries of a city and title, user by id, session,
    messages of a session. Rows found per look-up."""
    c, t = corpus(spark, sf_dir), lambda n: table(spark, sf_dir, n)
    rids = [20, 40]
    subs = t("contributions").where("batch_no = 1").agg(F.min("id").alias("v")).first()["v"]
    some = lookup(c, "rid", rids).select("city", "title", "submission_id").collect()
    sid = t("sessions").agg(F.min("session_id").alias("v")).first()["v"]
    uid = t("users").agg(F.min("id").alias("v")).first()["v"]
    found = [
        ("entry", lookup(c, "rid", rids).select("rid")), ("submission", lookup(c, "submission_id", [subs]).select("rid")),
        ("post", lookup(lookup(c, "city", [r["city"] for r in some]), "title", [r["title"] for r in some]).select("rid")),
        ("user", lookup(t("users").select("id").distinct(), "id", [uid])), ("session", lookup(t("sessions").select("session_id").distinct(), "session_id", [sid])),
        ("messages", lookup(t("messages").select("id", "session_id").distinct(), "session_id", [sid])),
    ]
    out = None
    for name, df in found:
        n = df.agg(F.lit(name).alias("lookup"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def marquee(spark, sf_dir: str, n: int = 12, seed: int = 7) -> DataFrame:
    """n entries in random order: the interface's sample, fixed by its seed."""
    return corpus(spark, sf_dir).select("rid", "city", "title").orderBy(F.rand(seed)).limit(n)


QUERIES = {
    "rrf_fuse": of_every(rrf_fuse), "delete_sessions": delete_sessions, "clear_history": clear_history, "first_writer": first_writer, "postings_increment": postings_increment,
    "snapshot_round_trip": snapshot_round_trip, "append_pipeline": append_pipeline, "city_cascade": city_cascade, "context_last_city": context_last_city,
    "post_lookup": post_lookup, "browse_filters": browse_filters, "presence": presence, "approved_entries": approved_entries, "chat_history": chat_history,
    "question_terms": question_terms, "lookup_user": lookup_user, "point_lookups": point_lookups, "marquee": marquee,
}

_VIS = r"length(regexp_replace(coalesce(content, ''), '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g')) > 0"
_REVIEW = QUALITY["review_outcomes"]
ORACLE = {
    "rrf_fuse": of_all(f"""with k as ({RETRIEVAL['keyword_topk']}), b as ({RETRIEVAL['bm25_topk']}), u as (select query_id, rid, rank from k union all select query_id, rid, rank from b),
f as (select query_id, rid, round(sum(1.0::double / (60 + rank)), 6) as score from u group by 1, 2) select query_id, row_number() over (partition by query_id order by score desc, rid) as rank, rid, score from f"""),
    "delete_sessions": f"with {M} select session_id, count(*) as n from m where session_id not in (select lower(trim(session_id, ' ')) from sessions where deleted_at is not null) group by 1",
    "clear_history": f"with {H} select user_id, count(*) as n from h where user_id is not null and user_id not in (select lower(trim(id, ' ')) from users where deleted_at is not null) group by 1",
    "first_writer": f"with {M}, {S}, b as (select session_id, arg_min(user_id, (updated, user_id)) filter (user_id is not null) as user_id from s group by 1), a as (select distinct session_id from m) select coalesce(a.session_id, b.session_id) as session_id, user_id, user_id is null as anonymous from a full join b using (session_id)",
    "snapshot_round_trip": "select label::varchar as city, count(*) as n, sum(len(embedding))::bigint as n_values, 'ok' as state from embeddings group by 1",
    "append_pipeline": f"""with {C_SQL}, {SUB}, r as ({_REVIEW.replace("select case when rule is null", "select id, city, case when rule is null").replace(", count(*) as n from j group by 1, 2", " from j").replace("select sub.id,", "select sub.id, sub.city,")})
select case when reason = 'duplicate' then 'duplicate' when status = 'rejected' then 'rules' when exists (select 1 from c where c.city = r.city and c.id = r.id and c.chunk_id = 1) then 'known' else 'inserted' end as outcome, count(*) as n from r group by 1""",
    "city_cascade": f"""with {M}, {S}, {NAMES_SQL}, q as (select id as query_id, content as question, city, session_id, coalesce(tick, -4611686018427387904) as tick from m where role = 'user'),
{NAMED_SQL}, said as (select session_id, city, min((coalesce(tick, -4611686018427387904), id)) as k from m where city is not null group by 1, 2),
along as (select session_id, tick, query_id, null as first_said, true as asks from q union all select session_id, k[1], k[2], city, false from said),
ctx as (select query_id, asks, last_value(first_said ignore nulls) over (partition by session_id order by tick, query_id, asks desc rows between unbounded preceding and 1 preceding) as context from along),
own as (select session_id, arg_max(last_city, (updated, last_city)) filter (last_city is not null) as own from s group by 1),
j as (select q.query_id, nullif(q.city, '') as city, nullif(b.city, '') as named, nullif(context, '') as context, nullif(own, '') as own from q left join b on b.query_id = q.query_id and b.n = 1 left join ctx on ctx.query_id = q.query_id and ctx.asks left join own on own.session_id = q.session_id)
select query_id, case when city is not null then 'given' when named is not null then 'text' when context is not null then 'context' when own is not null then 'session' else 'none' end as by, coalesce(city, named, context, own) as resolved from j""",
    "post_lookup": f"""with {C_SQL}, p as (select distinct id, title, city from contributions where title is not null), x as (select title, city, min(rid) as r1 from c where title <> '' group by 1, 2), l as (select title, min(rid) as r2 from c where title <> '' group by 1)
select p.id, coalesce(r1, r2) as rid, case when r1 is not null then 'exact' when r2 is not null then 'title' else 'none' end as tier from p left join x on x.title = p.title and x.city = p.city left join l on l.title = p.title""",
    "browse_filters": f"with {C_SQL} select city, category, count(*) as n, min(rid) as first_rid from c where category <> '' group by cube (city, category)",
    "presence": f"with {C_SQL} select city, max(case when category = '美食' then 1 else 0 end) as food, max(case when category = '景点' then 1 else 0 end) as sights, max(case when category = '交通' then 1 else 0 end) as transport from c group by 1",
    "approved_entries": "with d as (select distinct id, approved_entry as x from contributions where approved_entry is not null) select id, case when json_valid(x) then json_extract_string(x, '$.id') end as entry_id, case when json_valid(x) then try_cast(json_extract_string(x, '$.chunk_id') as int) end as chunk_id from d",
    "chat_history": f"with {M} select coalesce(role, 'user') as role, count(*) as n, sum(length(content))::bigint as n_chars from m where {_VIS} group by 1",
    "question_terms": f"""with {Q_SQL}, x as (select query_id, list_filter({tokens_sql('question')}, lambda t: t not in {sql_list(STOP_FULLTEXT)}) as toks from q),
u as (select query_id, unnest(toks) as t, generate_subscripts(toks, 1) as i from x), f as (select query_id, t, min(i) as i from u group by 1, 2)
select x.query_id, coalesce(string_agg(t, ' ' order by i), '') as terms from x left join f using (query_id) group by 1""",
    "point_lookups": f"""with {C_SQL}, k as (select city, title from c where rid in (20, 40)), x as (
select 'entry' as lookup, (select count(*) from c where rid in (20, 40)) as n union all select 'submission', (select count(*) from c where submission_id = (select min(id) from contributions where batch_no = 1))
union all select 'post', (select count(*) from c where city in (select city from k) and title in (select title from k)) union all select 'user', (select count(distinct id) from users where id = (select min(id) from users))
union all select 'session', (select count(distinct session_id) from sessions where session_id = (select min(session_id) from sessions))
union all select 'messages', (select count(distinct id) from messages where session_id = (select min(session_id) from sessions))) select * from x""",
    "lookup_user": "select distinct id, username from users where username = (select min(username) from users)",
}
ORACLE["context_last_city"] = f"select session_id, string_split(cities, ',')[-1] as city from ({SESSIONS['session_context']})"
ORACLE["postings_increment"] = f"""with {E_SQL}, {POST_SQL}, b as (select rid, min(batch_no) as batch_no from knowledge_entries group by 1)
select case when batch_no = 0 then 'loaded' else 'added' end as part, count(*) as n_postings, sum(tf)::bigint as n_tokens, count(distinct rid) as n_entries from post join b using (rid) group by 1"""
