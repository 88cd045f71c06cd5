"""Corpus lifecycle: scans, idempotent inserts, upserts, conservation, export and
re-import, snapshots, browsing and per-city statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


from wayspring.functions.text import SEARCH_TEXT_SQL, category, category_sql, search_text, slug
from wayspring.operators.retrieval import DIMS, E_SQL, POST_SQL, entries, hashed_vector, postings
from wayspring.runtime import materialize, scratch_path, table

KEY = ["city", "id", "chunk_id"]
PAGE_SIZE = 20


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


# ---------------------------------------------------------------- scans and projections


def corpus(spark, sf_dir: str) -> DataFrame:
    """Distinct entries with the null policy of the store: missing text is '', a
    falsy or negative chunk number is 1."""
    e = table(spark, sf_dir, "knowledge_entries").dropDuplicates(["rid"])
    chunk = F.when(F.coalesce(F.col("chunk_id"), F.lit(0)) <= 0, 1).otherwise(F.col("chunk_id"))
    texts = ["title", "content", "category", "sub_category", "source", "source_url", "submission_id", "user_id", "username", "city_tag", "domain"]
    return e.select("rid", "id", "city", chunk.cast("int").alias("chunk_id"), *(_text(c).alias(c) for c in texts), "keywords", "batch_no", "created_at")


_CHUNK_SQL = "case when coalesce(chunk_id, 0) <= 0 then 1 else chunk_id end"
C_SQL = f"""c as (select rid, any_value(id) as id, any_value(city) as city, any_value({_CHUNK_SQL}) as chunk_id, any_value(coalesce(title, '')) as title, any_value(coalesce(content, '')) as content,
 any_value(coalesce(category, '')) as category, any_value(coalesce(sub_category, '')) as sub_category, any_value(coalesce(source, '')) as source, any_value(coalesce(source_url, '')) as source_url,
 any_value(coalesce(submission_id, '')) as submission_id, any_value(batch_no) as batch_no from knowledge_entries group by rid)"""


def entries_scan(spark, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("rid", "id", "city", "chunk_id", "title", "category", "source")


def city_meta_scan(spark, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "city_meta")
    return m.select("city", F.coalesce(F.size("keywords"), F.lit(0)).cast("long").alias("n_keywords"), F.coalesce(F.size("aliases"), F.lit(0)).cast("long").alias("n_aliases"), F.coalesce("tag", F.lit("")).alias("tag"))


def count_entries(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "knowledge_entries")
    return e.agg(F.countDistinct("rid").alias("entries"), F.countDistinct("city").alias("cities"), F.count("*").alias("rows"))


def source_projection(spark, sf_dir: str) -> DataFrame:
    """Entries as cited sources: a contribution is cited by its own id."""
    c = corpus(spark, sf_dir)
    sid = F.when(F.length(F.trim("submission_id")) > 0, F.col("submission_id")).otherwise(F.col("id"))
    return c.select("rid", sid.alias("source_id"), "title", "source", "source_url", "city")


def search_texts(spark, sf_dir: str) -> DataFrame:
    t = entries(spark, sf_dir).select("rid", search_text().alias("text"))
    return t.select("rid", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text")).alias("text_md5"))


def preview(spark, sf_dir: str) -> DataFrame:
    """Shortened texts: 180 characters of an entry with an ellipsis."""
    c = corpus(spark, sf_dir)
    return c.select("rid", F.when(F.length("content") > 180, F.concat(F.substring("content", 1, 180), F.lit("…"))).otherwise(F.col("content")).alias("preview"))


def normalise_entries(spark, sf_dir: str) -> DataFrame:
    """Contributions as entries: trimmed, with defaults, inferred category and a
    slug of the city; blank contents are left out."""
    c = table(spark, sf_dir, "contributions").select("id", "city", "title", "content", "category", "sub_category", "source").dropDuplicates(["id"])
    filled = lambda col, default: F.when(F.length(F.trim(F.coalesce(col, F.lit("")))) > 0, F.trim(col)).otherwise(default)
    city = filled(F.col("city"), F.lit("未知城市"))
    c = c.where(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0).withColumn("the_city", city)
    title = filled(F.col("title"), F.concat("the_city", F.lit("旅游体验")))
    c = c.withColumn("the_title", title).withColumn("text", F.trim("content"))
    cat = filled(F.col("category"), category(F.col("the_title"), F.col("text")))
    return c.select(F.col("id").alias("submission_id"), F.col("the_city").alias("city"), slug(F.col("the_city")).alias("city_slug"), F.col("the_title").alias("title"), cat.alias("category"), filled(F.col("source"), F.lit("用户亲身经历")).alias("source"), F.length("text").cast("long").alias("n_chars"))


# ---------------------------------------------------------------- mutations


def insert_ignore(new: DataFrame, old: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of new to append: the first by `order` of each key that old lacks.
    Keys are compared null-safely by value; other columns are carried along."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    first = new.withColumn("nth_of_key", F.row_number().over(w)).where("nth_of_key = 1").drop("nth_of_key")
    return first.join(old.select(*keys).distinct(), keys, "left_anti")


def accepted_batches(spark, sf_dir: str) -> DataFrame:
    """Insert-ignore of every later batch into the first load."""
    c = corpus(spark, sf_dir)
    base = insert_ignore(c.where("batch_no = 0"), c.where("false"), KEY, "rid")
    added = insert_ignore(c.where("batch_no > 0"), base, KEY, "rid")
    return base.withColumn("how", F.lit("loaded")).unionByName(added.withColumn("how", F.lit("inserted"))).select("rid", "city", "id", "chunk_id", "how")


def conservation(spark, sf_dir: str) -> DataFrame:
    """rows = inserted + skipped, per batch."""
    c = corpus(spark, sf_dir).select("rid", "batch_no")
    kept = accepted_batches(spark, sf_dir).select("rid", F.lit(1).alias("kept"))
    per = c.join(kept, "rid", "left").groupBy("batch_no").agg(F.count("*").alias("n_rows"), F.count("kept").alias("inserted"))
    return per.select("batch_no", "n_rows", "inserted", (F.col("n_rows") - F.col("inserted")).alias("skipped"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces old by key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_city_meta(spark, sf_dir: str) -> DataFrame:
    """The city dimension after entries' cities were added and tags renewed with
    each city's most frequent category (ties: the first in order)."""
    m = table(spark, sf_dir, "city_meta").select("city", F.coalesce("tag", F.lit("")).alias("tag"))
    n = corpus(spark, sf_dir).where("category <> ''").groupBy("city", "category").agg(F.count("*").alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("city").orderBy(F.col("n").desc(), "category"))).where("r = 1")
    return upsert(m, best.select("city", F.col("category").alias("tag")), ["city"])


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("nth_version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth_version = 1").drop("nth_version")


def submission_latest(spark, sf_dir: str) -> DataFrame:
    """The current version of every submission: the latest by updated_at."""
    c = table(spark, sf_dir, "contributions").select("id", "status", "updated_at", "user_id")
    now = latest(c, ["id"], [F.col("updated_at").desc_nulls_last(), F.col("status"), F.col("user_id")])
    return now.select("id", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def live_submissions(spark, sf_dir: str) -> DataFrame:
    """Submissions left after deletion marks; their entries stay."""
    c = table(spark, sf_dir, "contributions").groupBy("id").agg(F.max(F.col("deleted_at").isNotNull()).alias("gone"))
    return c.where("not gone").select("id")


def submissions_by_status(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "contributions").select("id", "status", "user_id").distinct()
    return c.groupBy("status").agg(F.countDistinct("id").alias("n"), F.countDistinct("user_id").alias("n_users"))


def community_posts(spark, sf_dir: str) -> DataFrame:
    """Approved posts, newest first within each user: five a user."""
    c = table(spark, sf_dir, "contributions").where("status = 'approved' and username is not null").select("id", "username", "created_at").distinct()
    w = Window.partitionBy("username").orderBy(F.col("created_at").desc(), "id")
    return c.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("username", "rank", "id")


def positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with pos, each row's number within its group in order, from 1. Groups are
    cut into ranges that are numbered apart and moved by the sizes of the ranges
    before, so a group of any size is never sorted in one task."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = materialize(df.repartitionByRange(n, group, order).withColumn("range_no", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy(group, "range_no").agg(F.count("*").alias("rows_in"))  # one row per group and range
    along = Window.partitionBy(group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(group, "range_no", F.coalesce(F.sum("rows_in").over(along), F.lit(0)).alias("rows_before"))
    inside = F.row_number().over(Window.partitionBy(group, "range_no").orderBy(order))
    return placed.withColumn("pos", inside).join(before, [group, "range_no"]).withColumn("pos", F.col("pos") + F.col("rows_before")).drop("range_no", "rows_before")


# ---------------------------------------------------------------- files and snapshots

_TEXTS = ("id", "city", "title", "content", "category", "sub_category", "source", "source_url", "submission_id", "user_id", "username", "city_tag", "domain")
DOMAIN = "全国旅游"
_STRINGS = T.ArrayType(T.StringType())
ENTRY_JSON = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXTS), T.StructField("keywords", _STRINGS), T.StructField("chunk_id", T.IntegerType()), T.StructField("rid", T.LongType())])
_READ_JSON = T.StructType([*(f if f.name != "chunk_id" else T.StructField("chunk_id", T.StringType()) for f in ENTRY_JSON), T.StructField("aliases", _STRINGS)])


def export_cities(df: DataFrame, meta: DataFrame, path: str) -> None:
    """JSON files per city: an array of a head row `_meta` (of meta: city, keywords,
    aliases, city_tag) and the entries with all their fields in order of rid. A city
    too large for one range of (city, rid) has a file per range, each with the head."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.select("city", "rid", F.to_json(F.struct(*(F.col(f.name) for f in ENTRY_JSON))).alias("row"))
    placed = rows.repartitionByRange(n, "city", "rid").withColumn("part", F.spark_partition_id())
    per = placed.groupBy("city", "part").agg(F.sort_array(F.collect_list(F.struct("rid", "row"))).alias("rows"))
    m = meta.select("city", "keywords", "aliases", "city_tag").withColumn("known", F.lit(True))
    names = F.array("city")
    head = F.struct(
        F.lit("_meta").alias("id"), F.lit(DOMAIN).alias("domain"), F.col("city"), F.lit("_meta").alias("category"), F.lit("系统自动生成").alias("source"), F.lit(0).alias("chunk_id"),
        F.coalesce("keywords", names).alias("keywords"), F.coalesce("aliases", names).alias("aliases"), F.coalesce("city_tag", F.lit("其他")).alias("city_tag"),
    )
    text = F.concat(F.lit("["), F.concat_ws(",", F.to_json(head), F.array_join(F.transform("rows", lambda r: r["row"]), ",")), F.lit("]"))
    out = per.join(m, "city", "left").select(F.col("city").alias("of"), "part", text.alias("value"))
    out.write.partitionBy("of", "part").text(path)


def _city_rows(spark, path: str) -> DataFrame:
    """(file, stem, row): every object of the city files at path: of a top array, of an
    {_meta, items} wrapper (its head gets the id `_meta`), or a single one. Unreadable
    files have a null row."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    arr = F.from_json("value", T.ArrayType(_READ_JSON))
    wrap = F.from_json("value", T.StructType([T.StructField("items", T.ArrayType(_READ_JSON)), T.StructField("_meta", _READ_JSON)]))
    head = F.when(wrap["_meta"].isNotNull(), F.array(wrap["_meta"].withField("id", F.lit("_meta")))).otherwise(F.array().cast(T.ArrayType(_READ_JSON)))
    single = F.from_json("value", _READ_JSON)
    rows = F.when(F.ltrim("value").startswith("["), arr).when(wrap["items"].isNotNull(), F.concat(wrap["items"], head)).otherwise(F.when(single["id"].isNotNull(), F.array(single)))
    stem = F.url_decode(F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))
    return raw.select("file", stem.alias("stem"), F.explode_outer(rows).alias("row"))


def read_city_files(spark, path: str) -> DataFrame:
    """Entries of city files, missing texts '', a falsy or unreadable chunk number 1."""
    r = _city_rows(spark, path).select("row.*").where("id is not null and id <> '_meta'")
    n = F.col("chunk_id").try_cast("int")
    texts = [F.coalesce(F.col(c), F.lit(DOMAIN if c == "domain" else "")).alias(c) for c in _TEXTS]
    return r.select(*texts, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.when(n > 0, n).otherwise(1).alias("chunk_id"), "rid")


def read_city_meta(spark, path: str) -> DataFrame:
    """(city, keywords, aliases, city_tag): the head of every readable file; one
    without has its name for a city."""
    r = _city_rows(spark, path).where("row is not null")
    head = F.max(F.when(F.col("row.id") == "_meta", F.col("row")))
    m = r.groupBy("file", "stem").agg(head.alias("m")).select("stem", "m")
    none = F.array().cast("array<string>")
    city = F.when(F.length("m.city") > 0, F.col("m.city")).otherwise(F.col("stem"))
    return m.select(city.alias("city"), F.coalesce("m.keywords", none).alias("keywords"), F.coalesce("m.aliases", none).alias("aliases"), F.coalesce("m.city_tag", F.lit("")).alias("city_tag")).dropDuplicates(["city"])


def migrate(spark, path: str, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries to insert, city dimension to upsert, counters) of the city files at
    path: keys that old has, or that came before, are skipped. Running it again with
    its own result inserts nothing. counters: (files, entries, duplicates_skipped,
    meta), one row."""
    e = read_city_files(spark, path)
    new = insert_ignore(e, e.where("false") if old is None else old, KEY, "rid")
    meta = read_city_meta(spark, path)
    files = _city_rows(spark, path).where("row is not null").agg(F.countDistinct("file").alias("files"))
    n = e.agg(F.count("*").alias("read")).crossJoin(new.agg(F.count("*").alias("entries"))).crossJoin(meta.agg(F.count("*").alias("meta")))  # one row each
    counts = files.crossJoin(n).select("files", "entries", (F.col("read") - F.col("entries")).alias("duplicates_skipped"), "meta")
    return new, meta, counts


def bootstrap(spark, store: DataFrame, seed: str) -> DataFrame:
    """The store, or the seed files' entries where it is empty."""
    return migrate(spark, seed)[0] if store.isEmpty() else store


def rebuild(spark, seed: str) -> tuple[DataFrame, DataFrame]:
    """Entries and city dimension anew from the seed files, whatever the store holds."""
    new, meta, _ = migrate(spark, seed)
    return new, meta


def _exported(spark, sf_dir: str) -> str:
    path = scratch_path(spark, "export")
    m = table(spark, sf_dir, "city_meta").select("city", "keywords", "aliases", F.coalesce("tag", F.lit("")).alias("city_tag"))
    export_cities(corpus(spark, sf_dir), m, path)
    return path


def json_round_trip(spark, sf_dir: str) -> DataFrame:
    """Export to files per city and read back, every field."""
    back = read_city_files(spark, _exported(spark, sf_dir))
    chars = [F.sum(F.length(c)).alias(f"{c}_chars") for c in ("title", "content", "sub_category", "source", "source_url", "submission_id")]
    return back.groupBy("city").agg(F.count("*").alias("n"), F.sum("rid").alias("rid_sum"), F.sum("chunk_id").alias("chunk_sum"), F.sum(F.size("keywords")).alias("n_keywords"), *chars)


def meta_round_trip(spark, sf_dir: str) -> DataFrame:
    """The city dimension as it comes back from the files' heads."""
    m = read_city_meta(spark, _exported(spark, sf_dir))
    return m.select("city", F.array_join("keywords", "|", "").alias("keywords"), F.array_join("aliases", "|", "").alias("aliases"), "city_tag")


def migration_counts(spark, sf_dir: str) -> DataFrame:
    """Migration of the exported files into an empty store: what was inserted and skipped."""
    return migrate(spark, _exported(spark, sf_dir))[2].select("entries", "duplicates_skipped", "meta")


def _digest(pos, id_):
    """A share of an order-sensitive digest: summed, it needs no list of a city's ids."""
    return F.conv(F.substring(F.md5(F.concat(pos.cast("string"), F.lit(":"), id_)), 1, 8), 16, 10).cast("long")


def snapshot_manifest(spark, sf_dir: str) -> DataFrame:
    """Per city, the ids of the vector snapshot in order of position: count and
    digest, against which a snapshot is validated."""
    c = positions(corpus(spark, sf_dir).where("batch_no = 0").select("city", "rid", "id"), "city", "rid")
    return c.groupBy("city").agg(F.count("*").alias("n"), F.sum(_digest(F.col("pos"), F.col("id"))).alias("ids_digest"))


def embed_diff(spark, sf_dir: str) -> DataFrame:
    """Incremental index upkeep by key: entries to encode after the first load,
    and whether the old ids of their city are a prefix of the current ones."""
    c = materialize(corpus(spark, sf_dir).select("city", "rid", "id", "batch_no"), "keys")
    now = positions(c.select("city", "rid", "id"), "city", "rid").select("city", "pos", "id")
    old = positions(c.where("batch_no = 0").select("city", "rid", "id"), "city", "rid").select("city", "pos", F.col("id").alias("old_id"))
    j = now.join(old, ["city", "pos"], "left")
    n_old = F.count("old_id")
    return j.groupBy("city").agg(n_old.alias("n_old"), (F.count("*") - n_old).alias("n_new"), F.coalesce(F.min(F.col("id") == F.col("old_id")), F.lit(True)).alias("prefix"))


def encode_new(old: DataFrame, e: DataFrame, encode) -> DataFrame:
    """Vectors (rid, dim, w) of the entries e from those of an older corpus: entries
    that old lacks are encoded, those that are gone left out, the rest reused."""
    kept = old.join(e.select("rid"), "rid", "left_semi")
    fresh = e.join(old.select("rid").distinct(), "rid", "left_anti")
    return kept.withColumn("reused", F.lit(True)).unionByName(encode(fresh).withColumn("reused", F.lit(False)))


def incremental_vectors(spark, sf_dir: str) -> DataFrame:
    """Vectors of the corpus when those of the first load are at hand: entries reused
    and encoded per city, and a checksum of all vectors."""
    e = entries(spark, sf_dir)
    encode = lambda x: hashed_vector(postings(x).select("rid", "token", F.col("tf").alias("n")), "rid")
    first = e.join(corpus(spark, sf_dir).where("batch_no = 0").select("rid"), "rid", "left_semi")
    v = encode_new(materialize(encode(first), "vectors"), e, encode).join(e.select("rid", "city"), "rid")
    count = lambda c: F.count_distinct(F.when(c, F.col("rid")))
    return v.groupBy("city").agg(count(F.col("reused")).alias("reused"), count(~F.col("reused")).alias("encoded"), F.round(F.sum(F.col("w") * (F.col("dim") + 1)), 3).alias("checksum"))


# ---------------------------------------------------------------- browse


def city_stats(spark, sf_dir: str) -> DataFrame:
    """Covered cities with entry count and categories; cities without rows count 0."""
    m = table(spark, sf_dir, "city_meta").select("city")
    s = corpus(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("category") != "", F.col("category")))), ",").alias("categories"))
    return m.join(s, "city", "left").select("city", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("categories", F.lit("")).alias("categories"))


def page(df: DataFrame, number: int, size: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last: tuple | None, size: int, order: list[str]) -> DataFrame:
    """The page behind the row with the order values last (the first page for null):
    the bound is a filter, so pages before cost nothing however deep it lies."""
    if last is not None:
        df = df.where(F.struct(*order) > F.struct(*(F.lit(x).alias(c) for c, x in zip(order, last))))
    return df.orderBy(*order).limit(size)


def page_browse(spark, sf_dir: str) -> DataFrame:
    """Third page of the entries in order of city and rid."""
    return page(corpus(spark, sf_dir).select("city", "rid", "title"), 3, PAGE_SIZE, ["city", "rid"])


def page_by_key(spark, sf_dir: str) -> DataFrame:
    """The same page reached from the last row of the second."""
    c = corpus(spark, sf_dir).select("city", "rid", "title")
    first = page_after(c, None, 2 * PAGE_SIZE, ["city", "rid"]).collect()  # two pages
    return page_after(c, (first[-1]["city"], first[-1]["rid"]) if len(first) == 2 * PAGE_SIZE else ("\U0010ffff", 0), PAGE_SIZE, ["city", "rid"])


def page_totals(spark, sf_dir: str) -> DataFrame:
    """Total and pages per category filter."""
    c = corpus(spark, sf_dir).groupBy("category").agg(F.count("*").alias("total"))
    return c.select("category", "total", F.ceil(F.col("total") / PAGE_SIZE).alias("total_pages"))


def city_positions(spark, sf_dir: str) -> DataFrame:
    """Position of every entry inside its city's block."""
    return positions(corpus(spark, sf_dir).select("rid", "city"), "city", "rid").select("rid", "city", "pos")


def covered_without_rows(spark, sf_dir: str) -> DataFrame:
    """Cities of the dimension without entries, and of entries without dimension."""
    m, c = table(spark, sf_dir, "city_meta").select("city"), corpus(spark, sf_dir).select("city").distinct()
    return m.join(c, "city", "left_anti").withColumn("lacks", F.lit("rows")).unionByName(c.join(m, "city", "left_anti").withColumn("lacks", F.lit("meta")))


def health(spark, sf_dir: str) -> DataFrame:
    e = corpus(spark, sf_dir).agg(F.count("*").alias("entries"), F.countDistinct("city").alias("cities_with_rows"))
    m = table(spark, sf_dir, "city_meta").agg(F.count("*").alias("covered_cities"))
    return e.crossJoin(m).withColumn("vector_status", F.lit("not_loaded")).withColumn("rerank_status", F.lit("not_loaded"))  # one row each


QUERIES = {
    "entries_scan": entries_scan, "city_meta_scan": city_meta_scan, "count_entries": count_entries, "source_projection": source_projection, "search_texts": search_texts,
    "preview": preview, "normalise_entries": normalise_entries, "insert_ignore": accepted_batches, "conservation": conservation, "upsert_city_meta": upsert_city_meta,
    "submission_latest": submission_latest, "live_submissions": live_submissions, "submissions_by_status": submissions_by_status, "community_posts": community_posts,
    "json_round_trip": json_round_trip, "meta_round_trip": meta_round_trip, "migration_counts": migration_counts, "snapshot_manifest": snapshot_manifest, "embed_diff": embed_diff, "city_stats": city_stats, "page_browse": page_browse, "page_by_key": page_by_key, "incremental_vectors": incremental_vectors,
    "page_totals": page_totals, "city_positions": city_positions, "covered_without_rows": covered_without_rows, "health": health,
}

_ACCEPT = f"""{C_SQL}, ranked as (select *, row_number() over (partition by city, id, chunk_id order by rid) as n from c),
base as (select * from (select *, row_number() over (partition by city, id, chunk_id order by rid) as n0 from c where batch_no = 0) where n0 = 1),
added as (select * from (select *, row_number() over (partition by city, id, chunk_id order by rid) as n0 from c where batch_no > 0) a where n0 = 1 and not exists (select 1 from base b where b.city = a.city and b.id = a.id and b.chunk_id = a.chunk_id)),
acc as (select rid, city, id, chunk_id, 'loaded' as how from base union all select rid, city, id, chunk_id, 'inserted' from added)"""
_FILL = "case when length(trim(coalesce({0}, ''), ' ')) > 0 then trim({0}, ' ') else {1} end"
ORACLE = {
    "entries_scan": f"with {C_SQL} select rid, id, city, chunk_id, title, category, source from c",
    "city_meta_scan": "select city, coalesce(len(keywords), 0) as n_keywords, coalesce(len(aliases), 0) as n_aliases, coalesce(tag, '') as tag from city_meta",
    "count_entries": "select count(distinct rid) as entries, count(distinct city) as cities, count(*) as rows from knowledge_entries",
    "source_projection": f"with {C_SQL} select rid, case when length(trim(submission_id, ' ')) > 0 then submission_id else id end as source_id, title, source, source_url, city from c",
    "search_texts": f"with {E_SQL} select rid, length({SEARCH_TEXT_SQL}) as n_chars, md5({SEARCH_TEXT_SQL}) as text_md5 from e",
    "preview": f"with {C_SQL} select rid, case when length(content) > 180 then substring(content, 1, 180) || '…' else content end as preview from c",
    "normalise_entries": f"""with a as (select distinct id, city, title, content, category, source from contributions where length(trim(coalesce(content, ''), ' ')) > 0),
b as (select *, {_FILL.format('city', "'未知城市'")} as the_city from a), d as (select *, {_FILL.format('title', "the_city || '旅游体验'")} as the_title, trim(content, ' ') as txt from b)
select id as submission_id, the_city as city, regexp_replace(regexp_replace(lower(the_city), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g'), '^_+|_+$', '', 'g') as city_slug, the_title as title,
{_FILL.format('category', category_sql('the_title', 'txt'))} as category, {_FILL.format('source', "'用户亲身经历'")} as source, length(txt) as n_chars from d""",
    "insert_ignore": f"with {_ACCEPT} select * from acc",
    "conservation": f"with {_ACCEPT} select c.batch_no, count(*) as n_rows, count(acc.rid) as inserted, count(*) - count(acc.rid) as skipped from c left join acc using (rid) group by 1",
    "upsert_city_meta": f"""with {C_SQL}, n as (select city, category, count(*) as n from c where category <> '' group by 1, 2),
b as (select city, category from (select *, row_number() over (partition by city order by n desc, category) as r from n) where r = 1)
select city, category as tag from b union all select city, coalesce(tag, '') from city_meta where city not in (select city from b)""",
    "submission_latest": "select id, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated from (select *, row_number() over (partition by id order by updated_at desc nulls last, status nulls first, user_id nulls first) as n from contributions) where n = 1",
    "live_submissions": "select id from contributions group by id having not bool_or(deleted_at is not null)",
    "submissions_by_status": "select status, count(distinct id) as n, count(distinct user_id) as n_users from contributions group by 1",
    "community_posts": "select username, rank, id from (select username, id, row_number() over (partition by username order by created_at desc, id) as rank from (select distinct id, username, created_at from contributions where status = 'approved' and username is not null)) where rank <= 5",
    "json_round_trip": f"with {C_SQL}, k as (select rid, any_value(coalesce(len(keywords), 0)) as nk from knowledge_entries group by rid) select city, count(*) as n, sum(rid)::bigint as rid_sum, sum(chunk_id)::bigint as chunk_sum, sum(nk)::bigint as n_keywords, " + ", ".join(f"sum(length({c}))::bigint as {c}_chars" for c in ("title", "content", "sub_category", "source", "source_url", "submission_id")) + " from c join k using (rid) group by 1",
    "meta_round_trip": f"with {C_SQL}, u as (select distinct city from c) select city, array_to_string(list_transform(case when m.city is null then [u.city] else coalesce(keywords, [u.city]) end, lambda x: coalesce(x, '')), '|') as keywords, array_to_string(list_transform(case when m.city is null then [u.city] else coalesce(aliases, [u.city]) end, lambda x: coalesce(x, '')), '|') as aliases, case when m.city is null then '其他' else coalesce(tag, '') end as city_tag from u left join city_meta m using (city)",
    "migration_counts": f"with {C_SQL} select count(distinct (city, id, chunk_id)) as entries, count(*) - count(distinct (city, id, chunk_id)) as duplicates_skipped, count(distinct city) as meta from c",
    "snapshot_manifest": f"with {C_SQL} select city, count(*) as n, sum(('0x' || substring(md5(pos || ':' || id), 1, 8))::bigint)::bigint as ids_digest from (select city, id, row_number() over (partition by city order by rid) as pos from c where batch_no = 0) group by 1",
    "embed_diff": f"""with {C_SQL}, n as (select city, list(id order by rid) as cur, coalesce(list(id order by rid) filter (batch_no = 0), []) as old from c group by 1)
select city, len(old) as n_old, len(cur) - len(old) as n_new, case when len(old) = 0 then true else cur[1:len(old)] = old end as prefix from n""",
    "city_stats": f"""with {C_SQL}, s as (select city, count(*) as n, string_agg(distinct nullif(category, ''), ',' order by nullif(category, '')) as categories from c group by 1)
select m.city, coalesce(n, 0) as n, coalesce(categories, '') as categories from city_meta m left join s using (city)""",
    "page_browse": f"with {C_SQL} select city, rid, title from c order by city, rid limit {PAGE_SIZE} offset {2 * PAGE_SIZE}",
    "page_by_key": f"with {C_SQL} select city, rid, title from c order by city, rid limit {PAGE_SIZE} offset {2 * PAGE_SIZE}",
    "incremental_vectors": f"""with {E_SQL}, {POST_SQL}, vec as (select rid, ('0x' || substring(md5(token), 1, 4))::int % {DIMS} as dim, sum(tf)::double as x from post group by 1, 2), v as (select rid, dim, x / sqrt(sum(x * x) over (partition by rid)) as w from vec),
b as (select rid, any_value(batch_no) as batch_no from knowledge_entries group by rid)
select city, count(distinct rid) filter (batch_no = 0) as reused, count(distinct rid) filter (batch_no <> 0) as encoded, round(sum(w * (dim + 1)), 3) as checksum from v join e using (rid) join b using (rid) group by 1""",
    "page_totals": f"with {C_SQL} select category, count(*) as total, ceil(count(*) / {PAGE_SIZE})::bigint as total_pages from c group by 1",
    "city_positions": f"with {C_SQL} select rid, city, row_number() over (partition by city order by rid) as pos from c",
    "covered_without_rows": f"with {C_SQL} select city, 'rows' as lacks from city_meta where city not in (select city from c) union all select distinct city, 'meta' from c where city not in (select city from city_meta)",
    "health": f"with {C_SQL} select count(*) as entries, count(distinct city) as cities_with_rows, (select count(*) from city_meta) as covered_cities, 'not_loaded' as vector_status, 'not_loaded' as rerank_status from c",
}
