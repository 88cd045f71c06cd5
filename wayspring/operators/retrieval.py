"""Batch retrieval: a table of questions against the corpus of entries.

Every channel is joins and aggregates over postings, ranked with windows; no
document is compared with a question it shares no token with, save in the dense
channel, which by definition scores all rows and does so in blocks.

Questions: (query_id, question, city). Entries: (rid, city, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions.text import COMPARISON, SEARCH_TEXT_SQL, STOP_FULLTEXT, STOP_KEYWORD, contains_any, search_text, sql_list, tokens, tokens_sql, without
from wayspring.operators.blocks import AHEAD_LISTS, BEST, DIMS, ENDS, FOUND, FUSED, OPEN, blocks, by_question, by_row, count_ahead, find_best, find_both, find_ends, find_near, fuse, fuse_all, pack_questions, scan, statistics
from wayspring.runtime import beside, materialize, materialize_buckets, once, table, version, written

TOP_K, BOOST, DAMP, RRF_K, RECALL = 5, 1.5, 0.5, 60, 50
ASKED = 4096  # questions of a pack that has some hundred entries for each
BUCKET_ENTRIES, MOST_BUCKETS = 1024, 10_000  # layout of the index: a task sums the scores of one bucket's entries
QUERY_STRIDE = 50  # some queries are asked for the questions whose id is divisible by this only


# ---------------------------------------------------------------- inputs


def entries(spark, sf_dir: str, parts: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """Distinct corpus rows; a rid repeated in full counts once. parts: partition by
    rid; among: only the rids of this table."""
    e = table(spark, sf_dir, "knowledge_entries")
    if among is not None:
        e = e.join(among, "rid", "left_semi")
    if parts:
        e = e.repartition(parts, "rid")
    return e.select("rid", "id", "city", "title", "content", "keywords", "category", "sub_category", "source", "source_url", "submission_id").dropDuplicates(["rid"])


def questions(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """The questions of the history whose id the stride divides: all of them by 1. Rows
    without id are none."""
    h = table(spark, sf_dir, "user_history").where("id is not null")
    if stride > 1:
        h = h.where(F.col("id") % stride == 0)
    return h.select(F.col("id").alias("query_id"), "question", F.col("detected_city").alias("city")).dropDuplicates(["query_id"])


def covered(spark, sf_dir: str) -> DataFrame:
    """(city, name): every covered city under its own name and its aliases."""
    m = table(spark, sf_dir, "city_meta")
    names = m.select("city", F.explode(F.array_union(F.array("city"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return names.select("city", F.trim("name").alias("name")).where(F.length("name") > 0).distinct()


# ---------------------------------------------------------------- index


def postings(e: DataFrame, tokenizer=tokens) -> DataFrame:
    """(rid, city, dl, token, tf) of the search text; tokenizer maps a text column to
    array<string>."""
    toks = e.select("rid", "city", tokenizer(search_text()).alias("toks")).select("rid", "city", F.size("toks").alias("dl"), F.explode("toks").alias("token"))
    return toks.groupBy("rid", "city", "dl", "token").agg(F.count("*").alias("tf"))


def index(spark, sf_dir: str) -> DataFrame:
    """The postings of the corpus as a table bucketed by rid, one per corpus version:
    tokenised once, shared by all channels and queries, which sum the scores of an
    entry where its postings lie."""
    rows = table(spark, sf_dir, "knowledge_entries").count()  # of the files' footers
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ENTRIES)), MOST_BUCKETS)
    write = lambda df, label: materialize_buckets(df, label, "rid", n)
    return once(spark, "postings", version(spark, sf_dir, "knowledge_entries"), lambda: postings(entries(spark, sf_dir, n)), write)


def query_tokens(q: DataFrame, stop, tokenizer=tokens) -> DataFrame:
    """(query_id, token, qtf, n_tokens): tokens of the questions, repeats counted."""
    toks = q.select("query_id", without(tokenizer(F.col("question")), stop).alias("toks"))
    one = toks.select("query_id", F.size("toks").alias("n_tokens"), F.explode("toks").alias("token"))
    return one.groupBy("query_id", "n_tokens", "token").agg(F.count("*").alias("qtf"))


# ---------------------------------------------------------------- scope


def detect_cities(q: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, city, name, pos): covered names found in the questions. Only
    windows as long as some name are cut; they join the names by equality, so no
    question is compared with a name it does not contain."""
    sizes = names.agg(F.collect_set(F.length("name")).alias("sizes"))  # one row
    at = q.select("query_id", "question").crossJoin(F.broadcast(sizes)).select("query_id", "question", F.explode("sizes").alias("len"))
    at = at.where(F.length("question") >= F.col("len"))
    grams = at.select("query_id", "question", "len", F.explode(F.sequence(F.lit(1), F.length("question") - F.col("len") + 1)).alias("pos"))
    return grams.select("query_id", "pos", F.substr("question", F.col("pos"), F.col("len")).alias("name")).join(names, "name").select("query_id", "city", "name", "pos")


def scope(q: DataFrame, names: DataFrame, e: DataFrame) -> DataFrame:
    """q with `hard` (only the question's city is searched) and `covered`: the
    city must be covered and have entries, and the question must neither compare
    nor name two cities."""
    hits = detect_cities(q, names).groupBy("query_id").agg(F.countDistinct("city").alias("n_cities"))
    own = e.select("city").distinct().join(names.select("city").distinct(), "city").withColumn("has_rows", F.lit(True))
    out = q.join(hits, "query_id", "left").join(own, "city", "left")
    multi = contains_any(F.col("question"), COMPARISON) | (F.coalesce("n_cities", F.lit(0)) >= 2)
    return out.select("query_id", "question", "city", F.coalesce("has_rows", F.lit(False)).alias("has_rows"), F.coalesce(multi, F.lit(False)).alias("multi")).withColumn(
        "hard", F.col("has_rows") & ~F.col("multi")
    )


def in_scope(scored: DataFrame, scoped: DataFrame) -> DataFrame:
    """scored (query_id, rid, city, score) with the scope of its question."""
    s = scored.join(beside(scoped.select("query_id", F.col("city").alias("q_city"), "hard"), "scoped"), "query_id")
    return s.where(~F.col("hard") | (F.col("city") == F.col("q_city")))


def ranked(scored: DataFrame, k: int = TOP_K, boost: float = BOOST, damp: float = DAMP, positive: bool = False) -> DataFrame:
    """(query_id, rank, rid, city, score): boost by city outside hard scopes, round
    to four places, rank, keep k, then (positive) drop what scores nothing."""
    weight = F.when(F.col("hard") | F.col("q_city").isNull(), 1.0).when(F.col("city") == F.col("q_city"), boost).otherwise(damp)
    out = scored.withColumn("score", F.round(F.col("score") * weight, 4))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rid"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    if positive:
        out = out.where("score > 0")
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "rid", "city", "score")


# ---------------------------------------------------------------- lexical channels


def bm25_raw(post: DataFrame, qt: DataFrame, okapi: bool = False) -> DataFrame:
    """(query_id, rid, city, raw, matched, n_distinct): BM25 sums over shared tokens.

    The full-text form: idf clamped to 1e-6, k1 = 1.2. Okapi: k1 = 1.5, negative
    idf replaced by a quarter of the mean idf. b = 0.75 in both."""
    per = post.groupBy("token").agg(F.count("*").alias("df"))
    stats = post.groupBy("rid").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    df = per.select("token", "df").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if okapi:
        mean = df.agg(F.avg(idf).alias("mean_idf"))
        df = df.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(idf < 0, 0.25 * F.col("mean_idf")).otherwise(idf))
        k1 = 1.5
    else:
        df = df.withColumn("idf", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf))
        k1 = 1.2
    hit = post.join(beside(qt.join(df.select("token", "idf", "avgdl"), "token"), "terms"), "token")  # the index is never sorted or broadcast
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - 0.75 + 0.75 * F.col("dl") / F.col("avgdl")))
    size = beside(qt.groupBy("query_id").agg(F.count("*").alias("n_distinct")), "sizes")
    return hit.groupBy("query_id", "rid", "city").agg(F.sum(part).alias("raw"), F.count("*").alias("matched")).join(size, "query_id")


def bm25_scores(post: DataFrame, qt: DataFrame) -> DataFrame:
    """(query_id, rid, city, score): all tokens if any entry has them all, else any
    token; min-max over the matches (the weakest scores 0, equals score 1)."""
    raw = bm25_raw(post, qt)
    full = F.col("matched") == F.col("n_distinct")
    alone = F.when(full, F.col("raw"))
    # one row per question, by map-side aggregation: no window over all matches of a question
    ends = raw.groupBy("query_id").agg(F.count(alone).alias("n_all"), F.min(alone).alias("lo_all"), F.max(alone).alias("hi_all"), F.min("raw").alias("lo_any"), F.max("raw").alias("hi_any"))
    some = F.col("n_all") > 0
    ends = ends.select("query_id", some.alias("all_terms"), F.when(some, F.col("lo_all")).otherwise(F.col("lo_any")).alias("lo"), F.when(some, F.col("hi_all")).otherwise(F.col("hi_any")).alias("hi"))
    kept = raw.join(beside(ends, "ends"), "query_id").where(~F.col("all_terms") | full)
    return kept.select("query_id", "rid", "city", F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("score"))


def _first(found: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, rank, rid, city, score): the best k of what the blocks found."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rid"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "rid", "city", "score")


def _weighed(b: DataFrame, qt: DataFrame, okapi: bool = False) -> DataFrame:
    """(query_id, token, qtf, idf, avgdl): the tokens some entry has, as in bm25_raw."""
    per, stats = statistics(b)
    df = per.crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if okapi:
        df = df.crossJoin(F.broadcast(df.agg(F.avg(idf).alias("mean_idf")))).withColumn("idf", F.when(idf < 0, 0.25 * F.col("mean_idf")).otherwise(idf))
    else:
        df = df.withColumn("idf", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf))
    return qt.join(df, "token").select("query_id", "token", "qtf", "idf", "avgdl")


def _asked(spark, sf_dir: str, stop, okapi: bool = False, stride: int = QUERY_STRIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, weighed tokens of the questions, (query_id, need, n_tokens))."""
    b = blocks(spark, sf_dir)
    qt = materialize(query_tokens(questions(spark, sf_dir, stride), stop), "tokens")
    need = qt.groupBy("query_id").agg(F.count("*").alias("need"), F.first("n_tokens").alias("n_tokens"))
    return b, materialize(_weighed(b, qt, okapi), "weighed"), need


def _ends(b: DataFrame, terms: DataFrame, need: DataFrame, counts: bool = False) -> DataFrame:
    """(query_id, n_any, n_all, lo, hi, lo_all, hi_all) over all entries."""
    found = scan(b, pack_questions(terms, need.select("query_id", "need")), find_ends(counts), 1.2, ENDS, "ends")
    total, least, most = (lambda c: F.sum(c).alias(c)), (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c))
    return found.groupBy("query_id").agg(total("n_any"), total("n_all"), least("lo"), most("hi"), least("lo_all"), most("hi_all"))


def _bounded(b: DataFrame, terms: DataFrame, need: DataFrame) -> DataFrame:
    """(query_id, need, all_terms, lo, hi): whether all tokens are asked for, and the
    least and greatest score of what then matches."""
    some = F.col("n_all") > 0
    ends = _ends(b, terms, need).select("query_id", some.alias("all_terms"), F.when(some, F.col("lo_all")).otherwise(F.col("lo")).alias("lo"), F.when(some, F.col("hi_all")).otherwise(F.col("hi")).alias("hi"))
    return need.select("query_id", "need").join(ends, "query_id")


def _once(spark, label: str, of: str, stride: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `label` of the questions of a stride, written once a version; cut from
    that of all questions where this is there."""
    if stride == 1:
        return once(spark, label, of, build)
    every = written(spark, label, of)
    return once(spark, f"{label}_{stride}", of, build) if every is None else every.where(F.col("query_id") % stride == 0)


def bounded(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """_bounded of the full-text form as a written table, one per version of its inputs."""
    of = version(spark, sf_dir, "knowledge_entries", "user_history")
    return _once(spark, "bounded", of, stride, lambda: _bounded(*_asked(spark, sf_dir, STOP_FULLTEXT, stride=stride)))


def bm25_topk(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    b, terms, _ = _asked(spark, sf_dir, STOP_FULLTEXT, stride=stride)
    s = scope(questions(spark, sf_dir, stride), covered(spark, sf_dir), b.select(F.explode("cities").alias("city"))).select("query_id", "city", "hard")
    about = materialize(bounded(spark, sf_dir, stride).join(s, "query_id"), "about")
    return _first(scan(b, pack_questions(terms, about), find_best(TOP_K, BOOST, DAMP, True), 1.2, FOUND, "found"))


def ranking(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """bm25_topk as a written table, one per version of its inputs, for all that build on it."""
    of = version(spark, sf_dir, "knowledge_entries", "user_history", "city_meta")
    return _once(spark, "ranking", of, stride, lambda: bm25_topk(spark, sf_dir, stride))


def bm25_matches(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """Per question: matches and whether all tokens were required."""
    per = _ends(*_asked(spark, sf_dir, STOP_FULLTEXT, stride=stride), counts=True)
    return per.select("query_id", "n_any", "n_all", F.when(F.col("n_all") > 0, "AND").otherwise("OR").alias("mode"))


def _unbounded() -> list[Column]:
    return [F.lit(False).alias("all_terms"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")]


def bm25_okapi(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    b, terms, need = _asked(spark, sf_dir, (), okapi=True, stride=stride)
    s = scope(questions(spark, sf_dir, stride), covered(spark, sf_dir), b.select(F.explode("cities").alias("city"))).select("query_id", "city", "hard")
    about = materialize(need.join(s, "query_id").select("query_id", "need", "city", "hard", *_unbounded()), "about")
    return _first(scan(b, pack_questions(terms, about), find_best(TOP_K, BOOST, DAMP, True), 1.5, FOUND, "found"))


def keyword_topk(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """Share of the question's tokens (repeats counted) an entry has. Only the
    city filter applies, no boost; entries without a shared token don't appear."""
    b, terms, need = _asked(spark, sf_dir, STOP_KEYWORD, stride=stride)
    own = b.select(F.explode("cities").alias("city")).distinct().join(covered(spark, sf_dir).select("city").distinct(), "city").withColumn("has_rows", F.lit(True))
    scoped = questions(spark, sf_dir, stride).join(own, "city", "left").select("query_id", "city", F.coalesce("has_rows", F.lit(False)).alias("hard"))
    about = materialize(need.join(scoped, "query_id").select("query_id", "need", "n_tokens", "city", "hard", *_unbounded()), "about")
    return _first(scan(b, pack_questions(terms, about), find_best(TOP_K, 1.0, 1.0, False), None, FOUND, "found"))


def first_k_without_tokens(spark, sf_dir: str) -> DataFrame:
    """Messages of users without a usable token get the first k entries in scope (of
    their city, where it has any, else of all), no score."""
    e = entries(spark, sf_dir).select("rid", "city")
    m = table(spark, sf_dir, "messages").where("role = 'user'").select(F.col("id").alias("query_id"), F.col("content").alias("question"), F.col("detected_city").alias("city")).distinct()
    none = m.where(F.size(without(tokens(F.col("question")), STOP_KEYWORD)) == 0).select("query_id", "city")
    firsts = e.withColumn("n", F.row_number().over(Window.partitionBy("city").orderBy("rid"))).where(F.col("n") <= TOP_K)  # kept k per task before the shuffle
    got = none.join(firsts, "city").select("query_id", F.col("n").cast("long").alias("rank"), "rid")
    overall = e.select("rid").orderBy("rid").limit(TOP_K).withColumn("n", F.row_number().over(Window.orderBy("rid")))  # k rows
    rest = none.join(e.select("city").distinct(), "city", "left_anti").crossJoin(F.broadcast(overall))
    return got.unionByName(rest.select("query_id", F.col("n").cast("long").alias("rank"), "rid"))


# ---------------------------------------------------------------- dense channel

BLOCK = 512


def _packed(df: DataFrame, key: str, vec: str, block: str) -> DataFrame:
    """Rows packed into blocks of at most BLOCK keys: (block, rows)."""
    return df.groupBy(F.floor(F.col(key) / BLOCK).alias(block)).agg(F.collect_list(F.struct(key, vec)).alias("rows"))


def vector_topk(queries: DataFrame, base: DataFrame, k: int = TOP_K, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): exact top k by dot product, in double.

    The stated query set is packed into blocks, the base into blocks of at most
    512 keys; each pair of blocks is one matrix product that keeps k rows per
    question, so nothing per pair of rows is shuffled. Null vectors and vectors
    of another length than the question's score nothing and are left out."""
    q = _packed(queries.where(F.col(vec).isNotNull()), key, vec, "qb").withColumnRenamed("rows", "qs")
    b = _packed(base.where(F.col(vec).isNotNull()), key, vec, "bb").withColumnRenamed("rows", "bs")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qs, bs in zip(pdf["qs"], pdf["bs"]):
                dim = len(qs[0][vec])
                bs = [r for r in bs if len(r[vec]) == dim]
                qs = [r for r in qs if len(r[vec]) == dim]
                if not bs:
                    continue
                bid = np.array([r[key] for r in bs], dtype=np.int64)
                score = np.round(np.array([r[vec] for r in qs], dtype=np.float64) @ np.array([r[vec] for r in bs], dtype=np.float64).T, 9)
                for row, r in zip(score, qs):
                    top = np.lexsort((bid, -np.round(row, 4)))[: k + 1]
                    out.append(pd.DataFrame({"query_id": r[key], "vec_id": bid[top], "score": row[top]}))
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    part = q.crossJoin(b).mapInPandas(best, "query_id long, vec_id long, score double")  # blocks of the stated query set against blocks of all rows
    part = part.withColumn("score", F.round("score", 4))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return part.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vector_query(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_topk(v.where(F.col("vec_id") % QUERY_STRIDE == 0), v)


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, rid, rrf): reciprocal rank fusion of (query_id, rid, rank), rank from 1."""
    both = rankings[0].select("query_id", "rid", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("query_id", "rid", "rank"))
    return both.groupBy("query_id", "rid").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def dimension(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % DIMS


def hashed_vector(toks: DataFrame, key: str) -> DataFrame:
    """(key, dim, w): a unit hashing vector of (key, token, n): the built-in
    embedder, used where no other is supplied."""
    v = toks.groupBy(key, dimension(F.col("token")).alias("dim")).agg(F.sum("n").cast("double").alias("x"))
    norm = v.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return v.join(norm, key).select(key, "dim", (F.col("x") / F.col("norm")).alias("w"))


def entry_vectors(spark, sf_dir: str) -> DataFrame:
    """The hashing vectors of the corpus as a written table, one per corpus version."""
    post = lambda: index(spark, sf_dir).select("rid", "token", F.col("tf").alias("n"))
    return once(spark, "entry_vectors", version(spark, sf_dir, "knowledge_entries"), lambda: hashed_vector(post(), "rid"))


PACK = 4096
_FOUND = "query_id long, rid long, cos long, near boolean"


def _matrix(ids: DataFrame, v: DataFrame, key: str, block: str, step: int = 1) -> DataFrame:
    """Vectors as matrices of at most PACK keys, each `step` apart: (block, key, mat)
    as bytes. A key without a vector is a row of zeros."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf[key].to_numpy(np.int64))
        mat, has = np.zeros((len(keys), DIMS)), pdf[pdf["dim"].notna()]
        mat[np.searchsorted(keys, has[key]), has["dim"].astype(int)] = has["w"]
        return pd.DataFrame({block: [pdf[block].iloc[0]], key: [keys.tobytes()], "mat": [mat.tobytes()]})

    rows = ids.select(key).join(v, key, "left").select(F.floor(F.col(key) / (PACK * step)).alias(block), key, "dim", "w")
    return materialize(rows.groupBy(block).applyInPandas(pack, f"{block} long, {key} binary, mat binary"), "matrix")


def _products(cell: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, rids, dot products in whole ten-thousandths) of a pair of blocks."""
    if cell.empty:
        return
    c = cell.iloc[0]
    qid, rid = np.frombuffer(c["query_id"], np.int64), np.frombuffer(c["rid"], np.int64)
    q, d = np.frombuffer(c["qmat"]).reshape(-1, DIMS), np.frombuffer(c["dmat"]).reshape(-1, DIMS)
    for at in range(0, len(qid), 256):
        yield qid[at : at + 256], rid, np.floor(np.round(q[at : at + 256] @ d.T, 9) * 1e4 + 0.5).astype(np.int64)


def _best(depth: int):
    """Of a pair of blocks, each question's best `depth` and the pairs asked for."""

    def best(cell: pd.DataFrame, also: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qid, rid, s in _products(cell):
            n = len(rid)
            order = np.arange(n) - s * n
            top = np.argpartition(order, depth - 1)[:, :depth] if n > depth else np.tile(np.arange(n), (len(qid), 1))
            out.append(pd.DataFrame({"query_id": np.repeat(qid, top.shape[1]), "rid": rid[top].ravel(), "cos": np.take_along_axis(s, top, 1).ravel(), "near": True}))
            own = also[also["query_id"].isin(qid)]
            at = s[np.searchsorted(qid, own["query_id"]), np.searchsorted(rid, own["rid"])]
            out.append(pd.DataFrame({"query_id": own["query_id"], "rid": own["rid"], "cos": at, "near": False}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "rid": [], "cos": [], "near": []})

    return best


def _open_ranks(so: DataFrame, e: DataFrame, lex: DataFrame, qv: DataFrame, dv: DataFrame, depth: int) -> DataFrame:
    """(query_id, rid, bm25_score, vector_score, r1, r2): for questions that search
    all entries, every entry among the first `depth` of either channel, with its
    exact rank in both. Dot products are taken in pairs of blocks, so nothing per
    pair of rows is shuffled: once for the best of each block, once to count what
    is ahead of the rest."""
    lex = lex.join(so, "query_id")
    place = Window.partitionBy("query_id").orderBy(F.col("bm25_score").desc(), "rid")
    lex = materialize(lex.select("query_id", "rid", "bm25_score", F.row_number().over(place).alias("r1")), "lexical")
    n_pos = so.join(lex.groupBy("query_id").agg(F.count("*").alias("n_pos")), "query_id", "left").fillna(0, "n_pos")
    # entries that score nothing follow by rid
    firsts = n_pos.where(F.col("n_pos") < depth).crossJoin(e.select("rid").orderBy("rid").limit(depth))
    lexical = lex.where(F.col("r1") <= depth).select("query_id", "rid").unionByName(firsts.select("query_id", "rid")).distinct()

    qm = _matrix(so, qv, "query_id", "qb", QUERY_STRIDE)
    dm = _matrix(e, dv, "rid", "bb")
    cells = qm.withColumnRenamed("mat", "qmat").crossJoin(dm.withColumnRenamed("mat", "dmat")).groupBy("qb", "bb")
    qb, bb = F.floor(F.col("query_id") / (PACK * QUERY_STRIDE)).alias("qb"), F.floor(F.col("rid") / PACK).alias("bb")

    def ahead(cell: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        out, rest = [], rest.sort_values("query_id")
        for qid, rid, s in _products(cell):
            n = len(rid)
            order = np.sort(np.arange(n) - s * n, axis=1)
            for q, own in rest[rest["query_id"].isin(qid)].groupby("query_id"):
                at = np.searchsorted(rid, own["rid"]) - own["cos"].to_numpy() * n
                out.append(pd.DataFrame({"query_id": q, "rid": own["rid"], "ahead": np.searchsorted(order[np.searchsorted(qid, q)], at)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "rid": [], "ahead": []})

    got = cells.cogroup(lexical.select("query_id", "rid", qb, bb).groupBy("qb", "bb")).applyInPandas(_best(depth), _FOUND)
    got = got.groupBy("query_id", "rid").agg(F.max("cos").alias("cos"), F.max("near").alias("near"))
    near = F.row_number().over(Window.partitionBy("query_id", "near").orderBy(F.col("cos").desc(), "rid"))
    got = got.withColumn("r2", F.when(F.col("near"), near)).join(lexical.withColumn("lexical", F.lit(True)), ["query_id", "rid"], "left")
    got = materialize(got.withColumn("r2", F.when(F.col("r2") <= depth, F.col("r2"))).where("r2 is not null or lexical").drop("near", "lexical"), "candidates")
    rest = got.where("r2 is null").select("query_id", "rid", "cos", qb).crossJoin(dm.select(F.col("bb").alias("at")))
    counted = cells.cogroup(rest.groupBy("qb", "at")).applyInPandas(ahead, "query_id long, rid long, ahead long")
    counted = counted.groupBy("query_id", "rid").agg((F.sum("ahead") + 1).alias("behind"))

    sizes = e.groupBy(bb).agg(F.count("*").alias("n"))  # one row per block
    before = sizes.select("bb", (F.sum("n").over(Window.orderBy("bb")) - F.col("n")).alias("before"))
    places = e.select("rid", bb).withColumn("n", F.row_number().over(Window.partitionBy("bb").orderBy("rid"))).join(before, "bb").select("rid", (F.col("before") + F.col("n")).alias("place"))
    got = got.join(counted, ["query_id", "rid"], "left").join(lex, ["query_id", "rid"], "left")
    got = materialize(got.select("query_id", "rid", "cos", F.coalesce("r2", "behind").alias("r2"), "bm25_score", "r1"), "ranked")
    smaller = lex.select("query_id", "rid", F.lit(1).alias("one")).unionByName(got.where("r1 is null").select("query_id", "rid", F.lit(0).alias("one")))
    smaller = smaller.withColumn("below", F.sum("one").over(Window.partitionBy("query_id").orderBy("rid"))).where("one = 0").drop("one")
    got = got.join(smaller, ["query_id", "rid"], "left").join(n_pos, "query_id").join(places, "rid")
    r1 = F.coalesce("r1", F.col("n_pos") + F.col("place") - F.col("below"))
    return got.select("query_id", "rid", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), (F.col("cos") / 1e4).alias("vector_score"), r1.alias("r1"), "r2")


def _spoken(spark, sf_dir: str, stride: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, weighed tokens, (query_id, said, city, hard)) of all questions, also of
    those without a token; said: the dimensions of all tokens, of which vectors are made."""
    b, q = blocks(spark, sf_dir), questions(spark, sf_dir, stride)
    s = scope(q, covered(spark, sf_dir), b.select(F.explode("cities").alias("city")))
    return b, _asked(spark, sf_dir, STOP_FULLTEXT, stride=stride)[1], materialize(s.select("query_id", F.transform(tokens(F.col("question")), dimension).alias("said"), "city", "hard"), "spoken")


def hybrid(spark, sf_dir: str, pool: int, stride: int = QUERY_STRIDE) -> DataFrame:
    """Both channels rank every entry of the scope, fused by reciprocal rank, the
    best `pool` kept; no boost. (The dense channel is the hashing embedder.)

    The first `pool` of a channel score over 1 / (RRF_K + pool). An entry past
    RRF_K + 2 * pool in both scores less, so no others are needed: one pass over the
    blocks finds them, a second counts what is ahead of those that may be kept and
    whose rank in a channel is not known yet."""
    depth = RRF_K + 2 * pool
    b, terms, said = _spoken(spark, sf_dir, stride)
    about = said.join(bounded(spark, sf_dir, stride), "query_id", "left").fillna(0, "need").fillna(False, "all_terms")
    about = materialize(about, "about")
    chunks = max(spark.sparkContext.defaultParallelism, -(-about.count() // 1024))
    found = scan(b, pack_questions(terms, about), find_both(depth, chunks), 1.2, BEST, "both")
    got = by_row(spark, lambda: materialize(found.groupBy("chunk").applyInArrow(by_question(fuse(depth, pool, RRF_K)), OPEN), "candidates"), 10_000)
    open_ = got.where("lexical or dense").select("query_id", "rids", "bs", "vs", "lexical", "dense")
    open_ = materialize(about.join(open_, "query_id"), "open")
    ahead = scan(b, pack_questions(terms.join(open_.select("query_id"), "query_id"), open_, ASKED), count_ahead(lists=True), 1.2, AHEAD_LISTS, "ahead")
    part = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("part")
    top = got.groupBy(part).cogroup(ahead.groupBy(part)).applyInArrow(lambda x, y: fuse_all(pool, RRF_K)(x, y), FUSED)
    return top.select("query_id", "rank", "rid", F.round("score", 4).alias("score"), (F.col("b") / 1e4).alias("bm25_score"), (F.col("v") / 1e4).alias("vector_score"))


def hybrid_topk(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    return hybrid(spark, sf_dir, min(TOP_K, RECALL), stride)


def text_vector_topk(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """Questions against entries by the dot product of their hashing vectors, with
    the boost by city outside hard scopes; what scores nothing stays."""
    b, terms, said = _spoken(spark, sf_dir, stride)
    return _first(scan(b, pack_questions(terms.limit(0), said), find_near(TOP_K, BOOST, DAMP), None, FOUND, "near"))


def rerank(top: DataFrame, score: Column, k: int = TOP_K) -> DataFrame:
    """Reorder a pool by another score (a column or pandas UDF over question and
    text); the fused score stays the output score."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rid"))
    return top.withColumn("rerank_score", score).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def rerank_shorter(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """The hybrid pool of RECALL rows reordered by a plain stand-in scorer: shorter
    texts first."""
    e = table(spark, sf_dir, "knowledge_entries").select("rid", F.coalesce(F.length("content"), F.lit(0)).alias("n")).dropDuplicates(["rid"])  # texts are not shuffled
    pool = hybrid(spark, sf_dir, RECALL, stride).select("query_id", "rid", "score").join(e, "rid")
    return rerank(pool, -F.col("n")).select("query_id", "rank", "rid", "score")


# ---------------------------------------------------------------- dispatch and comparison


def search(spark, sf_dir: str, method: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """One channel by name; an unknown name means bm25."""
    return {"keyword": keyword_topk, "vector": text_vector_topk, "hybrid": hybrid_topk, "okapi": bm25_okapi}.get(method, ranking)(spark, sf_dir, stride)


METHODS = ("keyword", "bm25", "vector", "hybrid")


def compare_long(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    out = None
    for m in METHODS:
        r = search(spark, sf_dir, m, stride).select(F.lit(m).alias("method"), "query_id", "rank", "rid")
        out = r if out is None else out.unionByName(r)
    return out


def compare_matrix(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """One row per question and entry: its rank under each method, by how many
    methods it was found and its best rank."""
    p = compare_long(spark, sf_dir, stride).groupBy("query_id", "rid").pivot("method", list(METHODS)).agg(F.min("rank"))
    cols = [F.col(m) for m in METHODS]
    found = sum((c.isNotNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return p.select("query_id", "rid", *(F.col(m).alias(f"rank_{m}") for m in METHODS), found.alias("found"), F.least(*cols).alias("best_rank"))


def top1_agreement(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """Largest share of methods that put the same entry first, per question."""
    first = compare_long(spark, sf_dir, stride).where("rank = 1").groupBy("query_id", "rid").agg(F.count("*").alias("n"))
    return first.groupBy("query_id").agg(F.max("n").alias("votes"), F.round(F.max("n") / F.sum("n"), 4).alias("agreement"))


def named_city(q: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, city): the city a question names: an alias first (in order of city
    and alias), else the longest full name; the later city wins a shared alias."""
    hits = detect_cities(q, names).withColumn("alias", F.col("name") != F.col("city"))
    owner = Window.partitionBy("query_id", "name").orderBy(F.col("city").desc())
    hits = hits.withColumn("own", F.row_number().over(owner)).where("own = 1 or not alias")
    order = [F.col("alias").desc(), F.when(F.col("alias"), 0).otherwise(-F.length("name")), F.col("city"), F.col("name")]
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("n = 1").select("query_id", "city")


def city_detect(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    """The city every question names, and the one it is about: the given city first."""
    q = questions(spark, sf_dir, stride)
    best = named_city(q, covered(spark, sf_dir)).withColumnRenamed("city", "detected")
    return q.select("query_id", F.col("city").alias("explicit")).join(best, "query_id", "left").select("query_id", "detected", F.coalesce("explicit", "detected").alias("resolved"))


def multi_city(spark, sf_dir: str, stride: int = QUERY_STRIDE) -> DataFrame:
    s = scope(questions(spark, sf_dir, stride), covered(spark, sf_dir), entries(spark, sf_dir))
    return s.select("query_id", "multi", "has_rows", "hard")


def posting_stats(spark, sf_dir: str) -> DataFrame:
    """Index statistics per token: documents and occurrences."""
    return index(spark, sf_dir).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def of_every(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query for all questions of the history."""
    return partial(query, stride=1)


QUERIES = {
    "bm25_topk": of_every(bm25_topk), "bm25_and_or": of_every(bm25_matches), "bm25_okapi": of_every(bm25_okapi), "keyword_topk": of_every(keyword_topk), "keyword_first_k": first_k_without_tokens,
    "vector_topk": vector_query, "vector_entries_topk": text_vector_topk, "hybrid_topk": of_every(hybrid_topk), "rerank_pool": of_every(rerank_shorter), "compare_matrix": compare_matrix, "top1_agreement": of_every(top1_agreement),
    "city_detect": city_detect, "scope_flags": multi_city, "posting_stats": posting_stats,
}

# ---------------------------------------------------------------- oracle

E_SQL = "e as (select rid, any_value(city) as city, any_value(title) as title, any_value(content) as content, any_value(keywords) as keywords, any_value(category) as category, any_value(sub_category) as sub_category, any_value(source) as source from knowledge_entries group by rid)"
Q_SQL = f"q as (select distinct id as query_id, question, detected_city as city from user_history where id % {QUERY_STRIDE} = 0)"
ALL_SQL = Q_SQL.replace(f"id % {QUERY_STRIDE} = 0", "id is not null")
NAMES_SQL = "names as (select distinct city, trim(name, ' ') as name from (select city, unnest(list_append(coalesce(aliases, []), city)) as name from city_meta) where trim(name, ' ') <> '')"
POST_SQL = f"dt as (select rid, {tokens_sql(SEARCH_TEXT_SQL)} as toks from e), post as (select rid, len(toks) as dl, token, count(*) as tf from (select rid, toks, unnest(toks) as token from dt) group by rid, dl, token)"


def _qt(stop) -> str:
    drop = f"list_filter({tokens_sql('question')}, lambda t: t not in {sql_list(stop)})" if stop else tokens_sql("question")
    return f"qx as (select query_id, {drop} as toks from q), qt as (select query_id, len(toks) as n_tokens, token, count(*) as qtf from (select query_id, toks, unnest(toks) as token from qx) group by all)"


SCOPE_SQL = f"""found as (select query_id, count(distinct n.city) as n_cities from q join names n on contains(q.question, n.name) group by 1),
own as (select distinct e.city from e join names n on e.city = n.city),
scoped as (select *, has_rows and not multi as hard from (select q.query_id, q.question, q.city, own.city is not null as has_rows,
  coalesce(regexp_matches(q.question, '{"|".join(COMPARISON)}') or coalesce(n_cities, 0) >= 2, false) as multi
  from q left join found using (query_id) left join own on own.city = q.city))"""


def _ranked(k: int = TOP_K, positive: bool = True) -> str:
    return f"""w as (select s.query_id, s.rid, e.city, round(s.score * case when c.hard or c.city is null then 1.0 when e.city = c.city then {BOOST} else {DAMP} end, 4) as score
  from scored s join scoped c using (query_id) join e using (rid) where not c.hard or e.city = c.city),
r as (select query_id, row_number() over (partition by query_id order by score desc, rid) as rank, rid, city, score from w)
select * from r where rank <= {k}""" + (" and score > 0" if positive else "")


_RAW = """st as (select count(*) as n_docs, avg(dl) as avgdl from (select distinct rid, dl from post)),
df0 as (select token, count(*) as df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf0, any_value(avgdl) as avgdl from post, st group by token),
df as (select token, avgdl, {idf} as idf from df0),
raw as (select query_id, rid, sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))) as raw, count(*) as matched from qt join df using (token) join post using (token) group by 1, 2),
sz as (select query_id, count(*) as n_distinct from qt group by 1)"""
RAW_SQL = _RAW.format(idf="case when idf0 <= 0 then 1e-6 else idf0 end", k1=1.2)
OKAPI_SQL = _RAW.format(idf="case when idf0 < 0 then 0.25 * (select avg(idf0) from df0) else idf0 end", k1=1.5)
BM25_SQL = """m as (select raw.*, n_distinct, max(case when matched = n_distinct then 1 else 0 end) over (partition by query_id) as any_all from raw join sz using (query_id)),
kept as (select * from m where any_all = 0 or matched = n_distinct),
scored as (select query_id, rid, case when hi > lo then (raw - lo) / (hi - lo) else 1.0 end as score
  from (select *, min(raw) over (partition by query_id) as lo, max(raw) over (partition by query_id) as hi from kept))"""
_KEYWORD = f"""own as (select distinct e.city from e join names n on e.city = n.city),
scoped as (select q.query_id, q.city, own.city is not null as hard from q left join own on own.city = q.city),
scored as (select query_id, rid, sum(qtf) / any_value(n_tokens) as score from qt join post using (token) group by 1, 2),
w as (select s.query_id, s.rid, e.city, round(s.score, 4) as score from scored s join scoped c using (query_id) join e using (rid) where not c.hard or e.city = c.city),
r as (select query_id, row_number() over (partition by query_id order by score desc, rid) as rank, rid, city, score from w)
select * from r where rank <= {TOP_K}"""
_VEC = f"""vec as (select {{key}}, ('0x' || substring(md5(token), 1, 4))::int % {DIMS} as dim, sum(n)::double as x from {{src}} group by 1, 2),
vn as (select {{key}}, dim, x / sqrt(sum(x * x) over (partition by {{key}})) as w from vec)"""
# every entry in scope of every question, whether it matches or not
DENSE_SQL = f"""qall as (select query_id, token, count(*) as n from (select query_id, unnest({tokens_sql('question')}) as token from q) group by 1, 2),
{_VEC.format(key='rid', src='(select rid, token, tf as n from post)').replace('vec as', 'dvec as').replace('from vec', 'from dvec').replace('vn as', 'dv as')},
{_VEC.format(key='query_id', src='qall').replace('vec as', 'qvec as').replace('from vec', 'from qvec').replace('vn as', 'qv as')},
pairs as (select c.query_id, e.rid from scoped c, e where not c.hard or e.city = c.city),
dots as (select a.query_id, b.rid, sum(a.w * b.w) as cos from qv a join dv b on b.dim = a.dim group by 1, 2),
dense as (select p.query_id, p.rid, coalesce(d.cos, 0) as cos from pairs p left join dots d on d.query_id = p.query_id and d.rid = p.rid)"""
HYBRID_SQL = f"""{DENSE_SQL},
bt as (select d.query_id, d.rid, round(coalesce(s.score, 0), 4) as bm25_score, round(d.cos, 4) as vector_score from dense d left join scored s on s.query_id = d.query_id and s.rid = d.rid),
rk as (select *, row_number() over (partition by query_id order by bm25_score desc, rid) as r1, row_number() over (partition by query_id order by vector_score desc, rid) as r2 from bt),
fused as (select query_id, rid, 1.0::double / ({RRF_K} + r1) + 1.0::double / ({RRF_K} + r2) as rrf, bm25_score, vector_score from rk),
hyb as (select query_id, row_number() over (partition by query_id order by rrf desc, rid) as rank, rid, round(rrf, 4) as score, bm25_score, vector_score from fused)"""
_FULL = f"with {E_SQL}, {Q_SQL}, {NAMES_SQL}, {POST_SQL}, {_qt(STOP_FULLTEXT)}, {SCOPE_SQL}, {RAW_SQL}, {BM25_SQL}, "
HYBRID_CTE = _FULL + HYBRID_SQL
NAMED_SQL = """h as (select q.query_id, n.city, n.name, n.name <> n.city as alias, row_number() over (partition by q.query_id, n.name order by n.city desc) as own from q join names n on contains(q.question, n.name)),
b as (select query_id, city, row_number() over (partition by query_id order by alias desc, case when alias then 0 else -length(name) end, city, name) as n from h where own = 1 or not alias)"""
ORACLE_OF_STRIDE = {
    "bm25_topk": _FULL + _ranked(),
    "bm25_and_or": f"""with {E_SQL}, {Q_SQL}, {POST_SQL}, {_qt(STOP_FULLTEXT)}, {RAW_SQL}
select query_id, count(*) as n_any, count(*) filter (matched = n_distinct) as n_all, case when count(*) filter (matched = n_distinct) > 0 then 'AND' else 'OR' end as mode from raw join sz using (query_id) group by 1""",
    "bm25_okapi": f"with {E_SQL}, {Q_SQL}, {NAMES_SQL}, {POST_SQL}, {_qt(())}, {SCOPE_SQL}, {OKAPI_SQL}, scored as (select query_id, rid, raw as score from raw), " + _ranked(),
    "keyword_topk": f"with {E_SQL}, {Q_SQL}, {NAMES_SQL}, {POST_SQL}, {_qt(STOP_KEYWORD)}, {_KEYWORD}",
    "keyword_first_k": f"""with {E_SQL}, m as (select distinct id as query_id, content as question, detected_city as city from messages where role = 'user'),
n as (select query_id, city from m where len(list_filter({tokens_sql('question')}, lambda t: t not in {sql_list(STOP_KEYWORD)})) = 0),
f as (select rid, city, row_number() over (partition by city order by rid) as rank from e), o as (select rid, row_number() over (order by rid) as rank from e)
select query_id, rank, rid from n join f using (city) where rank <= {TOP_K} union all select query_id, rank, rid from n, o where rank <= {TOP_K} and (city is null or city not in (select city from e))""",
    "vector_topk": f"""with v as (select vec_id, embedding::double[] as x from embeddings), s as (select a.vec_id as query_id, b.vec_id, round(list_dot_product(a.x, b.x), 4) as score from v a, v b where a.vec_id % {QUERY_STRIDE} = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s) select * from r where rank <= {TOP_K}""",
    "hybrid_topk": HYBRID_CTE + f" select * from hyb where rank <= {TOP_K}",
    "rerank_pool": HYBRID_CTE + f" select query_id, new_rank as rank, rid, score from (select query_id, rid, score, row_number() over (partition by query_id order by length(coalesce(content, '')), rid) as new_rank from hyb join e using (rid) where hyb.rank <= {RECALL}) where new_rank <= {TOP_K}",
    "vector_entries_topk": f"with {E_SQL}, {Q_SQL}, {NAMES_SQL}, {POST_SQL}, {SCOPE_SQL}, {DENSE_SQL}, scored as (select query_id, rid, cos as score from dense), " + _ranked(positive=False),
    "city_detect": f"""with {Q_SQL}, {NAMES_SQL}, {NAMED_SQL}
select q.query_id, b.city as detected, coalesce(q.city, b.city) as resolved from q left join b on b.query_id = q.query_id and b.n = 1""",
    "scope_flags": f"with {E_SQL}, {Q_SQL}, {NAMES_SQL}, {SCOPE_SQL} select query_id, multi, has_rows, hard from scoped",
    "posting_stats": f"with {E_SQL}, {POST_SQL} select token, count(*) as df, sum(tf)::bigint as cf from post group by 1",
}
_SQL_OF = {m: ORACLE_OF_STRIDE["vector_entries_topk" if m == "vector" else f"{m}_topk"] for m in METHODS}
_LONG = "select method, query_id, rank, rid from (" + " union all ".join(f"select '{m}' as method, query_id, rank, rid from ({_SQL_OF[m]})" for m in METHODS) + ")"
ORACLE_OF_STRIDE["compare_matrix"] = "select query_id, rid, " + ", ".join(f"min(rank) filter (method = '{m}') as rank_{m}" for m in METHODS) + f", count(distinct method) as found, min(rank) as best_rank from ({_LONG}) group by 1, 2"
ORACLE_OF_STRIDE["top1_agreement"] = f"select query_id, max(n) as votes, round(max(n) / sum(n), 4) as agreement from (select query_id, rid, count(*) as n from ({_LONG}) where rank = 1 group by 1, 2) group by 1"


def of_all(sql: str) -> str:
    """The SQL of a stride for all questions."""
    return sql.replace(Q_SQL, ALL_SQL)


WHOLE = ("bm25_topk", "top1_agreement", "rerank_pool", "hybrid_topk", "keyword_topk", "bm25_okapi", "bm25_and_or")  # queries of all questions
ORACLE = ORACLE_OF_STRIDE | {name: of_all(ORACLE_OF_STRIDE[name]) for name in WHOLE}
