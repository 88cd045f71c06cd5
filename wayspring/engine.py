"""The engine as one object: a corpus, its dimension and replaceable parts.

tokenizer: text column -> array<string> column. embedder: DataFrame (key, text)
-> DataFrame (key, embedding array<float>), or none. reranker: (question column,
text column) -> score column, or none. generator: prompt column -> answer column,
or none. What is missing degrades: vectors to BM25, reranking to the fused order,
generation to the rendered sources.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions.text import STOP_FULLTEXT, STOP_KEYWORD, search_text, tokens
from wayspring.operators import retrieval as R
from wayspring.operators.answers import fallback_text, prompt_text, references, relevant_sources
from wayspring.operators.corpus import insert_ignore
from wayspring.operators.quality import content_tokens, moderation, similar_entries


class Engine:
    """Entries: (rid, id, city, title, content, keywords, category, sub_category,
    source); city_meta: (city, aliases). Neither is changed; add() gives a new engine."""

    def __init__(self, entries: DataFrame, city_meta: DataFrame, tokenizer: Callable[[Column], Column] = tokens, embedder=None, reranker=None, generator=None):
        self.entries, self.city_meta = entries, city_meta
        self.tokenizer, self.embedder, self.reranker, self.generator = tokenizer, embedder, reranker, generator

    @cached_property
    def names(self) -> DataFrame:
        alias = F.explode(F.array_union(F.array("city"), F.coalesce("aliases", F.array().cast("array<string>"))))
        n = self.city_meta.select("city", alias.alias("name")).select("city", F.trim("name").alias("name"))
        return n.where(F.length("name") > 0).distinct()

    @cached_property
    def postings(self) -> DataFrame:
        return R.postings(self.entries, self.tokenizer).cache()

    @cached_property
    def vectors(self) -> DataFrame | None:
        """(rid, embedding), encoded once; None without an embedder."""
        if self.embedder is None:
            return None
        return self.embedder(self.entries.select(F.col("rid").alias("key"), search_text().alias("text"))).withColumnRenamed("key", "rid").cache()

    def status(self) -> dict[str, str]:
        ready = lambda x: "ready" if x is not None else "unavailable"
        return {"vector": ready(self.embedder), "rerank": ready(self.reranker), "generate": ready(self.generator)}

    def close(self) -> None:
        for name in ("postings", "vectors"):
            held = self.__dict__.pop(name, None)
            if held is not None:
                held.unpersist()

    def _scope(self, q: DataFrame) -> DataFrame:
        return R.scope(q, self.names, self.entries)

    def _bm25(self, q: DataFrame) -> DataFrame:
        return R.bm25_scores(self.postings, R.query_tokens(q, STOP_FULLTEXT, self.tokenizer))

    def _dense(self, q: DataFrame) -> DataFrame:
        """(query_id, rid, city, score) within scope: dot products against the question."""
        qv = self.embedder(q.select(F.col("query_id").alias("key"), F.col("question").alias("text"))).select(F.col("key").alias("query_id"), F.col("embedding").alias("qv"))
        s = self._scope(q).select("query_id", F.col("city").alias("q_city"), "hard")
        e = self.entries.select("rid", "city").join(self.vectors, "rid")
        hard = s.where("hard").join(e, F.col("q_city") == F.col("city"))
        open_ = s.where("not hard").crossJoin(e)  # a stated query set against all rows
        dot = F.aggregate(F.zip_with("qv", "embedding", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda x, y: x + y)
        return hard.unionByName(open_).join(qv, "query_id").select("query_id", "rid", "city", dot.alias("score"))

    def search(self, q: DataFrame, method: str = "bm25", k: int = R.TOP_K) -> DataFrame:
        """(query_id, rank, rid, city, score) for q (query_id, question, city); an
        unknown method means bm25, a dense one without embedder too."""
        if method == "keyword":
            qt = R.query_tokens(q, STOP_KEYWORD, self.tokenizer)
            hit = self.postings.select("rid", "city", "token").join(qt.hint("shuffle_hash"), "token").groupBy("query_id", "rid", "city").agg((F.sum("qtf") / F.first("n_tokens")).alias("score"))
            scoped = self._scope(q).withColumn("hard", F.col("has_rows"))
            return R.ranked(R.in_scope(hit, scoped).withColumn("hard", F.lit(True)), k)
        if method in ("vector", "hybrid") and self.embedder is not None:
            if method == "vector":
                return R.ranked(R.in_scope(self._dense(q), self._scope(q)), k)
            return self._hybrid(q, k)
        return R.ranked(R.in_scope(self._bm25(q), self._scope(q)), k, positive=True)

    def _hybrid(self, q: DataFrame, k: int) -> DataFrame:
        """Both channels rank every entry in scope; the fused pool of 50 may be
        reranked, its output score stays the fused one; no boost."""
        both = self._dense(q).withColumnRenamed("score", "v").join(self._bm25(q).select("query_id", "rid", F.col("score").alias("b")), ["query_id", "rid"], "left")
        both = both.select("query_id", "rid", "v", F.coalesce("b", F.lit(0.0)).alias("b"))
        place = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(c).desc(), "rid"))
        both = both.withColumn("score", 1.0 / (R.RRF_K + place("b")) + 1.0 / (R.RRF_K + place("v")))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rid")
        pool = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= R.RECALL)
        pool = pool.select("query_id", "rid", F.round("score", 4).alias("score"), F.col("rank").alias("fused")).join(self.entries.select("rid", "city", search_text().alias("text")), "rid").join(q.select("query_id", "question"), "query_id")
        order = self.reranker(F.col("question"), F.col("text")) if self.reranker else -F.col("fused")
        top = R.rerank(pool, order, k)
        return top.select("query_id", "rank", "rid", "city", "score")

    def ask(self, q: DataFrame, method: str = "bm25", k: int = R.TOP_K) -> DataFrame:
        """(query_id, answer, sources array<bigint>): the generator's answer to the
        prompt with its cited or relevant sources, or the rendered sources."""
        text = F.concat_ws(" ", *(F.when(F.length(c) > 0, F.col(c)) for c in ("title", "content", "e_city", "source", "category", "sub_category")))
        e = self.entries.withColumnRenamed("city", "e_city").select("rid", F.coalesce("title", F.lit("")).alias("title"), "e_city", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
        r = self.search(q, method, k).select("query_id", "rank", "rid").join(e, "rid")
        shown, cities = r.withColumnRenamed("e_city", "city"), self.names.agg(F.array_join(F.array_sort(F.collect_set("city")), ", ").alias("cities"))
        if self.generator:
            a = prompt_text(q.select("query_id", "question"), references(shown), cities).select("query_id", self.generator(F.col("prompt")).alias("answer"))
        else:
            a = fallback_text(q, shown, cities)
        kept = relevant_sources(r, a.select("query_id", "answer"))
        src = kept.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rid"))), lambda s: s["rid"]).alias("sources"))
        return a.join(src, "query_id", "left").select("query_id", "answer", F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))

    def add(self, new: DataFrame) -> tuple[Engine, DataFrame]:
        """A new engine with the submissions of new (entries' columns) that pass the
        rules, repeat no entry of their city and bring a new (city, id); and the
        outcome (rid, outcome) of each."""
        rule = new.select("rid", moderation(F.col("city"), F.col("content")).alias("rule"))
        t = content_tokens(F.col("title"), F.col("content"))
        own = F.array(F.col("rid").cast("string"))
        dup = similar_entries(new.select(F.col("rid").alias("id"), "city", t.alias("toks")), self.entries.select("rid", "city", t.alias("toks"), own.alias("own"))).select(F.col("id").alias("rid"), F.lit(True).alias("dup"))
        state = rule.join(dup, "rid", "left")
        good = insert_ignore(new.join(state.where("rule is null and dup is null"), "rid", "left_semi"), self.entries, ["city", "id"], "rid")
        fresh = good.select("rid", F.lit(True).alias("fresh"))
        out = state.join(fresh, "rid", "left").select("rid", F.coalesce("rule", F.when(F.col("dup"), "duplicate"), F.when(F.col("fresh"), "inserted"), F.lit("known")).alias("outcome"))
        grown = Engine(self.entries.unionByName(good.select(*self.entries.columns)), self.city_meta, self.tokenizer, self.embedder, self.reranker, self.generator)
        return grown, out
