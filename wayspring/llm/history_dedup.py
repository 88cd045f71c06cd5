"""Deduplicating new batches against all history.

Every accepted text is hashed once: its whole normalised content (half-width,
simplified, one wording of common synonyms, letters and digits only), and each
of its paragraphs, which here are statements: sentences and lines in the same
normal form. The hashes stand in tables bucketed by hash in the shared folder;
accepting a batch appends its hashes and touches nothing else.

A new batch is matched bucket-locally. Equal content hashes are full copies. For
shared-paragraph coverage only a text's rarest half of statements is looked up,
since two texts that share more than half of both their statements must meet
there, and the candidates' coverage is then counted exactly. Every look-up is a
semi-join with the batch's own hashes first, so no stored text is read again and
nothing is aggregated over all of history. Texts with equal statements are one
class, so copies cost one look-up.

A statement that a batch holds more than HOT_ROWS times, or that is known as hot,
goes to a table of its own that is spread by class, so none fills a bucket.
compact() rewrites the tables in buckets that suit their size, one file each, and
sets apart what has become hot over many small batches.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspring.llm.han import WIDE_FROM, WIDE_TO, Tables, tables
from wayspring.runtime import materialize, scratch_path, table

# Wordings that say the same, the second kept. Those of equal length
# whose characters stand for nothing else in statements are replaced character by
# character, along with width and script; the rest as phrases.
ALIKE = (("半日", "半天"), ("要是", "如果"), ("特别", "尤其"), ("推荐", "建议"), ("尽量", "最好"), ("入口", "门口"), ("周边", "附近"), ("据说", "听说"))
PHRASES = (("想不到", "没想到"), ("别忘了", "记得"), ("径直", "直接"), ("差不多", "大约"))
LATIN_PHRASES = (
    ("be sure to try ", "don't miss "), ("close to ", "near "), ("suggested", "recommended"), ("needs ", "takes "), ("need ", "take "), ("roughly", "about"),
)
_ALIKE = sorted({(x, y) for a, b in ALIKE for x, y in zip(a, b) if x != y})
_FROM = "".join(x for x, _ in _ALIKE)
_TO = "".join(y for _, y in _ALIKE)
LEAST_STATEMENT = 8  # letters and digits of a statement; a text of shorter fragments only has those as its statements
BUCKETS, BUCKET_ROWS = 16, 2_000_000  # the least number of buckets; rows to a bucket when tables are made or compacted
HOT_ITEMS, HOT_ROWS = 64, 10_000  # a statement is hot in a batch above 1/64 of its statements and 10,000 rows; in a compacted table above 10,000
_ENDS = r"[。！？!?；;：【】\n\r#]|\.(?![\p{L}\p{N}])|(?<![0-9]):(?![0-9])"


def _normal(text: Column, han: Tables) -> Column:
    """text in one script, width, case and wording; marks stay."""
    old, new = han.traditional
    t = F.translate(F.coalesce(text, F.lit("")), WIDE_FROM + old + "’" + _FROM, WIDE_TO + new.translate(str.maketrans(_FROM, _TO)) + "'" + _TO)
    t = F.lower(F.regexp_replace(t, r"</?[A-Za-z][^<>]*>", "\n"))
    for a, b in PHRASES:
        t = F.replace(t, F.lit(a.translate(str.maketrans(_FROM, _TO))), F.lit(b))
    latin = t
    for a, b in LATIN_PHRASES:
        latin = F.replace(latin, F.lit(a), F.lit(b))
    t = F.when(t.rlike("[a-z] [a-z]"), latin).otherwise(t)
    return F.regexp_replace(t, r"(?<=[0-9])\.(?=[0-9])", "点")


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _parts(text: Column, han: Tables) -> Column:
    """struct(whole, hashes): the hash of a text's letters and digits, null if it
    has none, and those of its distinct statements, sorted."""
    parts = F.filter(F.transform(F.split(_normal(text, han), _ENDS), lambda s: F.regexp_replace(s, r"[^\p{L}\p{N}]", "")), lambda s: F.length(s) > 0)

    def hashed(parts: Column) -> Column:
        long = F.filter(parts, lambda s: F.length(s) >= LEAST_STATEMENT)
        units = F.transform(F.when(F.size(long) > 0, long).otherwise(parts), lambda s: F.xxhash64(s))
        return F.struct(F.when(F.size(parts) > 0, _digest(F.array_join(parts, ""))).alias("whole"), F.array_sort(F.array_distinct(units)).alias("hashes"))

    return F.transform(F.array(parts), hashed)[0]  # binds the parts, so a text is normalised once


def statements(text: Column, han: Tables) -> Column:
    """array<bigint>: hashes of the distinct statements of a text; empty for null,
    blank and wordless texts."""
    return _parts(text, han)["hashes"]


def fingerprints(df: DataFrame, key: str, text: str, batch: str, title: str | None = None) -> DataFrame:
    """(key, batch, class, whole, hashes, extra) of rows with at least one statement.

    extra: statements of the title that the text lacks; a row without text stands
    for its title. Rows repeated under one key and batch count once. class is a
    128-bit hash of both sets; a null batch counts as the first (the least integer)."""
    han = tables(df.sparkSession)
    named = F.col(title) if title else F.lit(None).cast("string")
    f = df.select(
        F.col(key).alias("key"), F.coalesce(F.col(batch), F.lit(-(2**31))).cast("int").alias("batch"), _parts(F.col(text), han).alias("t"),
        (_parts(named, han) if title else F.struct(F.lit(None).cast("binary").alias("whole"), F.array().cast("array<bigint>").alias("hashes"))).alias("n"),
    )
    bare = F.size("t.hashes") == 0
    f = f.select("key", "batch", F.when(bare, F.col("n")).otherwise(F.col("t")).alias("x"), F.when(bare, F.array().cast("array<bigint>")).otherwise(F.array_except("n.hashes", "t.hashes")).alias("extra"))
    f = f.select("key", "batch", "x.whole", "x.hashes", "extra")
    f = f.withColumn("class", _digest(F.concat_ws("|", F.array_join("hashes", ","), F.array_join("extra", ","))))
    return f.dropDuplicates(["key", "batch", "class", "whole"]).where(F.size("hashes") > 0)  # only now: a filter before would hash every text again


TABLES = {"exact": "whole", "classes": "class", "statements": "h", "hot": "class", "members": "class"}


class History:
    """Hash tables of everything accepted: exact (whole, class, batch), classes
    (class, n, hashes, extra, batch), statements and hot (h, class, n, m, batch) and
    members (class, key, batch)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = f"wayspring_history_{uuid.uuid4().hex}"
        self.started = False
        self.version = 0
        self.path = scratch_path(spark, "history")
        atexit.register(self.drop)

    def drop(self) -> None:
        try:
            for v in range(self.version + 1):
                for t in TABLES:
                    self.spark.sql(f"drop table if exists {self.name}_{v}_{t}")
        except Exception:  # the session is gone; the folder is removed by its own hook
            pass

    def _put(self, df: DataFrame, name: str, mode: str) -> None:
        by = TABLES[name]
        bucketed = name not in ("hot", "members")  # these hold keys that may be a third of all rows; AQE splits their joins
        writer = (df.repartition(self.buckets, by) if bucketed else df).write.format("parquet").option("path", f"{self.path}/{self.version}/{name}")
        if bucketed:
            writer = writer.bucketBy(self.buckets, by).sortBy(by)
        writer.mode(mode).saveAsTable(f"{self.name}_{self.version}_{name}")

    def append(self, df: DataFrame, key: str = "rid", text: str = "content", batch: str = "batch_no", title: str | None = None) -> None:
        """Accept rows: only they are read and hashed."""
        new = materialize(fingerprints(df, key, text, batch, title), "fingerprints")
        per = new.groupBy("class").agg(F.first("hashes").alias("hashes"), F.first("extra").alias("extra"), F.min("batch").alias("batch")).withColumn("n", F.size("hashes"))
        per = materialize(per, "classes")
        each = per.select(F.explode(F.concat("hashes", "extra")).alias("h"), "class", "n", (F.col("n") + F.size("extra")).alias("m"), "batch")
        items, rows = self._hot(each)
        if self.buckets is None:
            self.buckets = max(BUCKETS, -(-rows // BUCKET_ROWS))
        hot = F.col("h").isin(items)
        if self.started and not self["hot"].isEmpty():
            known = self["hot"].groupBy("h").agg(F.lit(True).alias("known"))  # a few rows: AQE measures them
            each = each.join(known, "h", "left")
            hot = hot | F.coalesce("known", F.lit(False))
        mode, columns = "append" if self.started else "overwrite", ("h", "class", "n", "m", "batch")
        self._put(each.where(~hot).select(*columns), "statements", mode)
        self._put(each.where(hot).select(*columns), "hot", mode)
        self._put(per.select("class", "n", "hashes", "extra", "batch"), "classes", mode)
        self._put(new.groupBy("whole", "class").agg(F.min("batch").alias("batch")), "exact", mode)
        self._put(new.select("class", "key", "batch").distinct(), "members", mode)
        self.started = True

    @staticmethod
    def _hot(each: DataFrame) -> tuple[list[int], int]:
        """The hot statements of a batch, at most HOT_ITEMS, and its rows: one row is collected."""
        top = each.agg(F.expr(f"approx_top_k(h, {HOT_ITEMS}, 10000)").alias("top"), F.count("*").alias("n")).first()
        return [x["item"] for x in top["top"] or [] if x["count"] > HOT_ROWS and x["count"] * HOT_ITEMS > top["n"]], top["n"]

    def compact(self) -> None:
        """Rewrite the tables with the appended files of each bucket as one, in as many
        buckets as their rows need, statements that have become hot set apart. No
        text is read. Matches stay the same."""
        if not self.started:
            return
        old = {t: self[t] for t in TABLES}
        self.version += 1
        both = old["statements"].unionByName(old["hot"])
        self.buckets = max(BUCKETS, -(-both.count() // BUCKET_ROWS))
        hot = both.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > HOT_ROWS).select("h", F.lit(True).alias("known"))
        placed = both.join(materialize(hot, "hot"), "h", "left")
        self._put(placed.where("known is null").drop("known"), "statements", "overwrite")
        self._put(placed.where("known").drop("known"), "hot", "overwrite")
        for t in ("classes", "exact", "members"):
            self._put(old[t], t, "overwrite")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{self.version}_{name}")

    def match(self, df: DataFrame, key: str = "id", text: str = "content", batch: str = "batch_no") -> DataFrame:
        """(key, stored, batch, stored_batch, coverage): rows of df with the stored
        rows of earlier batches they repeat: copies of the whole content, and texts
        of which more than half of the statements of each are the other's (a
        stored title's count for the new row's). coverage is the shared part of the
        smaller side's.

        Rows and stored texts without statements match nothing. Equal texts stored
        under several keys all come out."""
        if not self.started:
            return self.spark.createDataFrame([], "key string, stored string, batch int, stored_batch int, coverage double")
        new = materialize(fingerprints(df, key, text, batch), "batch")
        mine = new.groupBy("class").agg(F.first("hashes").alias("hashes"), F.max("batch").alias("latest"))
        wholes = new.groupBy("whole", F.col("class").alias("a")).agg(F.max("batch").alias("latest"))
        full = wholes.join(self["exact"].select("whole", F.col("class").alias("b"), F.col("batch").alias("first")), "whole").where("first < latest")
        full = full.select("a", "b", F.lit(1.0).alias("coverage")).distinct()
        spread = mine.select("class", F.explode("hashes").alias("h"))
        asked = spread.select("h").distinct()
        common = self["statements"].select("h").unionByName(self["hot"].select("h")).join(asked, "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
        ranked = spread.join(common, "h").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o"))
        ranked = ranked.join(mine.select("class", F.size("hashes").alias("n"), "latest"), "class").where(F.size("o") * 2 > F.col("n"))
        # statements unknown to history are rarest of all: they fill the prefix first
        known = F.col("n") - F.floor(F.col("n") / 2) - (F.col("n") - F.size("o"))
        probe = ranked.where(known > 0).select(F.col("class").alias("a"), "n", "latest", F.explode(F.slice("o", F.lit(1), known.cast("int"))).alias("s"))
        probe = probe.select("a", F.col("n").alias("n_a"), "latest", F.col("s.h").alias("h"))
        side = [F.col("h"), F.col("class").alias("b"), F.col("n").alias("n_b"), "m", F.col("batch").alias("first")]
        cand = probe.join(self["statements"].select(*side), "h").unionByName(probe.join(self["hot"].select(*side), "h"))
        cand = materialize(cand.where("first < latest and n_a < 2 * m and n_b < 2 * n_a").select("a", "b").distinct(), "candidates")
        stored = self["classes"].join(cand.select(F.col("b").alias("class")).distinct(), "class", "left_semi")
        stored = stored.groupBy("class").agg(F.first("hashes").alias("y"), F.first("extra").alias("z")).withColumnRenamed("class", "b")
        both = cand.join(mine.select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a").join(stored, "b")
        both = both.withColumn("shared", F.size(F.array_intersect("x", "y"))).withColumn("named", F.size(F.array_intersect("x", "z")))
        part = both.where(((F.col("shared") + F.col("named")) * 2 > F.size("x")) & (F.col("shared") * 2 > F.size("y")))
        part = part.select("a", "b", (F.col("shared") / F.least(F.size("x"), F.size("y"))).alias("coverage"))
        pairs = full.unionByName(part).groupBy("a", "b").agg(F.max("coverage").alias("coverage"))
        rows = pairs.join(new.select(F.col("class").alias("a"), "key", "batch").distinct(), "a")
        rows = rows.join(self["members"].select(F.col("class").alias("b"), F.col("key").alias("stored"), F.col("batch").alias("stored_batch")), "b")
        return rows.where("stored_batch < batch").select("key", "stored", "batch", "stored_batch", "coverage")


def p3_found(spark, sf_dir: str) -> DataFrame:
    """All batches at once: the batch numbers bound every match, so the result
    is that of matching each batch on arrival and appending it afterwards."""
    history = History(spark)
    history.append(table(spark, sf_dir, "knowledge_entries"), title="title")
    found = history.match(table(spark, sf_dir, "contributions"))
    return found.select(F.col("key").alias("contribution_id"), F.col("stored").cast("long").alias("rid")).distinct()


QUERIES = {"p3_found": p3_found}
ORACLE: dict[str, str] = {}
