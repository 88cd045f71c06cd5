"""References to records that do not exist, are deleted or arrive later.

Plan: references are pre-aggregated per key and period, with their first and
last moment, which decides a whole group at once save where the target was born
between the two. A key that holds more than 1/HEAVY_SHARE of all references is
heavy (at most HEAVY_SHARE of them can exist, whatever the data's size). Heavy
keys are checked against their few targets by broadcast, the rest by a shuffle
join, and both outcomes are united. Counts are sums over groups; rows are looked
up only for groups with orphans, heavy ones again by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspring.functions import key, micros, moment
from wayspring.runtime import materialize, table

HEAVY_SHARE = 1000
SOME_LATE = "some late"


def references(df: DataFrame, tbl: str, row_id: str, ref: str, at: Column) -> DataFrame:
    """(tbl, row_id, ref, at) of the rows of df with a non-blank reference.

    A row repeated under the same row_id counts once; a null row_id is kept as
    null and counts once per (ref, at). Columns of df with other names are ignored."""
    out = df.select(F.lit(tbl).alias("tbl"), F.col(row_id).cast("long").alias("row_id"), key(F.col(ref)).alias("ref"), at.alias("at"))
    return out.where(F.col("ref").isNotNull()).dropDuplicates(["row_id", "ref", "at"])


def targets(df: DataFrame, tbl: str, key_col: str) -> DataFrame:
    """One row per normalised key: (tbl, ref, gone, born)."""
    k = df.select(key(F.col(key_col)).alias("ref"), F.col("deleted_at").isNotNull().alias("gone"), micros(F.col("created_at")).alias("born"))
    return k.where(F.col("ref").isNotNull()).groupBy("ref").agg(F.max("gone").alias("gone"), F.min("born").alias("born")).select(F.lit(tbl).alias("tbl"), "ref", "gone", "born")


def _judge(j: DataFrame) -> DataFrame:
    """Groups with orphans: reason, or "some late" where moments must be compared row by row."""
    late = F.when(F.col("born") > F.col("hi"), "late").when(F.col("born") > F.col("lo"), SOME_LATE)
    reason = F.when(F.col("hit").isNull(), "missing").when(F.col("gone"), "deleted").otherwise(late)
    return j.select("tbl", "ref", "period", "n", "born", reason.alias("reason")).where("reason is not null")


class Orphans:
    """References whose target is missing, deleted or younger.

    refs: (tbl, row_id, ref, at microseconds); tgts: (tbl, ref, gone, born). Both
    are read several times: pass written tables. A null `at` or `born` can't be
    late. Empty refs give no rows; empty tgts make every reference missing."""

    def __init__(self, refs: DataFrame, tgts: DataFrame, heavy_share: int = HEAVY_SHARE):
        self.refs = refs.withColumn("period", F.coalesce(F.date_format(F.timestamp_micros("at"), "yyyy-MM"), F.lit("")))
        groups = materialize(self.refs.groupBy("tbl", "ref", "period").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")), "groups")
        total = groups.agg(F.sum("n").alias("total"))
        heavy = groups.groupBy("tbl", "ref").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total))  # one row
        self.heavy = F.broadcast(materialize(heavy.where(F.col("n") * heavy_share > F.col("total")).select("tbl", "ref"), "heavy"))  # at most heavy_share rows
        key, hit = ["tbl", "ref"], F.lit(True).alias("hit")
        near = F.broadcast(tgts.join(self.heavy, key, "left_semi").select("*", hit))
        self.hot = _judge(groups.join(self.heavy, key, "left_semi").join(near, key, "left"))
        cold = _judge(groups.join(self.heavy, key, "left_anti").join(tgts.select("*", hit), key, "left"))
        self.cold = materialize(cold, "orphan_groups")

    def rows(self) -> DataFrame:
        """(tbl, row_id, ref, at, period, reason), one per orphan row."""
        by = ["tbl", "ref", "period"]
        hot = self.refs.join(F.broadcast(self.hot), by)  # heavy keys times periods
        cold = self.refs.join(self.heavy, ["tbl", "ref"], "left_anti").join(self.cold, by)
        return self._rows(hot).unionByName(self._rows(cold))

    @staticmethod
    def _rows(j: DataFrame) -> DataFrame:
        some = F.col("reason") == SOME_LATE
        j = j.where(~some | (F.col("born") > F.col("at")))
        return j.select("tbl", "row_id", "ref", "at", F.when(F.col("period") != "", F.col("period")).alias("period"), F.when(some, "late").otherwise(F.col("reason")).alias("reason"))

    def counts(self) -> DataFrame:
        """(tbl, period, reason, n): orphan rows; rows are read only where a target was
        born within the group."""
        both = self.hot.unionByName(self.cold)
        whole = both.where(F.col("reason") != SOME_LATE).select("tbl", "period", "reason", "n")
        some = both.where(F.col("reason") == SOME_LATE).select("tbl", "ref", "period", "born")
        part = self.refs.join(some, ["tbl", "ref", "period"]).where("born > at").groupBy("tbl", "period").agg(F.count("*").alias("n"))
        all_ = whole.unionByName(part.select("tbl", "period", F.lit("late").alias("reason"), "n"))
        return all_.groupBy(F.when(F.col("period") != "", F.col("period")).alias("period"), "tbl", "reason").agg(F.sum("n").alias("n")).select("tbl", "period", "reason", "n")


def corpus_orphans(spark, sf_dir: str) -> Orphans:
    """Orphans of the three declared references."""
    t = lambda n: table(spark, sf_dir, n)
    refs = [
        references(t("messages"), "messages", "id", "session_id", moment(F.col("created_at"))),
        references(t("user_history"), "user_history", "id", "user_id", micros(F.col("created_at"))),
        references(t("knowledge_entries"), "knowledge_entries", "rid", "submission_id", micros(F.col("created_at"))),
    ]
    tgts = [
        targets(t("sessions"), "messages", "session_id"),
        targets(t("users"), "user_history", "id"),
        targets(t("contributions"), "knowledge_entries", "id"),
    ]
    union = lambda xs: reduce(DataFrame.unionByName, xs)
    return Orphans(materialize(union(refs), "references"), materialize(union(tgts), "targets"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return corpus_orphans(spark, sf_dir).rows().select("tbl", "period", "row_id", "reason")


def p7_per_period(spark, sf_dir: str) -> DataFrame:
    """Orphan counts per table, month and reason."""
    return corpus_orphans(spark, sf_dir).counts()


QUERIES = {"p7_found": p7_found, "p7_per_period": p7_per_period}

_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '', 'g')), '')"
_MOMENT = (
    "case when regexp_matches(created_at, '^-?[0-9]+$') then epoch_ms(try_cast(created_at as bigint)) "
    "when regexp_matches(created_at, '([Zz]|[+-][0-9]{2}:?[0-9]{2})$') and regexp_matches(created_at, ':') then (try_cast(created_at as timestamptz) at time zone 'UTC') "
    "else try_cast(created_at as timestamp) end"
)
_ORPHANS = f"""
with refs as (
  select distinct 'messages' as tbl, id as row_id, {_KEY.format('session_id')} as ref, {_MOMENT} as at from messages
  union all select distinct 'user_history', id, {_KEY.format('user_id')}, created_at from user_history
  union all select distinct 'knowledge_entries', rid, {_KEY.format('submission_id')}, created_at from knowledge_entries),
tgts as (
  select 'messages' as tbl, {_KEY.format('session_id')} as ref, bool_or(deleted_at is not null) as gone, min(created_at) as born from sessions group by 2
  union all select 'user_history', {_KEY.format('id')}, bool_or(deleted_at is not null), min(created_at) from users group by 2
  union all select 'knowledge_entries', {_KEY.format('id')}, bool_or(deleted_at is not null), min(created_at) from contributions group by 2),
found as (
  select r.tbl, strftime(r.at, '%Y-%m') as period, r.row_id,
    case when t.ref is null then 'missing' when t.gone then 'deleted' when t.born > r.at then 'late' end as reason
  from refs r left join tgts t on r.tbl = t.tbl and r.ref = t.ref where r.ref is not null)
"""
ORACLE = {
    "p7_found": _ORPHANS + "select tbl, period, row_id, reason from found where reason is not null",
    "p7_per_period": _ORPHANS + "select tbl, period, reason, count(*) as n from found where reason is not null group by 1, 2, 3",
}
