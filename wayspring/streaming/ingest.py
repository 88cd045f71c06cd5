"""Submissions as a stream: micro-batches are moderated and appended idempotently,
messages are grouped into activity sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspring.operators.quality import moderation
from wayspring.runtime import exists


def stream_submissions(stream: DataFrame, store: str, checkpoint: str, once: bool = True):
    """Start the upkeep of the parquet store at `store` from a stream of (id, city,
    title, content). A batch that is replayed, or repeats an id, changes nothing:
    each goes to its own folder and ids already stored are left out. Ids stand in
    folders of their own by a hash of the id, so a batch reads only the ids of its
    folders and no text. Failures to read the store fail the batch."""
    data, ids, parts = f"{store}/data", f"{store}/ids", 64

    def accept(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        good = batch.where(moderation(F.col("city"), F.col("content")).isNull()).dropDuplicates(["id"]).withColumn("part", part)
        if exists(spark, ids):
            mine = sorted(r["part"] for r in good.select("part").distinct().collect())  # at most 64 numbers
            known = spark.read.schema("id string, part int, batch long").parquet(ids).where(F.col("part").isin(*mine) & (F.col("batch") != number))
            good = good.join(known.select("id").distinct(), "id", "left_anti")
        kept = f"{data}/batch={number}"
        good.drop("part").write.mode("overwrite").parquet(kept)
        done = spark.read.schema(batch.schema).parquet(kept).select("id", part.alias("part"), F.lit(number).cast("long").alias("batch"))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(ids)

    writer = stream.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of (session_id, at timestamp): bounds and message counts;
    rows later than `late` behind the newest are left out by the watermark."""
    seen = stream.withWatermark("at", late)
    w = F.session_window("at", gap)
    return seen.groupBy("session_id", w).agg(F.count("*").alias("n")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
