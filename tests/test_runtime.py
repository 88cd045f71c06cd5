import shutil

from pyspark.sql import functions as F

from wayspring.runtime import beside, exists, materialize_buckets, once, version


def test_once_is_built_once_per_version_and_again_when_swept(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    first = version(spark, str(tmp_path), "t")
    a = once(spark, "thing", first, build)
    assert a.count() == 5 and once(spark, "thing", first, build).count() == 5 and len(calls) == 1
    spark.range(4).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert version(spark, str(tmp_path), "t") != first
    once(spark, "thing", version(spark, str(tmp_path), "t"), build)
    assert len(calls) == 2
    shutil.rmtree(a.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert once(spark, "thing", first, build).count() == 5 and len(calls) == 3


def test_buckets_group_where_rows_lie(spark):
    t = materialize_buckets(spark.range(100).select((F.col("id") % 7).alias("k"), "id").repartition(4, "k"), "rows", "k", 4)
    per = t.groupBy("id", "k").agg(F.count("*").alias("n"))
    assert "Exchange" not in per._jdf.queryExecution().executedPlan().toString() and per.count() == 100


def test_beside_broadcasts_by_measured_size_only(spark):
    big, small = spark.range(1000), spark.range(10)
    plan = lambda n: big.join(beside(small, "side", n), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10) and "strategy=shuffle_hash" in plan(9)
    assert exists(spark, "file:///tmp") and not exists(spark, "file:///tmp/no such folder")
