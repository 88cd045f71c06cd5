import datetime as dt

from pyspark.sql import functions as F

from wayspring.functions import key, micros, moment, visible
from wayspring.operators.integrity import Orphans, references, targets

T0 = dt.datetime(2025, 1, 2, 3, 4, 5)


def test_keys_blank_case_and_width(spark):
    df = spark.createDataFrame([(" Ab\t",), ("​",), (None,), ("",), ("x y",)], "k string")
    assert [r[0] for r in df.select(key(F.col("k"))).collect()] == ["ab", None, None, None, "x y"]
    assert [r[0] for r in df.select(visible(F.col("k"))).collect()] == [True, False, False, False, True]


def test_moments(spark):
    rows = ["2025-01-01T00:00:00Z", "2025-01-01T08:00:00+08:00", "2025-01-01 00:00:00", "1735689600000", "soon", None, ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(moment(F.col("t"))).collect()] == [1735689600000000] * 4 + [None] * 3


def _frames(spark):
    refs = spark.createDataFrame(
        [(1, "A", T0), (1, "A", T0), (2, " a ", T0), (3, "gone", T0), (4, "none", T0), (5, None, T0), (6, "young", T0), (7, "young", None), (None, "none", T0)],
        "id long, ref string, at timestamp_ntz",
    ).withColumn("hit", F.lit("extra")).withColumn("gone", F.lit(1))
    tgts = spark.createDataFrame(
        [("a", T0, None), ("a", T0, None), ("GONE", T0, T0), ("young", T0 + dt.timedelta(days=1), None), (None, T0, None)],
        "k string, created_at timestamp_ntz, deleted_at timestamp_ntz",
    ).withColumn("ref", F.lit("clash"))
    return references(refs, "t", "id", "ref", micros(F.col("at"))), targets(tgts, "t", "k")


def test_reasons_repeats_and_nulls(spark):
    r, t = _frames(spark)
    got = sorted(((x.row_id or -1), x.reason) for x in Orphans(r, t).rows().collect())
    assert got == [(-1, "missing"), (3, "deleted"), (4, "missing"), (6, "late")]


def test_heavy_keys_change_nothing(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", T0) for i in range(900)]
    refs = references(spark.createDataFrame(rows, "id long, ref string, at timestamp_ntz"), "t", "id", "ref", micros(F.col("at")))
    tgts = targets(spark.createDataFrame([("hot", T0, T0)], "k string, created_at timestamp_ntz, deleted_at timestamp_ntz"), "t", "k")
    split = {(r.row_id, r.reason) for r in Orphans(refs, tgts, heavy_share=1000).rows().collect()}
    plain = {(r.row_id, r.reason) for r in Orphans(refs, tgts, heavy_share=1).rows().collect()}
    assert split == plain and len(split) == 900
    assert sum(x[1] == "deleted" for x in split) == 600


def test_empty_tables(spark):
    r, t = _frames(spark)
    assert Orphans(r.where("false"), t).rows().count() == 0
    assert {x.reason for x in Orphans(r, t.where("false")).rows().collect()} == {"missing"}


def test_counts_equal_rows_also_where_a_target_is_born_within_a_period(spark):
    at = lambda d: T0 + dt.timedelta(days=d)
    rows = [(i, f"k{i % 7}", at(i % 70)) for i in range(400)] + [(1000, None, T0), (1001, "k1", None), (1002, "none", None)]
    tgts = [(f"k{i}", at(12 * i), at(1) if i == 4 else None) for i in range(6)]
    r = references(spark.createDataFrame(rows, "id long, ref string, at timestamp_ntz"), "t", "id", "ref", micros(F.col("at")))
    t = targets(spark.createDataFrame(tgts, "k string, created_at timestamp_ntz, deleted_at timestamp_ntz"), "t", "k")
    want = {}
    born = {k: b for k, b, _ in tgts}
    for i, k, a in rows:
        why = None if k is None else "missing" if k not in born else "deleted" if k == "k4" else "late" if a and born[k] > a else None
        if why:
            want.setdefault((a.strftime("%Y-%m") if a else None, why), []).append(i)
    for share in (1000, 1):
        o = Orphans(r, t, share)
        assert {(x.period, x.reason): x.n for x in o.counts().collect()} == {k: len(v) for k, v in want.items()}
        got = {}
        for x in o.rows().collect():
            got.setdefault((x.period, x.reason), []).append(x.row_id)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
