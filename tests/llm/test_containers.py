import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayspring.llm.containers import _Sizes, dominant, fill, pack


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12))
def test_packing_is_whole_and_fits(counts):
    used = {}
    for held, times in pack(counts, 30):
        assert sum(held) <= 30 and times > 0
        for s in held:
            used[s] = used.get(s, 0) + times
    assert used == counts


def least_bins(sizes, cap):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= cap:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_container():
    rnd = random.Random(4)
    fixed = 0
    for _ in range(150):
        cap = rnd.choice([10, 12, 15])
        sizes = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(2, 8))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        f = dominant(_Sizes(counts), sizes[0], cap)
        if f is None:
            continue
        fixed += 1
        rest = list(sizes)
        for s in f:
            rest.remove(s)
        assert 1 + least_bins(rest, cap) == least_bins(sizes, cap)
    assert fixed > 50


def run(spark, rows, cap=10):
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("part", F.lit("clash")).withColumn("place", F.lit(1)).withColumn("container", F.lit(1))
    return fill(df, cap).collect()


def test_documents_stay_whole_and_long_ones_are_cut(spark):
    rows = [(i, 1 + i % 9) for i in range(500)] + [(1000, 25), (1001, 20), (1002, 10), (1003, 0), (1004, None), (1005, -3)]
    got = run(spark, rows)
    held, parts = {}, {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.part, r.first_token, r.n_tokens))
    assert max(held.values()) <= 10
    assert set(parts) == {i for i, n in rows if n and n > 0}
    for i, n in rows:
        if n and n > 0:
            p = sorted(parts[i])
            assert sum(x[2] for x in p) == n and len(p) == -(-n // 10)
            assert [x[1] for x in p] == [10 * k for k in range(len(p))]
    total = sum(n for _, n in rows if n and n > 0)
    assert sorted(held) == list(range(len(held))) and len(held) <= -(-total // 10) + 1


def test_a_third_of_all_rows_of_one_size(spark):
    got = run(spark, [(i, 3) for i in range(3000)] + [(5000 + i, 7) for i in range(3000)])
    assert len({r.container for r in got}) == 3000


@pytest.mark.parametrize("rows", [[], [(1, 0)], [(1, None)]])
def test_nothing_to_pack(spark, rows):
    assert run(spark, rows) == []


def test_repeated_keys_are_items(spark):
    assert len(run(spark, [(1, 5), (1, 5), (1, 5)])) == 3
    assert list(itertools.islice(pack({}), 1)) == []
