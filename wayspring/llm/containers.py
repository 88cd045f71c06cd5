"""Filling fixed-capacity containers with whole documents.

Sizes are token counts, so an instance of any number of documents is a
histogram of at most `capacity` sizes. That histogram, whose length does not
grow with the data, is packed on the driver; the packing, a list of patterns
with repeat counts, is then applied to the documents in parallel by their rank
within their size.

Reduction (Martello-Toth): taking sizes from the largest, a set of one to two
items that provably dominates every other feasible set with that item is fixed
for good: the item alone if nothing fits beside it; the pair that fills the
container exactly; the item with the largest partner if no third item fits, or
if no two further items outweigh that partner. The remainder is packed by best
fit: the largest item, then again and again the size, or exact pair of sizes,
that leaves the least room.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayspring.llm.token_ids import NAME, TOKENIZERS, token_counts
from wayspring.runtime import materialize, table

CAPACITY = 2048

Pattern = tuple[tuple[int, ...], int]  # sizes in one container, number of such containers


class _Sizes:
    """A multiset of sizes with its present sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, sizes: tuple[int, ...], times: int) -> None:
        for s in sizes:
            self.n[s] -= times
        for s in {*sizes}:
            if not self.n[s]:
                del self.n[s]
                self.order.pop(bisect.bisect_left(self.order, s))

    def times(self, sizes: tuple[int, ...]) -> int:
        return min(self.n.get(s, 0) // sizes.count(s) for s in {*sizes})

    def largest(self, room: int, held: tuple[int, ...] = ()) -> int | None:
        """The largest size of at most room with an item beyond those held."""
        i = bisect.bisect_right(self.order, room) - 1
        while i >= 0 and self.n[self.order[i]] <= held.count(self.order[i]):
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, k: int, held: tuple[int, ...]) -> int | None:
        """Sum of the k smallest items beyond those held; None if there are fewer."""
        total = 0
        for s in self.order:
            c = min(k, self.n[s] - held.count(s))
            if c > 0:
                total += s * c
                k -= c
            if not k:
                return total
        return None

    def best_pair(self, room: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """Two items beyond those held with the largest sum of at most room."""
        lo, hi, best = 0, bisect.bisect_right(self.order, room) - 1, None
        free = lambda s: self.n[s] - held.count(s)
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if free(a) < 1:
                lo += 1
            elif free(b) < 1 or a + b > room:
                hi -= 1
            elif a == b and free(a) < 2:
                break
            else:
                if best is None or a + b > sum(best):
                    best = (a, b)
                if a + b == room:
                    break
                lo += 1
        return best


def dominant(sizes: _Sizes, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates all feasible sets with j, if one is proven."""
    room = capacity - j
    k = sizes.largest(room, (j,))
    if k is None:
        return (j,)
    if k == room:
        return (j, k)
    two, three = sizes.smallest(2, (j,)), sizes.smallest(3, (j,))
    if two is None or two > room:
        return (j, k)
    if three is None or three > room:
        pair = sizes.best_pair(room, (j,))
        if pair is None or sum(pair) <= k:
            return (j, k)
    return None


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns for a histogram {size: count}, every size within 1..capacity."""
    sizes, out = _Sizes(counts), []
    for j in sorted(counts, reverse=True):
        while j in sizes.n:
            f = dominant(sizes, j, capacity)
            if f is None:
                break
            times = sizes.times(f)
            sizes.take(f, times)
            out.append((f, times))
    while sizes.order:
        held: tuple[int, ...] = (sizes.order[-1],)
        room = capacity - held[0]
        while room and (k := sizes.largest(room, held)) is not None:
            add: tuple[int, ...] = (k,)
            if k < room and (pair := sizes.best_pair(room, held)) is not None and sum(pair) == room:
                add = pair
            held += add
            room -= sum(add)
        times = sizes.times(held)
        sizes.take(held, times)
        out.append((held, times))
    return out


def _ranges(patterns: list[Pattern], first: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, items per container and first container of each
    pattern that uses it, in order of rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    for held, times in patterns:
        for s in {*held}:
            per = held.count(s)
            rows.setdefault(s, []).append((used.get(s, 0), per, first))
            used[s] = used.get(s, 0) + per * times
        first += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for s, r in rows.items()}


def fill(sizes: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, part, first_token, n_tokens, container): a container for every item.

    Items of null, zero or negative size get no row; an item over the capacity
    is cut into full containers and a rest that is packed like any other item.
    Items repeated under a key are items of their own. Containers are numbered
    from 0; equal sizes are told apart by their key and place of storage, so
    the number of containers and their fill never depend on ties."""
    n = F.col(size).cast("long")
    parts = sizes.where(n > 0).select(F.col(key), n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))).alias("part"))
    size_of = F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part") * F.lit(capacity))
    parts = parts.select(key, "part", size_of.cast("int").alias("n_tokens"), F.spark_partition_id().alias("place"))
    parts = materialize(parts, "parts")
    histogram = {r["n_tokens"]: r["n"] for r in parts.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = _ranges(pack(histogram, capacity), 0)

    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, r in batches:
            out = np.empty(len(s), dtype=np.int64)
            order = np.argsort(s.to_numpy(), kind="stable")
            sv, rv = s.to_numpy()[order], r.to_numpy()[order]
            edges = np.flatnonzero(np.diff(sv)) + 1
            for at in np.split(np.arange(len(sv)), edges):
                if len(at):
                    starts, per, first = plan[int(sv[at[0]])]
                    i = np.searchsorted(starts, rv[at], side="right") - 1
                    out[order[at]] = first[i] + (rv[at] - starts[i]) // per[i]
            yield pd.Series(out)

    container.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    here = parts.groupBy("place", "n_tokens").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = here.select("place", "n_tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("place", "n_tokens").orderBy(key, "part")) - 1
    ranked = parts.withColumn("nth", within).join(offsets, ["place", "n_tokens"]).withColumn("nth", F.col("nth") + F.col("offset"))
    return ranked.select(
        key, "part", (F.col("part").cast("long") * capacity).alias("first_token"), "n_tokens",
        F.pandas_udf(container, "long")("n_tokens", "nth").alias("container"),
    )


def p9_containers(spark, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    return fill(token_counts(table(spark, sf_dir, "documents"), folder=folder, name=NAME))


def p9_fill(spark, sf_dir: str) -> DataFrame:
    """One row: containers used, the least possible number by volume, tokens, fill."""
    per = p9_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("held"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("held"), F.lit(0)).alias("tokens"), F.coalesce(F.max("held"), F.lit(0)).alias("fullest"))
    return total.select("containers", F.ceil(F.col("tokens") / CAPACITY).alias("least_containers"), "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("fill"))


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLE: dict[str, str] = {}
