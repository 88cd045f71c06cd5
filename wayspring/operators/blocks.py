"""The corpus in blocks: the postings of some thousand entries packed in one row, so
that a task scores all questions against them with array arithmetic.

A block holds its entries in order of (city, rid): a city is a range of places, and
the postings of a token, places in order, are cut to a city by two binary searches.
Questions are packed too, in files of the shared folder that every task reads, and
meet every block; what comes out per question and block are a few numbers or the best
k, never a row per match.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayspring.functions.text import search_text
from wayspring.runtime import materialize, once, ship, table, version

BLOCK_ENTRIES, PACK_QUESTIONS = 16_384, 16_384
TASK_QUESTIONS = 16_384  # of one task, unless a pack has more: what it keeps for each does not grow with their number
DIMS = 64  # of a hashing vector
TASK_BLOCKS = 16  # of one task, where there are blocks for more tasks than cores: questions are unpacked once a task, and what its first blocks find spares work on the next
_HAN, _N_HAN = 0x4E00, 0x9FFF - 0x4E00 + 1
_WORDS = 1 << 40  # codes of words in Latin letters begin here
_LATIN = re.compile("[a-z0-9]+")
BLOCK = "rids binary, dl binary, cities array<string>, starts array<int>, tokens array<string>, dims binary, df array<int>, places binary, tf binary, n long, total long"


# ---------------------------------------------------------------- packing


class _Codes:
    """Tokens (see functions.text.tokens) of lower-case texts as whole numbers."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, code) of every token."""
        all_ = "\n".join(texts) + "\n"
        cp = np.frombuffer(all_.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        han = (cp >= _HAN) & (cp < _HAN + _N_HAN)
        pair = np.flatnonzero(han[:-1] & han[1:])
        before, after = np.concatenate([[False], han[:-1]]), np.concatenate([han[1:], [False]])
        lone = np.flatnonzero(han & ~before & ~after)
        latin = ((cp >= 97) & (cp <= 122)) | ((cp >= 48) & (cp <= 57))
        first = np.flatnonzero(latin & ~np.concatenate([[False], latin[:-1]]))
        said = pa.array(_LATIN.findall(all_), pa.string()).dictionary_encode()
        known = np.fromiter((self.words.setdefault(w, len(self.words)) for w in said.dictionary.to_pylist()), np.int64, len(said.dictionary))
        words = known[said.indices.to_numpy()]
        at = cp - _HAN
        code = np.concatenate([_N_HAN + at[pair] * _N_HAN + at[pair + 1], at[lone], _WORDS + words])
        return np.concatenate([doc[pair], doc[lone], doc[first]]), code

    def names(self, codes: np.ndarray) -> list[str]:
        words = list(self.words)
        return [words[c - _WORDS] if c >= _WORDS else chr(c + _HAN) if c < _N_HAN else chr((c - _N_HAN) // _N_HAN + _HAN) + chr(c % _N_HAN + _HAN) for c in codes.tolist()]


def _pack(rids: list[int], cities: list[str | None], docs: np.ndarray, codes: np.ndarray, book: _Codes) -> dict:
    """One block of entries given by (text number, code) of their tokens."""
    order = sorted(range(len(rids)), key=lambda i: (cities[i] is None, cities[i] or "", rids[i]))
    place = np.empty(len(rids), np.int64)
    place[order] = np.arange(len(rids))
    key = codes * BLOCK_ENTRIES  # codes are below 2 ** 41
    key += place[docs]
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(first, append=len(key))
    code, key = np.divmod(key[first], BLOCK_ENTRIES)
    start = np.flatnonzero(np.diff(code, prepend=-1))
    seen = code[start]
    names, starts, words = [], [], book.names(seen)
    for at, i in enumerate(order):
        if not names or cities[i] != names[-1]:
            names.append(cities[i])
            starts.append(at)
    dl = np.bincount(place[docs], minlength=len(rids))
    return {
        "rids": np.array(rids, np.int64)[order].tobytes(), "dl": dl.astype(np.int32).tobytes(), "cities": names, "starts": starts, "tokens": words, "dims": dims(words).astype(np.uint8).tobytes(),
        "df": np.diff(start, append=len(key)).astype(np.int32), "places": key.astype(np.uint16).tobytes(), "tf": tf.astype(np.int32).tobytes(),
        "n": int((dl > 0).sum()), "total": int(dl.sum()),
    }


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("rids", pa.binary()), ("dl", pa.binary()), ("cities", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("tokens", pa.list_(pa.string())), ("dims", pa.binary()), ("df", pa.list_(pa.int32())),
                       ("places", pa.binary()), ("tf", pa.binary()), ("n", pa.int64()), ("total", pa.int64())])

    def out():
        row = _pack(rids, cities, np.concatenate(docs), np.concatenate(codes), book)
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in kinds], schema=kinds)

    had: set[int] = set()  # a rid repeated in full counts once
    book, rids, cities, docs, codes = _Codes(), [], [], [], []
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ENTRIES):
            part = b.slice(at, BLOCK_ENTRIES)
            new = []
            for r in part.column(0).to_pylist():
                new.append(r not in had)
                had.add(r)
            part = part.filter(pa.array(new, pa.bool_()))
            if len(rids) + part.num_rows > BLOCK_ENTRIES:
                yield out()
                book, rids, cities, docs, codes = _Codes(), [], [], [], []
            d, c = book.of(part.column(2).to_pylist())
            docs.append(d + len(rids))
            codes.append(c)
            rids += part.column(0).to_pylist()
            cities += part.column(1).to_pylist()
    if rids:
        yield out()


def blocks(spark, sf_dir: str) -> DataFrame:
    """The blocks of the corpus as a written table, one per corpus version. Rows
    without rid are no entries."""
    rows = table(spark, sf_dir, "knowledge_entries")
    n = rows.count()  # of the files' footers
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (BLOCK_ENTRIES * 15 // 16)))

    def build() -> DataFrame:
        # a city's entries lie in as few blocks as hold them: place them in a row of cities and cut it
        cities = rows.where("rid is not null").groupBy("city").agg(F.count("*").alias("n_city"))
        before = F.sum("n_city").over(Window.orderBy("city")) - F.col("n_city")  # one row per city
        cities = F.broadcast(cities.select(F.col("city").alias("c"), "n_city", before.alias("before")))
        at = (F.col("before") + F.pmod(F.xxhash64("rid"), F.col("n_city"))) * parts / n
        text = rows.where("rid is not null").join(cities, F.col("city").eqNullSafe(F.col("c"))).select("rid", "city", F.lower(search_text()).alias("text"), F.floor(at).alias("cut"))
        return text.repartitionById(parts, F.col("cut").cast("int")).select("rid", "city", "text").mapInArrow(_packed, BLOCK)

    return once(spark, "blocks", version(spark, sf_dir, "knowledge_entries"), build, lambda df, label: by_row(spark, lambda: materialize(df, label), 1000))


def by_row(spark, run, rows: int = 1):
    """run() with Arrow batches of so many rows: a packed row is some megabytes long."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def statistics(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df), and one row (n_docs, avgdl)."""
    per = b.select(F.explode(F.arrays_zip("tokens", "df")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum(F.col("x.df")).alias("df"))
    return per, b.agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("avgdl"))


# ---------------------------------------------------------------- questions


def pack_questions(terms: DataFrame, about: DataFrame, most: int | None = None) -> DataFrame:
    """terms (query_id, token, qtf, idf, avgdl) and about (query_id, need, city, hard
    and others) as rows of some thousand questions: (avgdl, qs, ts)."""
    n = max(1, -(-about.count() // (most or PACK_QUESTIONS)))
    block = F.pmod(F.hash("query_id"), F.lit(n)).alias("qb")
    q = about.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("query_id", *(c for c in about.columns if c != "query_id")))).alias("qs"))
    t = terms.groupBy(block).agg(F.max("avgdl").alias("avgdl"), F.sort_array(F.collect_list(F.struct("query_id", "token", "qtf", "idf"))).alias("ts"))
    return materialize(q.join(t, "qb", "left").repartitionById(n, "qb").select("avgdl", "qs", "ts"), "questions")  # a file each


def _shares(packed: DataFrame) -> list[list[str]]:
    """The files of the packs, as many together as a task takes."""
    sizes = packed.select(F.input_file_name().alias("file"), F.size("qs").alias("n")).groupBy("file").agg(F.sum("n").alias("n"))  # one row per pack
    out, room = [], 0
    for file, n in sorted(map(tuple, sizes.collect())):
        if not out or n > room:
            out.append([])
            room = TASK_QUESTIONS
        out[-1].append(file)
        room -= n
    return out or [[]]


def dims(words: list[str]) -> np.ndarray:
    """The dimension of each token in a hashing vector, as retrieval.hashed_vector."""
    return np.fromiter((int.from_bytes(md5(w.encode()).digest()[:2]) % DIMS for w in words), np.int64, len(words))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1))
    return m / np.where(norm > 0, norm, 1.0)[:, None]


def _vectors(said: list[np.ndarray]) -> np.ndarray:
    """The hashing vectors of texts given by the dimensions of their tokens."""
    at = np.repeat(np.arange(len(said)), [len(s) for s in said]) * DIMS + np.concatenate(said)
    return _unit(np.bincount(at, minlength=len(said) * DIMS).reshape(-1, DIMS).astype(np.float64))


class _Block:
    """A block as arrays; what is worked out for a token stays for the next question.
    asked: the tokens that can be asked for, if not all."""

    def __init__(self, b: pa.RecordBatch, k1: float | None, asked: pa.Array | None = None):
        c = {f.name: b.column(i)[0] for i, f in enumerate(b.schema) if f.name in ("rids", "dl", "cities", "starts", "tokens", "dims", "df", "places", "tf")}
        num = lambda name, kind: np.frombuffer(c[name].as_buffer(), kind)
        self.rids, self.dl, self.places, self.tf = num("rids", np.int64), num("dl", np.int32), num("places", np.uint16), num("tf", np.int32)
        self.n, self.k1 = len(self.rids), k1
        self.ask(b, asked)
        self.dims = num("dims", np.uint8)
        self.ends = np.concatenate([[0], np.cumsum(c["df"].values.to_numpy())])
        starts = [*c["starts"].as_py(), self.n]
        self.range = {name: (starts[i], starts[i + 1]) for i, name in enumerate(c["cities"].as_py())}
        self.city = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.names = c["cities"].as_py()
        self.mat: np.ndarray | None = None
        self.by_rid = np.argsort(self.rids)
        self.sorted = self.rids[self.by_rid]
        self.pos = np.empty(self.n, np.int64)  # of a place, in order of rid
        self.pos[self.by_rid] = np.arange(self.n)

    def ask(self, b: pa.RecordBatch, asked: pa.Array | None) -> None:
        """Find the rows of the tokens asked for."""
        tokens = b.column(b.schema.get_field_index("tokens"))[0].values
        if asked is None:
            self.row = {t: i for i, t in enumerate(tokens.to_pylist())}
        else:
            at = pc.index_in(asked, tokens)
            self.row = dict(zip(asked.filter(at.is_valid()).to_pylist(), at.drop_null().to_pylist()))
        self.kept: dict = {}

    def vectors(self) -> np.ndarray:
        """The hashing vectors of the entries."""
        if self.mat is None:
            at = self.places.astype(np.int32) * DIMS
            at += np.repeat(self.dims, np.diff(self.ends))
            self.mat = _unit(np.bincount(at, self.tf, self.n * DIMS).reshape(-1, DIMS))
        return self.mat

    def norm(self, avgdl: float | None) -> None:
        if self.k1 is not None and avgdl is not None:  # null: no token of any question is known
            self.base = self.k1 * (1 - 0.75 + 0.75 * self.dl / avgdl)

    def term(self, token: str, idf: float):
        """(places, weights, weights of all places or null, marks once asked for) of a token, null if no entry has it."""
        got = self.kept.get(token, 0)
        if got == 0:
            i = self.row.get(token)
            if i is None:
                got = None
            else:
                at = slice(self.ends[i], self.ends[i + 1])
                p = self.places[at].astype(np.int64)
                w = np.ones(len(p)) if self.k1 is None else idf * self.tf[at] * (self.k1 + 1) / (self.tf[at] + self.base[p])
                full = None
                if len(p) * 6 > self.n:
                    full = np.zeros(self.n)
                    full[p] = w
                got = p, w, full, []
            self.kept[token] = got
        return got

    def marks(self, term) -> np.ndarray:
        """Whether a place has the token. Kept, so only for tokens that are not rare."""
        p, _, _, has = term
        if not has:
            has.append(np.zeros(self.n, bool))
            has[0][p] = True
        return has[0]

    def sums(self, terms: list, a: int = 0, z: int | None = None) -> np.ndarray:
        """Scores of the places from a to z."""
        whole = a == 0 and z is None
        z = self.n if z is None else z
        ps, ws, raw = [], [], None
        for (p, w, full, _), qtf in terms:
            if full is not None:
                part = full[a:z]
                raw = part * qtf if raw is None else raw + (part if qtf == 1 else part * qtf)
            elif whole:
                ps.append(p)
                ws.append(w if qtf == 1 else w * qtf)
            else:
                i, j = np.searchsorted(p, (a, z))
                ps.append(p[i:j] - a)
                ws.append(w[i:j] * qtf)
        if ps:
            s = np.bincount(ps[0] if len(ps) == 1 else np.concatenate(ps), ws[0] if len(ws) == 1 else np.concatenate(ws), z - a)
            raw = s if raw is None else raw + s
        return np.zeros(z - a) if raw is None else raw

    def with_all(self, terms: list, need: int, a: int = 0, z: int | None = None) -> np.ndarray:
        """Places from a to z that have all tokens, of which the question has `need`."""
        if len(terms) < need:
            return np.empty(0, np.int64)
        terms = sorted(terms, key=lambda t: len(t[0][0]))
        m = terms[0][0][0]
        if z is not None:
            i, j = m.searchsorted((a, z))
            m = m[i:j]
        for term, _ in terms[1:]:
            if not len(m):
                break
            p = term[0]
            m = m[self.marks(term)[m] if len(p) * 64 > self.n else p[np.minimum(p.searchsorted(m), len(p) - 1)] == m]
        return m

    def sums_at(self, terms: list, m: np.ndarray) -> np.ndarray:
        """Scores of places that have all tokens."""
        out = np.zeros(len(m))
        for (p, w, full, _), qtf in terms:
            part = full[m] if full is not None else w[p.searchsorted(m)]
            out += part if qtf == 1 else part * qtf
        return out


def _give_back() -> None:
    """Return freed memory to the system: two workers share an executor's with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _plain(x: pa.Array) -> list:
    """A column's values; lists of numbers stay arrays, copied: a view would keep the
    whole batch."""
    if not pa.types.is_list(x.type) or pa.types.is_string(x.type.value_type):
        return x.to_pylist()
    ends, of = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False).copy()
    return [of[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _asked(files: list[str]) -> Iterator[tuple]:
    """The packs of questions in the files: (avgdl, columns, first and last token of each
    question, distinct tokens, tokens, qtf, idf)."""
    for uri in files:
        where, path = FileSystem.from_uri(uri)
        with where.open_input_file(path) as f:
            for r in pq.ParquetFile(f).iter_batches(batch_size=1, use_threads=False):
                avgdl, qs, ts = (r.column(r.schema.get_field_index(name)) for name in ("avgdl", "qs", "ts"))
                kind = ts.type.value_type
                qs, ts = qs[0].values, ts[0].values
                if ts is None:
                    ts = pa.array([], kind)
                cols = {f.name: _plain(x) for f, x in zip(qs.type, qs.flatten())}
                tid, *of = ts.flatten()  # query_id, token, qtf, idf
                lo, hi = (np.searchsorted(tid.to_numpy(), cols["query_id"], side).tolist() for side in ("left", "right"))
                words = of[0].dictionary_encode()
                token = np.array(words.dictionary.to_pylist(), object)[words.indices.to_numpy()].tolist()
                yield avgdl[0].as_py(), cols, lo, hi, words.dictionary, token, *(x.to_pylist() for x in of[1:])


def each(k1: float | None, one, files: list[str]):
    """For mapInArrow over blocks: one(block, question, terms) gives rows for every pack
    of questions; question is a dict of its columns. The packs are read from the shared
    folder once a task: beside each block they would pass the JVM once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = None
        for b in batches:
            for i in range(b.num_rows):
                r, block = b.slice(i, 1), None  # not two blocks at once
                if packs is None:
                    packs = list(_asked(files))
                _give_back()
                for avgdl, cols, lo, hi, asked, token, qtf, idf in packs:
                    if block is None:
                        block = _Block(r, k1, asked)
                    else:  # the same block, other questions
                        block.ask(r, asked)
                    block.norm(avgdl)
                    cities = cols["city"] if "hard" in cols else None
                    here = (lambda i: not cols["hard"][i] or cities[i] in block.range) if cities else lambda i: True  # noqa: B023
                    yield from one(block, cols, [[(t, qtf[j]) for j in range(x, y) if (t := block.term(token[j], idf[j])) is not None] if here(i) else [] for i, (x, y) in enumerate(zip(lo, hi))])
        block, packs = None, None
        yield from getattr(one, "rest", lambda: ())()  # what is kept for the task
        _give_back()

    return run


# ---------------------------------------------------------------- kernels

ENDS = "query_id long, n_any long, n_all long, lo double, hi double, lo_all double, hi_all double"


def find_ends(counts: bool):
    """Per question: matches, matches of all tokens, and the least and greatest score
    of both. Where the block, or an earlier one of the task, has entries with all
    tokens, the others are only counted (counts), since they take no part."""
    found: set[int] = set()  # questions with entries that have all tokens

    def one(b: _Block, q: dict, terms: list) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, t in enumerate(terms):
            if not t:
                continue
            m = b.with_all(t, q["need"][i])
            lo_all = hi_all = lo = hi = None
            n_any = len(m)
            if len(m):
                s = b.sums_at(t, m)
                lo_all, hi_all = float(s.min()), float(s.max())
                found.add(q["query_id"][i])
            if counts:
                any_ = np.zeros(b.n, bool)
                for (p, *_), _ in t:
                    any_[p] = True
                n_any = int(np.count_nonzero(any_))
            elif not len(m):
                if q["query_id"][i] in found:
                    continue
                s = b.sums(t)
                hi = float(s.max())
                s[s <= 0] = np.inf
                lo = float(s.min())
            rows.append((q["query_id"][i], n_any, len(m), lo, hi, lo_all, hi_all))
        if rows:
            kinds = [pa.int64()] * 3 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in ENDS.split(", ")])

    return one


FOUND = "query_id long, rid long, city string, score double"


def _four(x: np.ndarray) -> np.ndarray:
    """Ten-thousandths, halves up."""
    return np.floor(x * 1e4 + 0.5)


def find_best(k: int, boost: float, damp: float, positive: bool):
    """The best k of every question in its scope by (score to four places, rid)."""
    least: dict[int, float] = {}  # the k-th best score of a question in this task's earlier blocks: none below it can be kept

    def one(b: _Block, q: dict, terms: list) -> Iterator[pa.RecordBatch]:
        ids, rids, cities, scores = [], [], [], []
        for i, t in enumerate(terms):
            own, a, z = b.range.get(q["city"][i]), 0, None
            if not t or q["hard"][i] and own is None:
                continue
            if q["hard"][i]:
                a, z = own
            if q["all_terms"][i]:
                p = b.with_all(t, q["need"][i], a, z)
                if not len(p):
                    continue
                s = b.sums_at(t, p)
            else:
                s = b.sums(t, a, z)
                p = None
            if "n_tokens" in q:
                s = s / q["n_tokens"][i]
            if q["lo"][i] is not None:
                lo, hi = q["lo"][i], q["hi"][i]
                s = np.where(s > 0, (s - lo) / (hi - lo) if hi > lo else 1.0, 0.0)
            if p is None:
                some = s > 0
                if q["city"][i] is not None and not q["hard"][i]:
                    s = s * damp
                    if own is not None:
                        s[own[0] : own[1]] *= boost / damp
                if q["query_id"][i] in least:
                    some &= s >= (least[q["query_id"][i]] - 0.5) / 1e4 - 1e-9
                elif len(s) > 4 * k:
                    some &= s >= np.partition(s, len(s) - k)[len(s) - k] - 2e-4
                p = np.flatnonzero(some)
                s, p = s[p], p + a
            elif q["city"][i] is not None and not q["hard"][i]:
                s = s * np.where((p >= own[0]) & (p < own[1]), boost, damp) if own is not None else s * damp
            s = _four(s)
            if positive:
                p, s = p[s > 0], s[s > 0]
            top = np.lexsort((b.rids[p], -s))[:k]
            if len(top) == k:
                least[q["query_id"][i]] = max(least.get(q["query_id"][i], 0.0), s[top[-1]])
            ids.append(np.full(len(top), q["query_id"][i]))
            rids.append(b.rids[p[top]])
            cities += [b.names[c] for c in b.city[p[top]]]
            scores.append(s[top] / 1e4)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(rids)), pa.array(cities, pa.string()), pa.array(np.concatenate(scores))], names=["query_id", "rid", "city", "score"])

    return one


# ---------------------------------------------------------------- both channels


def _quantised(cos: np.ndarray) -> np.ndarray:
    """Dot products in whole ten-thousandths."""
    return np.floor(np.round(cos, 9) * 1e4 + 0.5).astype(np.int64)


NEAR = 1e-5  # of 64 products of unit vectors without negative numbers: 66 roundings by 6e-8
TILE = 64  # questions whose dot products with a block are taken at once


def _scoped(b: _Block, q: dict, near: bool):
    """(i, a, z, dot products) of the questions with entries in scope in the block:
    the places from a to z, all of them for an open question. near: those of open
    questions in single precision, at most NEAR off."""
    if "vec" not in q:
        q["vec"] = _vectors(q["said"])
        q["open"] = np.array([i for i, hard in enumerate(q["hard"]) if not hard], np.int64)
        q["of"] = {}
        for i, hard in enumerate(q["hard"]):
            if hard:
                q["of"].setdefault(q["city"][i], []).append(i)
    mat = b.vectors()
    for city, (a, z) in b.range.items():
        for i in q["of"].get(city, ()):
            yield i, a, z, mat[a:z] @ q["vec"][i]
    kind = np.float32 if near else np.float64
    out, mat, vec = np.empty((TILE, b.n), kind), mat.astype(kind, copy=False), q["vec"].astype(kind, copy=False)
    for at in range(0, len(q["open"]), TILE):
        part = q["open"][at : at + TILE]
        dots = np.matmul(vec[part], mat.T, out=out[: len(part)])
        for i, row in zip(part.tolist(), dots):
            yield i, 0, b.n, row


def _lexical(b: _Block, q: dict, i: int, t: list, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from a to z whose score, in whole ten-thousandths, is not zero, and the scores."""
    if t and q["all_terms"][i]:
        p = b.with_all(t, q["need"][i], a, z)
        s = b.sums_at(t, p)
    elif t:
        s = b.sums(t, a, z)
        p = np.flatnonzero(s > 0)
        s, p = s[p], p + a
    else:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo, hi = q["lo"][i], q["hi"][i]
    s = _four((s - lo) / (hi - lo) if hi > lo else np.ones(len(s))).astype(np.int64)
    return p[s > 0], s[s > 0]


def _at(p: np.ndarray, s: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of the places m, by those (p, s) that are not zero."""
    if not len(p):
        return np.zeros(len(m), np.int64)
    at = np.minimum(p.searchsorted(m), len(p) - 1)
    return np.where(p[at] == m, s[at], 0)


BEST = "chunk int, query_id binary, rid binary, b binary, v binary, lexical boolean"


def find_both(depth: int, chunks: int):
    """Each question's first `depth` entries in its scope by either channel (score, then
    rid; what matches nothing follows by rid), with both scores, kept for the task."""
    kept: tuple[dict, dict] = ({}, {})  # lexical, dense: query_id to (rid, b, v, full)

    def keep(lexical: bool, qid: int, rid: np.ndarray, b: np.ndarray, v: np.ndarray) -> None:
        had = kept[not lexical].get(qid)
        if had is not None:
            if had[3]:
                s, least = (b, had[1][-1]) if lexical else (v, had[2][-1])
                better = (s > least) | ((s == least) & (rid < had[0][-1]))
                rid, b, v = rid[better], b[better], v[better]
                if not len(rid):
                    return
            rid, b, v = np.concatenate([had[0], rid]), np.concatenate([had[1], b]), np.concatenate([had[2], v])
        full = len(rid) >= depth
        if full:
            top = np.lexsort((rid, -(b if lexical else v)))[:depth]
            rid, b, v = rid[top], b[top], v[top]
        kept[not lexical][qid] = rid, b.astype(np.int32), v.astype(np.int32), full

    def one(b: _Block, q: dict, terms: list) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(b.n, bool)
        mat = b.vectors()
        for i, a, z, cos in _scoped(b, q, True):
            qid, n = q["query_id"][i], z - a
            had = kept[0].get(qid)
            least = int(had[1][-1]) if had is not None and had[3] else -1
            raw = p = None
            if least > 0 and terms[i] and not q["all_terms"][i]:  # only what is not below the least kept is worked out
                raw, lo, hi = b.sums(terms[i], a, z), q["lo"][i], q["hi"][i]
                four = (lambda x: np.where(x > 0, _four((x - lo) / (hi - lo)), 0.0).astype(np.int64)) if hi > lo else lambda x: np.where(x > 0, 10_000, 0)  # noqa: B023
                m = np.flatnonzero(raw >= lo + (hi - lo) * (least - 1) / 1e4) if hi > lo else np.flatnonzero(raw > 0)
                ms = four(raw[m])
                m, ms = m[ms >= least] + a, ms[ms >= least]
            else:
                p, s = _lexical(b, q, i, terms[i], a, z)
                m, ms = p, s
            if p is None:
                pass
            elif least > 0:
                m, ms = p[s >= least], s[s >= least]
            elif len(p) > depth:
                some = s >= np.partition(s, len(s) - depth)[len(s) - depth]
                m, ms = p[some], s[some]
            if len(m):
                keep(True, qid, b.rids[m], ms, _quantised(mat[m] @ q["vec"][i]))
            if least <= 0 and len(p) < depth:
                first = b.by_rid[: depth + len(p)] if not q["hard"][i] else np.arange(a, min(z, a + depth + len(p)))
                if least == 0:
                    first = first[b.rids[first] < had[0][-1]]
                if len(p):
                    mark[p] = True
                    first = first[~mark[first]]
                    mark[p] = False
                if len(first):
                    first = first[:depth]
                    keep(True, qid, b.rids[first], np.zeros(len(first), np.int64), _quantised(mat[first] @ q["vec"][i]))
            had = kept[1].get(qid)
            if had is not None and had[3]:
                m = np.flatnonzero(cos >= (had[2][-1] - 0.5) / 1e4 - NEAR)
            elif n > depth:
                m = np.flatnonzero(cos >= np.partition(cos, n - depth)[n - depth] - 1e-4 - 3 * NEAR)
            else:
                m = np.arange(n)
            if len(m):
                m += a
                keep(False, qid, b.rids[m], _at(p, s, m) if p is not None else four(raw[m - a]), _quantised(mat[m] @ q["vec"][i]))
        return iter(())

    def rest() -> Iterator[pa.RecordBatch]:
        for lexical in (True, False):
            own = dict(kept[not lexical])
            kept[not lexical].clear()
            ids = np.fromiter(own, np.int64, len(own))
            chunk = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % chunks
            for c in np.unique(chunk).tolist():
                mine = ids[chunk == c]
                got = [own.pop(i) for i in mine.tolist()]
                qid = np.repeat(mine, [len(g[0]) for g in got])
                parts = [qid, *(np.concatenate([g[j] for g in got]) for j in range(3))]
                kinds = np.int64, np.int64, np.int32, np.int32
                cols = [pa.array([x.astype(k).tobytes()]) for x, k in zip(parts, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *cols, pa.array([lexical])], names=[x.split()[0] for x in BEST.split(", ")])

    one.rest = rest
    return one


CANDIDATES = "query_id long, rid long, b int, v int, r1 long, r2 long"


def fuse(depth: int, pool: int, k: int):
    """For the rows of a chunk of find_both: the entries that can be among a question's
    best `pool` by reciprocal ranks, with the ranks known (one past `depth` is null)."""

    def run(t: pa.Table) -> pa.Table:
        num = lambda name, kind, lexical: np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x, y in zip(t[name].to_pylist(), t["lexical"].to_pylist()) if y == lexical)])
        sides = []
        for lexical in (True, False):
            q, rid, b, v = (num(*x, lexical) for x in (("query_id", np.int64), ("rid", np.int64), ("b", np.int32), ("v", np.int32)))
            order = np.lexsort((rid, -(b if lexical else v), q))
            q, rid, b, v = q[order], rid[order], b[order], v[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            own = rank <= depth
            none = np.zeros(own.sum(), np.int64)
            sides.append([q[own], rid[own], b[own], v[own], *((rank[own], none) if lexical else (none, rank[own]))])
        q, rid, b, v, r1, r2 = (np.concatenate(x) for x in zip(*sides))
        order = np.lexsort((rid, q))
        q, rid, b, v, r1, r2 = (x[order] for x in (q, rid, b, v, r1, r2))
        first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (rid[1:] != rid[:-1])]))
        q, rid, b, v, r1, r2 = q[first], rid[first], b[first], v[first], np.maximum.reduceat(r1, first), np.maximum.reduceat(r2, first)
        low = np.where(r1 > 0, 1.0 / (k + r1), 0.0) + np.where(r2 > 0, 1.0 / (k + r2), 0.0)
        high = low + ((r1 == 0).astype(int) + (r2 == 0)) / (k + depth + 1.0)
        order = np.lexsort((-low, q))
        ends, start = np.searchsorted(q, q, "right"), np.searchsorted(q, q)
        bar = np.where(ends - start >= pool, low[order][np.minimum(start + pool - 1, len(q) - 1)], 0.0)
        own = high >= bar - 1e-12
        cols = [x[own] for x in (q, rid, b, v, r1, r2)]
        return pa.table({name.split()[0]: pa.array(x, mask=x == 0 if name[0] == "r" and name[1] in "12" else None) for name, x in zip(CANDIDATES.split(", "), cols)})

    return run


def by_question(fused):
    """fused (see fuse) with a row per question: its entries as lists, and whether it
    has some whose rank in a channel is not known (0)."""

    def run(t: pa.Table) -> pa.Table:
        t = fused(t)
        q, r1, r2 = t["query_id"].to_numpy(), t["r1"].fill_null(0).to_numpy(), t["r2"].fill_null(0).to_numpy()
        first = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.empty(0, np.int64)
        ends = pa.array(np.append(first, len(q)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, k)) for x, k in ((t["rid"].to_numpy(), pa.int64()), *((x, pa.int32()) for x in (t["b"].to_numpy(), t["v"].to_numpy(), r1, r2)))]
        missing = [pa.array(np.logical_or.reduceat(x == 0, first) if len(q) else np.empty(0, bool)) for x in (r1, r2)]
        return pa.table([pa.array(q[first]), *lists, *missing], names=[x.split()[0] for x in OPEN.split(", ")])

    return run


OPEN = "query_id long, rids array<long>, bs array<int>, vs array<int>, r1s array<int>, r2s array<int>, lexical boolean, dense boolean"
AHEAD = "query_id long, rid long, ahead1 long, ahead2 long"
AHEAD_LISTS = "query_id long, ahead1 array<int>, ahead2 array<int>"


def count_ahead(lists: bool = False):
    """For the entries asked for (rids, bs, vs): how many of the scope are before them in
    either channel; counted for a question only where it needs the channel. lists: a row
    per question instead of one per entry, in the order asked."""
    packs: dict[int, tuple] = {}  # by identity of a pack: it, where its questions' entries begin, counts, questions met

    def before(b: _Block, s: np.ndarray, pos: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
        s *= b.n + 1  # ten-thousandths times at most 16,385 entries: four bytes hold it
        s += b.n - pos
        s.sort()
        return (len(s) - s.searchsorted((asked * (b.n + 1) + b.n - at).astype(s.dtype), "right")).astype(np.int32)

    def one(b: _Block, q: dict, terms: list) -> Iterator[pa.RecordBatch]:
        if id(q) not in packs:
            ends = np.append(0, np.cumsum([len(r) for r in q["rids"]]))
            packs[id(q)] = q, ends, np.zeros((2, ends[-1]), np.int32), np.zeros(len(q["rids"]), bool)  # of one task's entries: four bytes hold it
        _, ends, ahead, seen = packs[id(q)]
        places = np.arange(b.n, dtype=np.int32)
        of_all = b.pos.astype(np.int32)
        for i, a, z, cos in _scoped(b, q, False):
            rids = q["rids"][i]
            whole = not q["hard"][i]
            at = (b.sorted if whole else b.rids[a:z]).searchsorted(rids)
            pos = of_all if whole else places - np.int32(a)  # of a place, in order of rid
            out = ahead[:, ends[i] : ends[i + 1]]
            seen[i] = True
            if q["lexical"][i]:
                p, s = _lexical(b, q, i, terms[i], a, z)
                p, asked = pos[p], q["bs"][i]
                zero = len(p) + at - np.sort(p).searchsorted(at.astype(np.int32))
                out[0] += np.where(asked > 0, before(b, s.astype(np.int32), p, asked.astype(np.int64), at), zero).astype(np.int32)
            if q["dense"][i]:
                cos *= 1e4
                cos += 0.500005  # as _quantised
                out[1] += before(b, cos.astype(np.int32), pos[a:z], q["vs"][i].astype(np.int64), at)
        return iter(())

    def rest() -> Iterator[pa.RecordBatch]:
        while packs:
            q, ends, ahead, seen = packs.pop(next(iter(packs)))
            ids = np.array(q["query_id"], np.int64)
            for start in range(0, len(ids), 512):
                mine = start + np.flatnonzero(seen[start : start + 512])
                if not len(mine):
                    continue
                at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in mine.tolist()])
                x1, x2 = ahead[:, at]
                n = ends[mine + 1] - ends[mine]
                if lists:
                    to = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), *(pa.ListArray.from_arrays(to, pa.array(x)) for x in (x1, x2))], names=[x.split()[0] for x in AHEAD_LISTS.split(", ")])
                else:
                    cols = np.repeat(ids[mine], n), np.concatenate([q["rids"][i] for i in mine.tolist()]), x1, x2
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=[x.split()[0] for x in AHEAD.split(", ")])

    one.rest = rest
    return one


FUSED = "query_id long, rank long, rid long, score double, b int, v int"


def fuse_all(pool: int, k: int):
    """For cogrouped rows of by_question and of count_ahead, by lists: each question's
    best `pool` by reciprocal ranks (unrounded), then rid."""

    def run(got: pa.Table, ahead: pa.Table) -> pa.Table:
        if not got.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())], names=[x.split()[0] for x in FUSED.split(", ")])
        got = got.combine_chunks().sort_by("query_id")
        flat = lambda t, name: pc.list_flatten(t[name]).to_numpy()
        ids, n = got["query_id"].to_numpy(), pc.list_value_length(got["rids"]).to_numpy()
        ends = np.append(0, np.cumsum(n))
        x = np.ones((2, ends[-1]), np.int64)
        if ahead.num_rows:
            of = ids.searchsorted(ahead["query_id"].to_numpy())
            to = np.append(0, np.cumsum(n[of]))
            for row, name in zip(x, ("ahead1", "ahead2")):
                more = flat(ahead, name)
                for i, a, z in zip(of.tolist(), to[:-1].tolist(), to[1:].tolist()):
                    row[ends[i] : ends[i + 1]] += more[a:z]
        r1, r2 = flat(got, "r1s"), flat(got, "r2s")
        rid, q = flat(got, "rids"), np.repeat(ids, n)
        score = 1.0 / (k + np.where(r1 > 0, r1, x[0])) + 1.0 / (k + np.where(r2 > 0, r2, x[1]))
        order = np.lexsort((rid, -score, q))
        rank = np.arange(len(q)) - np.repeat(ends[:-1], n) + 1  # q is in order
        own, rank = order[rank <= pool], rank[rank <= pool]
        return pa.table([pa.array(y, t) for y, t in ((q[own], pa.int64()), (rank, pa.int64()), (rid[own], pa.int64()), (score[own], pa.float64()), (flat(got, "bs")[own], pa.int32()), (flat(got, "vs")[own], pa.int32()))], names=[x.split()[0] for x in FUSED.split(", ")])

    return run


def find_near(k: int, boost: float, damp: float):
    """The best k of every question in its scope by dot product (to four places, rid),
    weighed by city outside hard scopes."""
    least: dict[int, int] = {}

    def one(b: _Block, q: dict, terms: list) -> Iterator[pa.RecordBatch]:
        ids, rids, cities, scores = [], [], [], []
        for i, a, z, cos in _scoped(b, q, True):
            qid, n, own = q["query_id"][i], z - a, None
            if not q["hard"][i] and q["city"][i] is not None:
                own = b.range.get(q["city"][i])
                inside = cos[own[0] : own[1]] * boost if own else None
                cos *= damp
                if own:
                    cos[own[0] : own[1]] = inside
            if qid in least:
                p = np.flatnonzero(cos >= (least[qid] - 0.5) / 1e4 - NEAR * boost)
            else:
                p = np.flatnonzero(cos >= np.partition(cos, n - k)[n - k] - 1e-4 - 3 * NEAR * boost) if n > k else np.arange(n)
            exact = b.mat[p + a] @ q["vec"][i]
            if not q["hard"][i] and q["city"][i] is not None:
                exact *= np.where((p >= own[0]) & (p < own[1]), boost, damp) if own else damp
            s = _quantised(exact)
            top = np.lexsort((b.rids[p + a], -s))[:k]
            if len(top) == k:
                least[qid] = max(least.get(qid, 0), int(s[top[-1]]))
            ids.append(np.full(len(top), qid))
            rids.append(b.rids[p[top] + a])
            cities += [b.names[c] for c in b.city[p[top] + a]]
            scores.append(s[top] / 1e4)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(rids)), pa.array(cities, pa.string()), pa.array(np.concatenate(scores))], names=["query_id", "rid", "city", "score"])

    return one


def scan(b: DataFrame, packed: DataFrame, kernel, k1: float | None, schema: str, label: str) -> DataFrame:
    """kernel over every block and every pack of questions, written. A task takes some
    blocks and a share of the packs."""
    cores, n = b.sparkSession.sparkContext.defaultParallelism, b.count()  # of the files' footers
    parts, shares = -(-n // (TASK_BLOCKS * cores)) * cores, _shares(packed)
    if len(shares) > 1:
        parts = max(-(-n // TASK_BLOCKS), -(-4 * parts // len(shares)))
    b = b.coalesce(parts)
    found = reduce(DataFrame.union, [b.mapInArrow(each(k1, kernel, files), schema) for files in shares])
    return by_row(b.sparkSession, lambda: materialize(found, label))


# ---------------------------------------------------------------- near duplicates

REPEATS = "id string, rid long, overlap double"
CELL, SUBMISSIONS = 16_384, 8192  # entries and submissions of a city that are compared at once


def _sets(texts: list[str], book: _Codes, drop: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of the distinct tokens of two characters or more, without
    those dropped, in order of text."""
    docs, codes = [], []
    for at in range(0, len(texts), 1000):
        d, c = book.of(texts[at : at + 1000])
        u = np.unique((d << 41) | c)
        docs.append((u >> 41) + at)
        codes.append(u & ((1 << 41) - 1))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    doc, code = np.concatenate(docs), np.concatenate(codes)
    out = {_N_HAN + (ord(w[0]) - _HAN) * _N_HAN + ord(w[1]) - _HAN for w in drop if len(w) == 2} | {_WORDS + i for w, i in book.words.items() if len(w) < 2}
    keep = (code >= _N_HAN) & ~np.isin(code, np.fromiter(out, np.int64, len(out)))
    return doc[keep], code[keep]


def find_repeats(threshold: float, drop: tuple[str, ...]):
    """For cogrouped (id, own_key, text) and (rid, own, text) of a city: each id's
    entry of the largest overlap coefficient; every entry's count of shared tokens
    is summed, frequent tokens as rows of ones, the others by their entries."""

    def best(new: pa.Table, old: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.string()), "rid": pa.array([], pa.int64()), "overlap": pa.array([], pa.float64())})
        if not new.num_rows or not old.num_rows:
            return empty
        book = _Codes()
        old = old.sort_by("rid")
        rids, n = old["rid"].to_numpy(), old.num_rows
        doc, code = _sets(old["text"].to_pylist(), book, drop)
        size = np.bincount(doc, minlength=n)
        order = np.argsort(code, kind="stable")
        doc = doc[order]
        known, start = np.unique(code[order], return_index=True)
        ends = np.append(start, len(doc))
        own: dict[str, list[int]] = {}
        for i, keys in enumerate(old["own"].to_pylist()):
            for k in keys:
                own.setdefault(k, []).append(i)
        rows: dict[int, np.ndarray] = {}

        def row(t: int) -> np.ndarray:
            if t not in rows:
                rows[t] = np.zeros(n, np.uint16)
                rows[t][doc[ends[t] : ends[t + 1]]] = 1
            return rows[t]

        heavy = np.diff(ends) * 40 > n
        ids, keys = new["id"].to_pylist(), new["own_key"].to_pylist()
        sub, said = _sets(new["text"].to_pylist(), book, drop)
        first = np.searchsorted(sub, np.arange(len(ids) + 1))
        out = []
        for i, id_ in enumerate(ids):
            x = said[first[i] : first[i + 1]]
            if not len(x) or (keys[i] is None and id_ is not None):
                continue
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            at = at[known[at] == x] if len(known) else at[:0]
            light = [doc[ends[t] : ends[t + 1]] for t in at[~heavy[at]].tolist()]
            shared = np.bincount(np.concatenate(light), minlength=n).astype(np.uint16) if light else np.zeros(n, np.uint16)
            for t in at[heavy[at]].tolist():
                shared += row(t)
            least = np.minimum(size, len(x))
            hit = np.flatnonzero((shared >= (threshold - 1e-6) * least) & (size > 0))
            overlap = np.floor(shared[hit] / least[hit] * 1e6 + 0.5) / 1e6
            good = overlap >= threshold
            if keys[i] in own:
                good &= ~np.isin(hit, own[keys[i]])
            if good.any():
                hit, overlap = hit[good], overlap[good]
                top = np.lexsort((hit, -overlap))[0]
                out.append((id_, int(rids[hit[top]]), float(overlap[top])))
        if not out:
            return empty
        return pa.table({"id": pa.array([r[0] for r in out], pa.string()), "rid": pa.array([r[1] for r in out], pa.int64()), "overlap": pa.array([r[2] for r in out], pa.float64())})

    return best


def repeats(new: DataFrame, old: DataFrame, threshold: float, drop: tuple[str, ...]) -> DataFrame:
    """(id, rid, overlap) as quality.similar_entries, of new (id, own_key, city, text)
    and old (rid, own, city, text), texts in lower case: entries and submissions of a
    city meet in cells, so nothing per pair or token is shuffled."""
    ship(new.sparkSession)
    sizes = old.where("city is not null").groupBy("city").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n_old"))
    sizes = sizes.join(new.groupBy("city").agg(F.ceil(F.count("*") / SUBMISSIONS).cast("int").alias("n_new")), "city")
    sizes = F.broadcast(materialize(sizes, "cells"))  # one row per city that both sides have
    cell = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = new.join(sizes, "city").select("city", cell("id", "n_new").alias("s"), every("n_old").alias("c"), "id", "own_key", "text")
    b = old.join(sizes, "city").select("city", cell("rid", "n_old").alias("c"), every("n_new").alias("s"), "rid", "own", "text")
    keys = ["city", "c", "s"]
    take = lambda key, left, right: find_repeats(threshold, drop)(left.select(["id", "own_key", "text"]), right.select(["rid", "own", "text"]))
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(take, REPEATS)
    top = F.row_number().over(Window.partitionBy("id").orderBy(F.col("overlap").desc(), "rid"))
    return found.withColumn("n", top).where("n = 1").select("id", "rid", "overlap")
