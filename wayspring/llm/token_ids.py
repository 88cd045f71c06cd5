"""Encoding of a corpus with a public byte-level BPE tokenizer.

Per Arrow batch, texts are cut into the tokenizer's words and, exactly, at byte
pairs that occur in no vocabulary entry (no merge can ever span them). Each
distinct piece not seen before by the worker goes into a DuckDB recursive
query: rows (piece, position, token) join the merge table, each piece's
minimum-rank pair is contracted, leftmost first, until no pair is left, and an
ordered aggregation gives the piece's ids. Pieces repeat heavily, so the
recursion sees each only once per worker; the table of pieces is emptied when
full, which costs time but never changes a result.

Contracting every non-overlapping occurrence of the minimum-rank pair in one
step is the same as one leftmost occurrence at a time: a merge using the new
token always ranks later than the one that made it.

A recursion keeps the rows of all its turns, so it ends after a number of turns
that falls with the size of the lot and is begun anew from where it stopped.
A long piece (a word of thousands of letters) is encoded in parts that are then
joined: a sequence of ids is the encoding of its bytes if and only if each
neighbouring two ids are the encoding of theirs, since the first merge across a
border would be made in both. A border that fails is encoded again in a window
around it, twice as wide each time, at the worst the piece as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspring.runtime import small_batches, table

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"

# Fixed value: the public pre-tokenisation pattern of the byte-level BPE family.
# The last classes spell out Unicode White_Space, as \s differs between libraries.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

PIECES_KEPT, BYTES_KEPT, PIECES_AT_ONCE, BYTES_AT_ONCE, CHARS_AT_ONCE = 300_000, 32_000_000, 4_000, 60_000, 1_000_000
LONG, PART, WINDOW = 512, 64, 4  # bytes of a long piece and of its parts; tokens on each side of a border that failed
ROWS_AT_ONCE = 4_000_000  # rows that one recursion may keep

_CONTRACT = """
with recursive step(piece, pos, tok, turn) as (
  select piece, pos, tok, 0 from start
  union all
  select piece, pos, tok, turn from (
    with here as (
      select s.piece, s.pos, s.tok, s.turn, m.made,
        row_number() over (partition by s.piece order by s.pos) as nth
      from (select *, lead(tok) over (partition by piece order by pos) as next from step where turn < {turns}) s
      left join merges m on m.a = s.tok and m.b = s.next),
    least as (
      select *, min(made) over (partition by piece) as best from here),
    runs as (
      select *, case when made = best then nth - row_number() over (partition by piece, made = best order by nth) end as island
      from least where best is not null),
    taken as (
      select *, case when made = best then row_number() over (partition by piece, island order by nth) % 2 = 1 else false end as take from runs),
    flow as (
      select *, coalesce(lag(take) over (partition by piece order by nth), false) as gone from taken)
    select piece, pos, case when take then made else tok end as tok, turn + 1 as turn from flow where not gone)
)
select piece, list(tok order by pos) as ids, max(turn) as turns
from (select *, max(turn) over (partition by piece) as last from step) where turn = last group by piece
"""


class Encoder:
    """A tokenizer of one worker process."""

    def __init__(self, folder: str, name: str):
        import duckdb
        import regex

        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = self._shown_bytes()
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int32)
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # bytes of a token
        for v, i in vocab.items():
            self.width[i] = len(v)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = pd.DataFrame({"a": [vocab[a] for a, _ in pairs], "b": [vocab[b] for _, b in pairs], "made": [vocab[a + b] for a, b in pairs]}, dtype="int32")
        unshown = {c: b for b, c in enumerate(shown)}
        self.joins = np.zeros((256, 256), dtype=bool)  # byte pairs that some vocabulary entry contains
        for a, b in pairs:
            raw = np.array([unshown[c] for c in a + b], dtype=np.int16)
            self.joins[raw[:-1], raw[1:]] = True
        self._forget()
        self.split = regex.compile(PATTERN).findall
        self.words = regex.compile(PATTERN).finditer
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # where this worker's Spark spills
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": False, "temp_directory": spill and f"{spill}/tokens-{os.getpid()}"})
        self.db.register("merges_in", merges)
        self.db.execute("create table merges as select * from merges_in")
        self.db.unregister("merges_in")

    @staticmethod
    def _shown_bytes() -> list[str]:
        """The printable stand-in of each byte in byte-level vocabularies."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]

    def _forget(self) -> None:
        """Start the table of pieces anew, with the single bytes."""
        self.codes: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[np.ndarray] = [self.byte_id[b : b + 1] for b in range(256)]
        self.held = 0
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _keep(self, piece: bytes, ids: np.ndarray) -> None:
        self.codes[piece] = len(self.parts)
        self.parts.append(np.asarray(ids, dtype=np.int32))
        self.held += len(piece)
        self.table = None

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of distinct pieces of two bytes or more."""
        done: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        open_ = {k: self.byte_id[np.frombuffer(p, dtype=np.uint8)] for k, p in enumerate(pieces)}
        while open_:
            lengths = np.array([len(x) for x in open_.values()])
            turns = max(4, ROWS_AT_ONCE // int(lengths.sum()))
            start = pd.DataFrame({
                "piece": np.repeat(np.array(list(open_), dtype=np.int32), lengths),
                "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]),
                "tok": np.concatenate(list(open_.values())),
            })
            self.db.register("start", start)
            got = self.db.execute(_CONTRACT.format(turns=turns)).fetchnumpy()
            self.db.unregister("start")
            open_ = {}
            for k, ids, t in zip(got["piece"].tolist(), got["ids"], got["turns"].tolist()):
                (open_ if t >= turns else done)[k] = np.asarray(ids, dtype=np.int32)
        return done

    def _learn(self, pieces: list[bytes], whole: bool = False) -> None:
        """Add distinct pieces to the table, in lots of like length; whole: long ones too in one recursion."""
        lot: list[bytes] = []
        size = 0
        long = [] if whole else [p for p in pieces if len(p) > LONG]
        for p in [*sorted((p for p in pieces if whole or len(p) <= LONG), key=len), None]:
            if lot and (p is None or len(lot) >= PIECES_AT_ONCE or size + len(p) > BYTES_AT_ONCE):
                for x, ids in zip(lot, self._contract(lot)):
                    self._keep(x, ids)
                lot, size = [], 0
            if p is not None:
                lot.append(p)
                size += len(p)
        for p in long:
            self._keep(p, self._joined(p))

    def _known(self, pieces: list[bytes], whole: bool = False) -> list[np.ndarray]:
        """The ids of pieces, through the table."""
        new = [p for p in {*pieces} if p not in self.codes]
        if new:
            self._learn(new, whole)
        return [self.parts[self.codes[p]] for p in pieces]

    def _joined(self, piece: bytes) -> np.ndarray:
        """The ids of a long piece: parts, then windows around the borders that fail."""
        got = self._known([piece[i : i + PART] for i in range(0, len(piece), PART)])
        ids, borders = np.concatenate(got), np.cumsum([len(x) for x in got])[:-1]  # indexes of the tokens behind a border
        reach = WINDOW
        while len(borders):
            at = np.concatenate([[0], np.cumsum(self.width[ids])])
            pairs = self._known([piece[at[j - 1] : at[j + 1]] for j in borders.tolist()], whole=True)
            failed = [j for j, x in zip(borders.tolist(), pairs) if len(x) != 2 or x[0] != ids[j - 1] or x[1] != ids[j]]
            spans: list[list[int]] = []
            for j in failed:
                lo, hi = max(0, j - reach), min(len(ids), j + reach)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            new = self._known([piece[at[lo] : at[hi]] for lo, hi in spans], whole=True)
            out: list[np.ndarray] = []
            edges: list[int] = []
            n = done = 0
            for (lo, hi), x in zip(spans, new):
                out += [ids[done:lo], x]
                n += lo - done
                edges += [n] * (lo > 0)
                n += len(x)
                edges += [n] * (hi < len(ids))
                done = hi
            ids = np.concatenate([*out, ids[done:]])
            borders = np.array(edges, dtype=np.int64)
            reach *= 2
        return ids

    def _pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The pieces of all texts in order, and how many each text has."""
        raw = "".join(texts).encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, dtype=np.uint8)
        starts = np.flatnonzero((b & 0xC0) != 0x80)  # of characters
        chars = np.cumsum(np.fromiter((len(w) for t in texts for w in self.split(t)), dtype=np.int64))
        cut = np.zeros(len(b) + 1, dtype=bool)
        cut[1:-1] = ~self.joins[b[:-1], b[1:]]
        cut[starts[chars[:-1]]] = True
        cut[[0, -1]] = True
        edges = np.flatnonzero(cut)
        ends = np.cumsum([len(t) for t in texts])
        last = np.append(starts, len(b))[ends]
        per = np.diff(np.searchsorted(edges, last), prepend=0)
        e = edges.tolist()
        return [raw[i:j] for i, j in zip(e, e[1:])], per

    def _slices(self, text: str) -> Iterator[str]:
        """text cut between words into slices of about CHARS_AT_ONCE, whose words are those of the text."""
        at = 0
        if len(text) > CHARS_AT_ONCE:
            for m in self.words(text):
                if m.end() - at >= CHARS_AT_ONCE:
                    yield text[at : m.end()]
                    at = m.end()
        if at < len(text):
            yield text[at:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one, where each text's end): ends begin with 0."""
        if not any(texts):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        if len(texts) == 1 and len(texts[0]) > CHARS_AT_ONCE:
            flat = np.concatenate([self.encode([x])[0] for x in self._slices(texts[0])]) if self._cuttable(texts[0]) else self._encode(texts)[0]
            return flat, np.array([0, len(flat)], dtype=np.int64)
        return self._encode(texts)

    def _cuttable(self, text: str) -> bool:
        return len(next(self._slices(text))) < len(text)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, per = self._pieces(texts)
        if len(self.codes) > PIECES_KEPT or self.held > BYTES_KEPT:
            self._forget()
        new = [p for p in {*pieces} if p not in self.codes]
        if new:
            self._learn(new)
        if self.table is None:
            size = np.array([len(x) for x in self.parts], dtype=np.int64)
            self.table = np.concatenate(self.parts), np.cumsum(size) - size, size
        flat, at, size = self.table
        code = np.fromiter(map(self.codes.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        n = size[code]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.concatenate([[0], np.cumsum(per)])]
        return flat[np.repeat(at[code] - total[:-1], n) + np.arange(total[-1])], ends


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = TOKENIZERS, name: str = NAME) -> Encoder:
    """The worker's tokenizer, loaded once per process."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = Encoder(folder, name)
    return _ENCODERS[folder, name]


def encode_column(text, folder: str = TOKENIZERS, name: str = NAME, counts_only: bool = False):
    """array<int> of a text column, or with counts_only its length as int.
    Null and empty texts give the empty list (0)."""

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(folder, name)
        for s in batches:
            texts = [t or "" for t in s.to_pylist()]
            flats, ends, n_ids = [], [np.zeros(1, dtype=np.int64)], 0
            lo = 0
            while lo < len(texts):  # bounded by characters too: texts may be very long
                hi, n = lo + 1, len(texts[lo])
                while hi < len(texts) and n + len(texts[hi]) <= CHARS_AT_ONCE:
                    n += len(texts[hi])
                    hi += 1
                flat, end = enc.encode(texts[lo:hi])
                if not counts_only:
                    flats.append(flat)
                ends.append(end[1:] + n_ids)
                n_ids += int(end[-1])
                lo = hi
            edge = np.concatenate(ends)
            if counts_only:
                yield pa.array(np.diff(edge), type=pa.int32())
            else:
                yield pa.ListArray.from_arrays(pa.array(edge, type=pa.int32()), pa.array(np.concatenate(flats) if flats else np.empty(0, np.int32)))

    ids.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(ids, "int" if counts_only else "array<int>").asNondeterministic()(text)  # else filters evaluate it again


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(key, ids): one row per row of df, in any order; null or empty text gives
    the empty list. Repeated rows stay repeated; other columns are ignored."""
    small_batches(df.sparkSession)
    return df.select(F.col(key), encode_column(F.col(text), folder, name).alias("ids"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(key, n_tokens): as token_ids, without carrying the ids."""
    small_batches(df.sparkSession)
    return df.select(F.col(key), encode_column(F.col(text), folder, name, counts_only=True).alias("n_tokens"))


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
