"""Splitting oversized items at natural boundaries, with overlap.

Structure-tree packing: a text is parsed into a tree: sections under headings of
their depth, list items under their indentation, paragraphs; and below a
paragraph lines, sentences, clauses and characters, read only where needed. A
node that fits is kept whole; only an oversized node is descended into; sibling
subtrees are merged bottom-up, as far as the limit allows. A heading belongs to
the first piece of its section, however deep that lies. Every piece after the
first repeats the last `overlap` characters of the one before, so it holds at
most `limit - overlap` new characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspring.runtime import small_batches, table

LIMIT, OVERLAP = 800, 80
_SPACE = r"[\s\p{Z}\x85\x1c-\x1f]"

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_HEADING = re.compile(r"\s*(?:(#{1,6})\s|<[hH]([1-6])[\s>]|第[〇零一二三四五六七八九十百\d]+(章|节))")
_ITEM = re.compile(r"(\s*)(?:[-*+•·●○▪]\s|\d{1,3}[.)、]\s?|[（(]\d{1,3}[)）]|<li[\s>])")
_LISTS, _DEEPEST = 10, 64  # depth of the outermost list; indentations beyond are one level
#: Boundaries inside a paragraph, the higher first; each cut comes after the match.
LEVELS = (
    re.compile(r"[\r\n]+\s*|</(?:p|div|li|tr|h[1-6])>\s*|<br\s*/?>\s*"),
    re.compile(r"[。！？!?…।]+[”’」』）)\]\"'»]*\s*|(?<=[^\W\d_]{2})\.[”’\"')»]*\s+(?=[^\W\d_a-z]|[A-ZÀ-Þ“\"«¿¡])"),
    re.compile(r"[；;：，、,]\s*|\s+"),
)


@dataclass
class Node:
    """text[start:end]; kids tile it. body: where what follows its headings begins."""

    start: int = 0
    end: int = 0
    body: int = 0
    depth: int = 0
    level: int = 0
    kids: list[Node] = field(default_factory=list)


def parse(text: str) -> Node:
    """The tree of sections, list items and paragraphs of a text. Headings without
    a body of their own open the paragraph that follows them."""
    root = Node(depth=-1)
    path, leaves = [root], []
    opened: int | None = None  # where headings not yet followed by a body begin
    leaf: Node | None = None
    blank = False

    def under(depth: int) -> Node:
        while path[-1].depth >= depth:
            path.pop()
        return path[-1]

    for m in _LINE.finditer(text):
        if m.start() == m.end():
            continue
        line = m.group()
        heading = _HEADING.match(line)
        item = None if heading else _ITEM.match(line)
        if not line.strip():
            blank, leaf = True, None
            continue
        if heading:
            depth = len(heading[1]) if heading[1] else int(heading[2]) if heading[2] else 1 + (heading[3] == "节")
            parent = under(depth)
            path.append(Node(depth=depth))
            parent.kids.append(path[-1])
            opened, leaf = m.start() if opened is None else opened, None
        elif item:
            depth = _LISTS + min(len(item[1].strip("\r\n")), _DEEPEST)
            parent = under(depth)
            path.append(Node(depth=depth))
            parent.kids.append(path[-1])
            leaf = None
        elif blank and not line[0].isspace():
            under(_LISTS)
        if not heading and leaf is None:
            leaf = Node(start=m.start() if opened is None else opened, body=m.start())
            opened = None
            path[-1].kids.append(leaf)
            leaves.append(leaf)
        blank = False
    if opened is not None or not leaves:
        leaves.append(Node(start=opened or 0, body=opened or 0))
        root.kids.append(leaves[-1])
    leaves[0].start = 0
    for x, y in zip(leaves, leaves[1:]):
        x.end = y.start
    leaves[-1].end = len(text)
    return _sized(root)


def _sized(node: Node) -> Node:
    """node with the bounds of its kids; kids without text are left out."""
    if node.kids:
        node.kids = [k for k in map(_sized, node.kids) if k.end > k.start]
        if node.kids:
            node.start, node.end, node.body = node.kids[0].start, node.kids[-1].end, node.kids[0].body
    return node


def _parts(text: str, node: Node, size: int) -> list[Node]:
    """The kids of an oversized paragraph: its parts at the highest boundary it has."""
    for level in range(node.level, len(LEVELS)):
        cuts = [m.end() for m in LEVELS[level].finditer(text, node.body, node.end) if node.body < m.end() < node.end]
        if cuts:
            edges = [node.start, *cuts, node.end]
            return [Node(a, b, max(a, node.body), level=level + 1) for a, b in zip(edges, edges[1:])]
    return [Node(a, min(a + size, node.end), a, level=len(LEVELS)) for a in range(node.start, node.end, size)]


def _pack(text: str, node: Node, size: int) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the pieces of a subtree; whole: it holds whole kids only."""
    if node.end - node.start <= size:
        return [(node.start, node.end, True)]
    out: list[tuple[int, int, bool]] = []
    for kid in node.kids or _parts(text, node, size):
        got = _pack(text, kid, size)
        for a, b, whole in got:
            whole = whole and len(got) == 1
            if out and b - out[-1][0] <= size and (whole and out[-1][2] or 4 * min(b - a, out[-1][1] - out[-1][0]) < size):
                out[-1] = (out[-1][0], b, whole and out[-1][2])
            else:
                out.append((a, b, whole))
    return out


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Consecutive [start, end) of the pieces' new text; they cover text wholly."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    return [(a, b) for a, b, _ in _pack(text, parse(text), limit - overlap)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The pieces of text, each at most limit characters; piece k+1 begins with
    the last `overlap` characters of piece k (all of it, were it shorter)."""
    out: list[str] = []
    for lo, hi in spans(text, limit, overlap):
        out.append((out[-1][-overlap:] if out and overlap else "") + text[lo:hi])
    return out


def chunk(df: DataFrame, key: str = "rid", text: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, oversized: bool = False) -> DataFrame:
    """(key, chunk_id, n_chunks, piece): the pieces of every row's text without
    outer white space, numbered from 1. Texts within the limit are one piece (and
    left out if only the oversized are wanted), null and blank texts have none. Rows
    repeated under one key count once (the text that sorts first, should they
    differ); other columns are ignored. Only oversized texts go through Python."""
    small_batches(df.sparkSession)

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([pieces(t, limit, overlap) for t in s], dtype=object)

    cut.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    bare = df.select(F.col(key), F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "").alias("text"))
    if oversized:
        bare = bare.where(F.length("text") > limit)  # before the shuffle, so only these texts are moved
    once = bare.groupBy(key).agg(F.min("text").alias("text")).where(F.length("text") > 0)
    long = once.where(F.length("text") > limit)
    cut_up = long.select(key, F.pandas_udf(cut, "array<string>").asNondeterministic()("text").alias("pieces"))  # else filters evaluate it again
    if not oversized:
        cut_up = cut_up.unionByName(once.where(F.length("text") <= limit).select(key, F.array("text").alias("pieces")))
    return cut_up.select(key, F.size("pieces").alias("n_chunks"), F.posexplode("pieces").alias("pos", "piece")).select(
        key, (F.col("pos") + 1).cast("int").alias("chunk_id"), "n_chunks", "piece"
    )


def p5_found(spark, sf_dir: str) -> DataFrame:
    return chunk(table(spark, sf_dir, "knowledge_entries"), oversized=True).where("chunk_id = 1").select("rid")


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces of the oversized entries."""
    return chunk(table(spark, sf_dir, "knowledge_entries"), oversized=True).select("rid", "chunk_id", "piece")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
ORACLE = {
    "p5_found": r"select distinct rid from knowledge_entries where length(regexp_replace(content, '^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$', '', 'g')) > 800",
}
