"""Packs of questions: read from files by every task, ranks kept as lists."""

import numpy as np
import pyarrow as pa

from wayspring.operators import blocks as B


def test_ranks_known_and_counted_are_fused():
    """Lists of two questions, one counted by two tasks, one with all ranks known."""
    rows = pa.table({"query_id": [9, 9, 9, 4], "rid": [1, 2, 3, 1], "b": [5, 6, 7, 8], "v": [1, 2, 3, 4], "r1": [1, None, 2, 1], "r2": [None, 1, None, 1]})
    got = B.by_question(lambda t: t)(rows)
    assert got["lexical"].to_pylist() == [True, False] and got["dense"].to_pylist() == [True, False]
    ahead = pa.table({"query_id": [9, 9], "ahead1": [[0, 3, 0], [0, 4, 0]], "ahead2": [[5, 0, 1], [6, 0, 0]]})
    out = B.fuse_all(2, 60)(got, ahead).to_pylist()
    score = lambda a, b: 1 / (60 + a) + 1 / (60 + b)
    assert [(r["query_id"], r["rank"], r["rid"], r["b"]) for r in out] == [(4, 1, 1, 8), (9, 1, 3, 7), (9, 2, 2, 6)]
    assert np.allclose([r["score"] for r in out], [score(1, 1), score(2, 2), score(8, 1)])


def test_blocks_pass_without_the_questions(spark, monkeypatch):
    """No block is joined with a pack; a pack without known tokens leaves the next its mean length."""
    word = lambda q, t: spark.createDataFrame([(q, t, 1, 1.0, 2.0)] if t else [], "query_id long, token string, qtf long, idf double, avgdl double")
    about = spark.createDataFrame([(1, 1), (2, 1)], "query_id long, need long")
    packed = B.pack_questions(word(2, "w1"), about, 1)
    docs, codes = (book := B._Codes()).of(["w1 w2", "w2"])
    block = B.materialize(spark.createDataFrame([B._pack([1, 2], ["a", "a"], docs, codes, book) | {"df": [1, 2]}], B.BLOCK), "blocks")
    monkeypatch.setattr(type(block), "crossJoin", lambda *_: (_ for _ in ()).throw(AssertionError("joined")))
    assert [r.query_id for r in B.scan(block, packed, B.find_ends(False), 1.2, B.ENDS, "ends").collect()] == [2]
