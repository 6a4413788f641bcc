import random

import numpy as np
import pytest

from leafmill.llm import chunking


def brute(text, limit=2000, reach=500, overlap=200):
    """The rule, one step after the other."""
    start, out = 0, []
    kinds = [lambda p: text[p - 2 : p] == "\n\n", lambda p: text[p - 1] == "\n", lambda p: text[p - 1] == " " and text[p - 2] in ".!?", lambda p: text[p - 1] == " "]
    while len(text) - start > limit:
        end = next((p for kind in kinds for p in range(start + limit, start + limit - reach, -1) if kind(p)), start + limit)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def made(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["x" * rng.choice([1, 5, 600, 2500]), " ", "\n", ". ", "\n\n", "ä🎈"]) for _ in range(rng.choice([5, 60, 300])))


def pieces(df):
    out = {}
    for r in df.orderBy("k", "chunk_idx").collect():
        out.setdefault(r.k, []).append((r.char_from, r.char_to))
    return out


def test_equals_brute_force(spark):
    texts = {i: made(i) for i in range(150)}
    long = {i: t for i, t in texts.items() if len(t) > 2000}
    rows = spark.createDataFrame(list(texts.items()), "k long, t string").repartition(3)
    assert pieces(chunking.split_oversized(rows, "k", "t")) == {i: brute(t) for i, t in long.items()}


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/store_docs.parquet")
    got = pieces(chunking.split_oversized(docs, "row_id", "body").withColumnRenamed("row_id", "k"))
    want = {r.row_id: brute(r.body) for r in docs.select("row_id", "body").collect() if r.body and len(r.body) > 2000}
    assert got == want and want


def test_edges(spark):
    very = "word " * 200_000
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 2000, "c"), (4, "x" * 2001, "d"), (5, very, "e"), (5, very, "f"), (None, "y" * 4100, "g")], "k long, t string, chunk_idx string")
    got = pieces(chunking.split_oversized(rows, "k", "t"))
    assert set(got) == {4, 5, None} and got[4] == [(0, 2000), (1800, 2001)] and len(got[5]) == 2 * len(brute(very)) and got[None] == brute("y" * 4100)
    assert chunking.split_oversized(rows.limit(0), "k", "t").count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(rows, "k", "t", 2000, 500, 1500)


def test_other_limits(spark):
    text = made(3) + made(4)
    rows = spark.createDataFrame([(1, text)], "k long, t string")
    assert pieces(chunking.split_oversized(rows, "k", "t", 300, 100, 50))[1] == brute(text, 300, 100, 50)


def test_embed_rows_cover_the_text(spark):
    text = made(7)
    rows = spark.createDataFrame([("p", text), ("q", "short"), ("r", None), ("s", "")], "path string, t string")
    got = {}
    for r in chunking.embed_rows(rows, "path", "t").orderBy("path", "chunk_idx").collect():
        got.setdefault(r.path, []).append(r.chunk)
    assert got["q"] == ["short"] and set(got) == {"p", "q"}
    assert got["p"] == [text[a:b] for a, b in brute(text)] if len(text) > 2000 else [text]


def test_stretches_without_boundaries_take_few_steps(monkeypatch):
    calls = []
    plain = np.unique
    monkeypatch.setattr(chunking.np, "unique", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    text = "x" * 3_000_000 + " " + "y" * 2_000_000 + "\n" + "z" * 1_000_000
    _, number, begin, end = chunking._pieces([1], [text], 2000, 500, 200)
    assert len(calls) < 40 and len(begin) > 3_000 and end[-1] == len(text) and (end - begin <= 2000).all() and (begin[1:] == end[:-1] - 200).all()
