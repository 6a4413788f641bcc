import os
import random

import pytest

from leafmill.llm import lexicon as lx
from leafmill.llm import tokenizer as tk

JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(JSON):
        pytest.skip("no vocabulary here")
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_merge_equals_reference(reference):
    with open(tk.VOCABULARY, "rb") as f:
        ranks = tk.read_ranks(f.read())
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("abcdeäößéthing🎈") for _ in range(rng.choice([1, 3, 8, 40])))
        pieces = [x for w in tk.regex.findall(tk.PATTERN, word) for x in tk.merge(w.encode(), ranks)]
        assert pieces == reference(word), word


def test_lexicon_round_trip(tmp_path):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 9]))).encode() for _ in range(500)} | {"größe".encode()}
    entries = {w: [rng.randrange(1000) for _ in range(rng.choice([0, 1, 4]))] for w in words}
    path = tmp_path / "l.bin"
    path.write_bytes(lx.build(entries.items()))
    lexicon = lx.Lexicon(str(path))
    asked = sorted(words)
    assert [lexicon.outputs(r) for r in lexicon.find(asked).tolist()] == [entries[w] for w in asked]
    unknown = [b"", b"d", b"abcabcabcabc", b"a" * 300]
    assert all(r == -1 for w, r in zip(unknown, lexicon.find(unknown).tolist()) if w not in entries)


def test_lexicon_shares_suffixes():
    content = lx.build((f"{p}ending".encode(), [1]) for p in "abcdefgh")
    states = int.from_bytes(content[8:16], "little")
    assert states <= 9  # root, one state after any first letter and seven for the common end


def test_empty_lexicon(tmp_path):
    path = tmp_path / "e.bin"
    path.write_bytes(lx.build([]))
    assert lx.Lexicon(str(path)).find([b"a", b""]).tolist() == [-1, -1]


def test_corpus_equals_reference(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in tk.encode_corpus(docs, "doc_id", "text").collect()}
    assert got == {r.doc_id: reference(r.text) if r.text else [] for r in docs.select("doc_id", "text").collect()}


def test_edges(spark, reference):
    texts = ["", None, "   ", "<|endoftext|> x", "é\r\n\t  x  ", "a" * 50_000, "word " * 30_000, "🏳️‍🌈 नमस्ते"]
    rows = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)] + [(0, "", "again")], "k long, t string, ids string")
    got = [(r.k, list(r.ids)) for r in tk.encode_corpus(rows, "k", "t").collect()]
    assert sorted(got) == sorted([(i, reference(t) if t else []) for i, t in enumerate(texts)] + [(0, [])])
    assert tk.encode_corpus(rows.limit(0), "k", "t").count() == 0


def test_small_lexicon_gives_the_same(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    few, many = (tk.encode_corpus(docs, "doc_id", "text", words=n) for n in (3, 60_000))
    assert few.exceptAll(many).count() == 0


def test_a_sampled_lexicon_changes_no_ids(spark, monkeypatch):
    texts = ["the same text again and again"] * 300 + [f"word{i} naïve größe {i * 7919}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    whole = {r.doc_id: r.ids for r in tk.encode_corpus(df, "doc_id", "text").collect()}
    monkeypatch.setattr(tk, "SAMPLE_ROWS", 40)
    seen, plain = [], tk.word_counts
    monkeypatch.setattr(tk, "word_counts", lambda d, t: (seen.append(d.count()), plain(d, t))[1])
    assert {r.doc_id: r.ids for r in tk.encode_corpus(df, "doc_id", "text").collect()} == whole and len(whole) == 600
    assert 5 < seen[0] < 120


def test_words_of_all_rows_are_counted(spark, monkeypatch):
    # More rows than were once counted; a word that is rare in all of them is still in the lexicon.
    df = spark.range(12_000).selectExpr("id AS doc_id", "IF(id % 6000 = 77, 'xylograph', 'plain') AS text")
    kept, plain = [], tk.word_counts
    monkeypatch.setattr(tk, "word_counts", lambda d, t: (kept.append((d.count(), plain(d, t))), kept[-1][1])[1])
    assert tk.encode_corpus(df, "doc_id", "text").count() == 12_000
    assert kept[0][0] == 12_000 and {r.word: r.n for r in kept[0][1].collect()} == {"xylograph": 2, "plain": 11_998}
