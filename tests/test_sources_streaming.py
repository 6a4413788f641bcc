import json

import pytest
from pyspark.sql import functions as F

from leafmill.operators import bm25
from leafmill.sources import blocks, listing, markdown
from leafmill.streaming import incremental as inc


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "mail").mkdir()
    (tmp_path / "plugins").mkdir()
    (tmp_path / "mail" / "a.md").write_text("---\ntitle: Ä\ntags: [x, y]\nother: 7\n---\nBody\n", encoding="utf-8")
    (tmp_path / "mail" / "bad.md").write_text("---\n: [\n---\nBody\n")
    (tmp_path / "mail" / "plain.md").write_text("no head")
    (tmp_path / "plugins" / "p.md").write_text("skipped")
    rows = {r.rel_path: r for r in markdown.with_fields(markdown.read(spark, str(tmp_path))).collect()}
    assert set(rows) == {"mail/a.md", "mail/bad.md", "mail/plain.md"}
    assert rows["mail/a.md"].title == "Ä" and rows["mail/a.md"].tags == ["x", "y"] and rows["mail/a.md"].body == "Body\n"
    assert not rows["mail/bad.md"].ok and rows["mail/bad.md"].body is None
    assert json.loads(rows["mail/a.md"].head)["other"] == 7


def test_notes(spark, tmp_path):
    for name, body in (("One.txt", "x"), ("copy.md", "x"), ("one.markdown", "y"), ("known.txt", "k")):
        (tmp_path / name).write_text(body)
    known = spark.range(1).select(F.sha2(F.lit("k"), 256).alias("sha256"))
    rows = markdown.notes(spark, str(tmp_path), known, ["note"]).collect()
    assert sorted(r.rel_path for r in rows) == ["one.md", "one_2.md"] or len({r.rel_path for r in rows}) == len(rows) == 2


def test_notes_keep_their_head(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntags: [own, note]\ndate: 2020-01-02T03:04:05+00:00\nk: v\n---\nBody")
    (tmp_path / "b.md").write_text("---\n: [\n---\nBroken")
    (tmp_path / "c.txt").write_text("Plain")
    none = spark.createDataFrame([], "sha256 string")
    rows = {r.rel_path: r for r in markdown.notes(spark, str(tmp_path), none, ["note", "new"]).collect()}
    assert rows["a.md"].body == "Body" and rows["a.md"].tags == ["own", "note", "new"] and rows["a.md"].date.startswith("2020-01-02") and json.loads(rows["a.md"].head)["k"] == "v"
    assert rows["b.md"].body.startswith("---") and rows["b.md"].tags == ["note", "new"] and rows["c.md"].body == "Plain" and rows["c.md"].date
    again = markdown.notes(spark, str(tmp_path), markdown.notes(spark, str(tmp_path), none, []).select("sha256"), [])
    assert again.count() == 0


def test_parts_are_rewritten_alone_and_old_versions_go(spark, tmp_path):
    store = inc.Versioned(spark, f"file://{tmp_path}/t", "k string, v int", "k", 8)
    rows = lambda pairs: spark.createDataFrame(pairs, "k string, v int")
    store.upsert(rows([(f"k{i}", 0) for i in range(40)]), 0)
    touched = store.upsert(rows([("k3", 1)]), 1)
    assert len(touched) == 1 and len(list((tmp_path / "t" / "v1").glob("part=*"))) == 1
    assert {r.k: r.v for r in store.read().collect()} == {f"k{i}": int(i == 3) for i in range(40)} and {r.v for r in store.read(before=1).collect()} == {0}
    # A batch that runs again gives the same; what no snapshot names is deleted.
    store.upsert(rows([("k3", 1)]), 1)
    for n in range(2, 6):
        store.upsert(rows([("k3", n)]), n)
    assert store.read().where("k = 'k3'").first().v == 5 and store.read().count() == 40 and store.version() == 5
    assert not list((tmp_path / "t" / "v2").glob("part=*")) and sorted(p.name for p in (tmp_path / "t" / "pointer").glob("batch=*")) == ["batch=4", "batch=5"]
    store.write(rows([]), 6)
    assert store.read().count() == 0 and store.version() == 6


def test_a_table_that_cannot_be_read_is_no_empty_table(spark, tmp_path):
    store = inc.Versioned(spark, f"file://{tmp_path}/t", "k string, v int", "k", 2)
    store.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), 0)
    for file in (tmp_path / "t" / "pointer").rglob("*.parquet"):
        file.write_bytes(b"broken")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        inc.Versioned(spark, f"file://{tmp_path}/t", "k string, v int", "k", 2).read().count()


def test_blocks(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0, "text", "hello", None, None, None), (1, 1, 1, "thinking", "a\nb", None, None, None), (1, 2, 0, "tool_use", None, "grep", "x" * 200, None), (1, 2, 1, "tool_result", None, None, None, "äb"), (2, 1, 0, "image", "no", None, None, None)],
        "conv_id long, turn int, block_no int, type string, text string, name string, input string, content string",
    )
    got = blocks.conversations(rows).collect()
    assert len(got) == 1 and got[0].body == "hello\n\n> a\n> b\n\n[grep: " + "x" * 80 + "]\n\n[result: 3 bytes]"


def test_listing_source(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "a.md").write_text("/x/y.jpg\n\n /z \n")
    spark.dataSource.register(listing.ListingSource)
    rows = spark.read.format("listing").load(str(tmp_path)).collect()
    assert sorted((r.rel_path, r.line) for r in rows) == [("d1/a.md", "/x/y.jpg"), ("d1/a.md", "/z")]


def test_streaming_index(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "rel_path string, mtime_ns long, body string"
    follow = lambda: inc.run_index(spark, source, schema, f"file://{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    spark.createDataFrame([("a", 1, "one two"), ("b", 1, "two")], schema).write.mode("append").parquet(source)
    follow()
    spark.createDataFrame([("a", 2, "three"), ("a", 1, "one two"), ("c", 1, None)], schema).write.mode("append").parquet(source)
    follow()
    store = inc.Versioned(spark, f"file://{tmp_path}/t", "rel_path string, mtime_ns long, tokens array<string>")
    assert {r.rel_path: r.tokens for r in store.read().collect()} == {"a": ["three"], "b": ["two"], "c": []}
    post, stats, _ = inc.index_of(store)
    assert stats.first().n_docs == 3 and post.where("term = 'three'").count() == 1
    full = bm25.tokens_of(store.read(), "rel_path", F.col("tokens"))
    fresh = bm25.term_stats(bm25.postings_grouped(full), bm25.corpus_stats(full))
    assert {r.term: (r.df, round(r.idf, 9)) for r in inc.index_of(store)[2].collect()} == {r.term: (r.df, round(r.idf, 9)) for r in fresh.collect()}
    assert stats.first().avg_len == bm25.corpus_stats(full).first().avg_len


def test_streaming_amendments_wait_for_their_document(spark, tmp_path):
    entity = "struct<scope:string,type:string,value:string>"
    schema = f"amend_id long, mode string, doc_key struct<message_id:string,sha256:string,path:string>, fields struct<tags:array<string>,entities:array<{entity}>>, emitted_by string, emitted_at string"
    docs = spark.createDataFrame([(1, "a.md", "s1", None)], "row_id long, rel_path string, sha256 string, message_id string")
    late = spark.createDataFrame([(1, "a.md", "s1", None), (2, "b.md", "s2", None)], "row_id long, rel_path string, sha256 string, message_id string")
    rows = [(1, "add", (None, "s1", None), (["x"], None), "p", "t"), (2, "add", (None, "s2", None), (["y"], None), "p", "t")]
    source = f"{tmp_path}/in"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    inc.run_amendments(spark, source, schema, docs, f"file://{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    pending = inc.Versioned(spark, f"file://{tmp_path}/t/pending", schema)
    assert [r.amend_id for r in pending.read().collect()] == [2]
    spark.createDataFrame([(3, "add", (None, "s1", None), (["z"], None), "q", "t")], schema).write.mode("append").parquet(source)
    inc.run_amendments(spark, source, schema, late, f"file://{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    claims = inc.Versioned(spark, f"file://{tmp_path}/t/claims", "doc long, producer string, field string, value string")
    assert pending.read().count() == 0
    assert {tuple(r) for r in claims.read().collect()} == {(1, "p", "tags", "x"), (2, "p", "tags", "y"), (1, "q", "tags", "z")}


@pytest.mark.parametrize("delay", ["1 day"])
def test_day_windows(spark, data, tmp_path, delay):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    query = inc.day_windows(stream, delay).writeStream.outputMode("update").format("memory").queryName("days").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("SELECT window.start, event_type, max(n) AS n FROM days GROUP BY 1, 2").agg(F.sum("n")).first()[0]
    assert got == events.count()


def test_streaming_amendments_reach_the_documents(spark, tmp_path):
    entity = "struct<scope:string,type:string,value:string>"
    schema = f"amend_id long, mode string, doc_key struct<message_id:string,sha256:string,path:string>, fields struct<tags:array<string>,entities:array<{entity}>>, emitted_by string, emitted_at string"
    docs = spark.createDataFrame([(1, "a.md", "s1", None, ["own"], None), (2, "b.md", "s2", None, ["own"], None)], f"row_id long, rel_path string, sha256 string, message_id string, tags array<string>, entities array<{entity}>")
    source, target = f"{tmp_path}/in", f"file://{tmp_path}/t"
    batches = [
        [(1, "set", (None, "s1", None), (["x", "y"], [("body", "person", "P")]), "p", "1"), (2, "add", (None, "s1", None), (["y"], None), "q", "1")],
        [(3, "set", (None, "s1", None), (["z"], []), "p", "2")],
        [(4, "retract", (None, "s1", None), (["y"], None), "q", "3"), (5, "add", (None, "s2", None), (["t"], None), "q", "3")],
    ]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        inc.run_amendments(spark, source, schema, docs, target, f"{tmp_path}/c").awaitTermination()
        amended = inc.Versioned(spark, f"{target}/amended", f"row_id long, tags array<string>, entities array<{entity}>")
        seen.append({r.row_id: (r.tags, [e.value for e in r.entities or []]) for r in amended.read().collect()})
    assert seen == [{1: (["own", "x", "y"], ["P"])}, {1: (["own", "y", "z"], [])}, {1: (["own", "z"], []), 2: (["own", "t"], [])}]
