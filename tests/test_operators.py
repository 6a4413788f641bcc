import json
from collections import Counter
from datetime import date
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import amendments as am
from leafmill.operators import bm25, dense, fusion, locate
from leafmill.operators import documents as dm
from leafmill.operators import objects as ob
from leafmill.plans import answer, registry

ENTITY = "struct<scope:string,type:string,value:string,canonical:string,standard:string,unit:string,valid:boolean>"


def brute_bm25(docs, query):
    tokens = {d: list(dict.fromkeys(t.lower().split())) or [""] for d, t in docs.items()}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in ts)
    idf = {t: log(n - f + 0.5) - log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for d, ts in tokens.items():
        shared = [t for t in dict.fromkeys(query.split()) if t in ts]
        if shared:
            out[d] = sum(idf[t] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in shared)
    return out


DOCS = {1: "apples and oranges", 2: "oranges and bananas and more", 3: "bananas", 4: "", 5: "apples apples kiwi and lime"}


def test_bm25_equals_brute_force(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "id long, body string")
    queries = spark.createDataFrame([(1, "apples and kiwi"), (2, ""), (3, "zzzz"), (4, None)], "q long, t string")
    found = bm25.search(docs, "id", "body", queries, "q", "t", 10).collect()
    assert {r["query"] for r in found} == {1}
    want = brute_bm25(DOCS, "apples and kiwi")
    assert {r.doc: r.score for r in found} == {d: pytest.approx(s, abs=1e-6) for d, s in want.items()}
    assert [r.doc for r in sorted(found, key=lambda r: r["rank"])] == sorted(want, key=lambda d: (-round(want[d], 6), d))


def test_bm25_empty_corpus(spark):
    docs = spark.createDataFrame([], "id long, body string")
    assert bm25.search(docs, "id", "body", spark.createDataFrame([(1, "x y")], "q long, t string"), "q", "t").count() == 0


def test_temporal_rank(spark):
    docs = spark.createDataFrame([(1, date(2023, 5, 1)), (2, date(2023, 6, 1)), (3, date(2018, 1, 1)), (4, None)], "doc long, day date")
    scored = spark.createDataFrame([(1, 2.0), (3, 9.0)], "doc long, score double")
    inside = bm25.temporal_rank(docs, scored, (date(2023, 1, 1), date(2023, 12, 31)), 10)
    assert [r.doc for r in inside.orderBy("rank").collect()] == [1, 2]
    everything = bm25.temporal_rank(docs, scored, (date(1990, 1, 1), date(1990, 12, 31)), 10)
    assert [r.doc for r in everything.orderBy("rank").collect()] == [1, 3, 2, 4]


def test_index_is_stored_and_checked(spark, tmp_path):
    index = bm25.Index(spark, f"file://{tmp_path}/index")
    assert index.load() is None
    tokenized = bm25.tokens_of(spark.createDataFrame(list(DOCS.items()), "id long, body string").select("id", text.tokenize("body").alias("tokens")), "id", F.col("tokens"))
    index.save(tokenized)
    post, stats, terms = index.load()
    assert post.where("term = 'apples'").count() == 2 and stats.first().n_docs == 5 and terms.where("term = 'and'").first().df == 3
    spark.createDataFrame([(bm25.VERSION + 1,)], "version int").write.mode("overwrite").parquet(f"file://{tmp_path}/index/version")
    assert index.load() is None


def test_postings_agree(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [""])], "doc long, tokens array<string>")
    assert sorted(map(tuple, bm25.postings_grouped(rows).collect())) == [(1, "a", 2, 3), (1, "b", 1, 3), (2, "", 1, 1)]


def test_search_many_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "id long, vec array<float>")
    found = dense.search_many(rows, rows.where("id % 100 = 0"), "id", "vec", 5, block=2)
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in (0, 100, 200):
        s = unit @ unit[q]
        s[q] = -2
        assert [r.id for r in found.where(F.col("query") == q).orderBy("rank").collect()] == np.argsort(-s)[:5].tolist()


def test_usable_and_unit(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0])], "id long, vec array<float>")
    assert [r.id for r in rows.where(dense.usable("vec", 2)).collect()] == [1]
    assert rows.where("id = 1").select(dense.unit("vec").alias("u")).first().u == pytest.approx([0.6, 0.8])
    assert dense.pool(rows.where("id IN (1, 2)"), "vec").first().vec == pytest.approx([0.6, 0.8])


def test_embedding_splits_what_fails(spark):
    def model(texts):
        if any(len(t) > 4 for t in texts):
            raise ValueError("too long")
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(1, "abcdefgh"), (2, "ab"), (3, None)], "id long, t string")
    got = {r.id: r.vec for r in dense.embed_texts(rows, "id", "t", model, batch=2).collect()}
    assert set(got) == {1, 2} and sum(v * v for v in got[1]) == pytest.approx(1, abs=1e-5)


def test_missing_chunks(spark):
    chunks = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 2, 0)], "rel_path string, mtime_ns long, chunk_idx int")
    store = spark.createDataFrame([("a", 1, 0, "m"), ("b", 2, 0, "other")], "rel_path string, mtime_ns long, chunk_idx int, model string")
    assert sorted(map(tuple, dense.missing_chunks(chunks, store, "m").collect())) == [("a", 1, 1), ("b", 2, 0)]


def test_rrf(spark):
    lists = spark.createDataFrame([(0, 1, "a", 3.0), (0, 2, "b", 2.0), (0, 3, "c", 1.0), (1, 1, "a", 0.5), (1, 2, "c", 0.4), (1, 3, "d", 9.0), (1, 4, None, 1.0)], "list_no int, rank int, path string, score double")
    got = fusion.rrf(lists).orderBy("rank").collect()
    assert [r.path for r in got] == ["a", "c", "b", "d"] and got[0].score == 3.0 and got[0].rrf == pytest.approx(2 / 61)
    assert fusion.rrf(lists.limit(0)).count() == 0
    assert fusion.relevance_note(0.4, True) and fusion.relevance_note(0.6, True) is None and fusion.relevance_note(None, False)


def test_locate(spark):
    body = "title: x\n/photos/Holiday/img1.jpg\n\n/docs/holidays.txt\n/photos/Holiday/img1.jpg\nplain prose"
    docs = spark.createDataFrame([("inventory/find-dump/disk/a.md", body), ("notes/b.md", "holiday"), ("x.md", None)], "rel_path string, body string")
    got = [(r.drive, r.path, r.score) for r in locate.locate(docs, "rel_path", "body", " holiday ", folder="inventory").collect()]
    assert got == [("disk", "/photos/Holiday/img1.jpg", 3), ("disk", "/docs/holidays.txt", 2)]
    assert locate.locate(docs, "rel_path", "body", "  ").count() == 0


def test_record_hash_ignores_order_and_time():
    assert am.record_hash({"a": 1, "b": 2}, {"tags": ["x"]}, "p") == am.record_hash({"b": 2, "a": 1}, {"tags": ["x"]}, "p", "add")
    assert am.record_hash({"a": 1}, {}, "p") != am.record_hash({"a": 1}, {}, "p", "set")


def amendments(spark, rows):
    kind = f"amend_id long, mode string, doc_key struct<message_id:string,sha256:string,path:string>, fields struct<tags:array<string>,entities:array<{ENTITY}>>, emitted_by string, emitted_at string"
    return spark.createDataFrame(rows, kind)


def store(spark):
    one = ("body", "org", "ACME", None, None, None, None)
    return spark.createDataFrame(
        [(1, "a.md", 10, "s1", "<m1>", ["old"], [one]), (2, "b.md", 20, "s2", None, None, None), (3, "c.md", 30, "s2", None, [], [])],
        f"row_id long, rel_path string, mtime_ns long, sha256 string, message_id string, tags array<string>, entities array<{ENTITY}>",
    )


def test_amendments_resolve_apply_and_wait(spark):
    new = ("body", "org", "ACME", "acme", None, None, True)
    other = (None, "org", "Beta", None, None, None, None)
    rows = amendments(
        spark,
        [
            (1, "add", ("<m1>", "nope", None), (["new", "old"], [new, other]), "p", "2024"),
            (2, "add", (None, "s2", None), (["x"], None), "p", "2024"),
            (3, "add", ("<missing>", "s1", None), (["never"], None), "p", "2024"),
            (4, "add", (None, None, None), (["lost"], None), "q", "2024"),
            (1, "add", ("<m1>", "nope", None), (["new", "old"], [new, other]), "p", "2025"),
        ],
    )
    resolved = am.resolve(rows, store(spark))
    assert sorted((r.amend_id, r.doc) for r in resolved.where("doc IS NOT NULL").collect()) == [(1, 1), (1, 1), (2, 3)]
    got = {r.row_id: r for r in am.apply(store(spark), resolved).collect()}
    assert got[1].tags == ["new", "old"] and [(e.value, e.canonical) for e in got[1].entities] == [("ACME", None), ("Beta", None)]
    assert got[3].tags == ["x"] and got[2].tags is None and got[2].entities is None
    counts = am.apply_counts(resolved, spark.createDataFrame([], "doc long, hash string")).first()
    assert (counts.applied, counts.pending) == (3, 2)
    assert {(r.emitted_by, r.n) for r in am.queue_by_emitter(rows).collect()} == {("p", 4), ("q", 1), (None, 5)}


def test_retraction_counts_producers(spark):
    before = spark.createDataFrame([(1, "p", "tags", "a"), (1, "p", "tags", "b"), (1, "p", "tags", "c"), (1, "q", "tags", "b"), (1, "r", "entities", "e")], "doc long, producer string, field string, value string")
    after = spark.createDataFrame([(1, "p", "tags", "a"), (1, "q", "tags", "b")], "doc long, producer string, field string, value string")
    assert [tuple(r) for r in am.retractable(before, after).collect()] == [(1, "p", "tags", "c")]
    assert am.retractable(before, after.limit(0)).count() == 0


def test_objects(spark):
    stored = spark.createDataFrame([("x",)], "sha256 string")
    fresh = ob.new_objects(spark.createDataFrame([("hello",), ("hello",), (None,), ("",)], "content string"), "content", stored)
    assert fresh.count() == 2
    rows = spark.createDataFrame([("o1", "p", "m1", "s1"), ("o1", "p", "m2", "s2"), ("o2", "p", "m1", "s3"), ("o2", "p", "m1", "s3")], "object_sha string, plugin string, message string, source_sha string")
    assert {(r.object_sha, len(r.producers)) for r in ob.producers(rows).collect()} == {("o1", 2), ("o2", 1)}
    plan = ob.plan_remove(rows, spark.createDataFrame([("m1",)], "message string"))
    assert {tuple(r) for r in plan.collect()} == {("o1", "rewrite", 1), ("o2", "delete", 0)}
    assert [r.sha256 for r in ob.plan_collect(spark.createDataFrame([("o1",), ("o9",), ("o9",)], "sha256 string"), rows).collect()] == ["o9"]
    links = ob.link_names(spark.createDataFrame([("in", "b" * 64, "f.pdf"), ("in", "a" * 64, "f.pdf"), ("in", "c" * 64, "noext"), ("in", "d" * 64, "noext")], "folder string, sha256 string, name string"))
    assert {r.sha256[0]: r.name for r in links.collect()} == {"a": "f.pdf", "b": "f_bbbbbbbb.pdf", "c": "noext", "d": "noext_dddddddd"}
    index = ob.canonical_index(spark.createDataFrame([("z", "../_objects/ab/" + "c" * 62), ("y", "../_objects/ab/" + "c" * 62), ("x", "short")], "path string, target string"))
    assert [(r.sha256[:3], r.path) for r in index.collect()] == [("abc", "y")]


def test_producer_rows_and_cache(spark):
    kind = "object_sha string, plugin string, message string, source_sha string"
    rows = spark.createDataFrame([("o", "p", "m1", "s1")], kind)
    merged = ob.add_producer(rows, spark.createDataFrame([("o", "p", "m9", "s1"), ("o", "p", "m2", "s2")], kind))
    assert sorted(r.message for r in merged.collect()) == ["m2", "m9"]
    assert ob.remove_producer(merged, "m2").count() == 1
    cache_kind = "body_sha string, extractor string, model string, version string, entities array<string>, cached_at string"
    cache = ob.cache_put(spark.createDataFrame([("b", "e", "m1", "1", ["x"], "1"), ("b", "e", "m2", "1", ["y"], "1")], cache_kind), spark.createDataFrame([("b", "e", "m1", "1", ["z"], "0")], cache_kind))
    looked = ob.cache_lookup(spark.createDataFrame([("b", "e", "m1", "1"), ("b", "e", "m1", "2")], "body_sha string, extractor string, model string, version string"), cache)
    assert {(r.version, tuple(r.entities or ())) for r in looked.collect()} == {("1", ("z",)), ("2", ())}


def test_snapshots(spark):
    kind = "rel_path string, mtime_ns long, sha256 string"
    before = spark.createDataFrame([("a", 1, "s"), ("b", 1, "s"), ("c", 1, None)], kind)
    after = spark.createDataFrame([("a", 1, "s"), ("b", 2, "s"), ("d", 1, "s"), ("c", 1, None)], kind)
    assert {tuple(r) for r in dm.snapshot_diff(before, after).collect()} == {("b", "changed"), ("d", "added")}
    assert dm.snapshot_diff(before, before.limit(0)).count() == 3


def test_manifest_and_pages(spark):
    known = spark.createDataFrame([("k1", 2, "old")], "key_id string, timestamp long, text string")
    merged = dm.merge_manifest(known, spark.createDataFrame([("k1", 1, "new"), ("k2", 3, "x"), ("k2", 4, "y")], "key_id string, timestamp long, text string"))
    assert sorted((r.key_id, r.text) for r in merged.collect()) == [("k1", "old"), ("k2", "x")]
    pages = spark.createDataFrame([(1, " abc "), (1, None), (2, "x" * 100), (3, "")], "doc long, page string")
    assert {(r.doc, r.total_chars) for r in dm.scanned_pages(pages, 100).collect()} == {(1, 3), (3, 0)}


def test_registry(spark):
    plugins = registry.Registry()

    def make(spark, config):
        return spark.createDataFrame([("n/a.md", "h1"), ("n/b.md", "h1")], "rel_path string, sha256 string")

    def broken(documents, config):
        raise RuntimeError("no")

    plugins.add(registry.Plugin("notes", "1.0", "converter", make))
    plugins.add(registry.Plugin("bad", "1.0", "amender", broken))
    made = plugins.convert("notes", spark, spark.createDataFrame([], "sha256 string"))
    assert made.count() == 1 and made.first().processor == "notes"
    assert plugins.amend(made) == []
    with pytest.raises(ValueError):
        plugins.add(registry.Plugin("Bad Name", "x", "other", make))
    with pytest.raises(ValueError):
        plugins.add(registry.Plugin("swapped", "1.0", "amender", make))
    assert plugins.remove("notes") and not plugins.remove("notes")
    assert registry.same_twice(made, made) and not registry.same_twice(made, made.limit(0))


def test_hybrid_degrades_and_fuses(spark):
    docs = spark.createDataFrame([("a", "2023-05-01", "A", "red apples"), ("b", "2018-01-01", None, "green apples and pears"), ("c", None, "C", "stones")], "rel_path string, date string, title string, body string")
    tokenized = bm25.tokens_of(docs.select("rel_path", text.tokenize("body").alias("t")), "rel_path", F.col("t"))
    stats = bm25.corpus_stats(tokenized)
    post = bm25.postings_grouped(tokenized)
    index = (post, stats, bm25.term_stats(post, stats))
    hits, trace = answer.hybrid(docs, index, "apples", 5, date(2024, 1, 1))
    assert trace["dense"] == "no_embed_store" and {r.path for r in hits.collect()} == {"a", "b"}
    dated, _ = answer.hybrid(docs, index, "apples last year", 5, date(2024, 1, 1))
    assert [r.path for r in dated.collect()] == ["a"]
    embed = dense.hashing_embedder(16)
    vectors = spark.createDataFrame([(r.rel_path, 0, [float(x) for x in embed([r.body])[0]]) for r in docs.collect()], "rel_path string, chunk_idx int, vec array<float>")
    fused, trace = answer.hybrid(docs, index, "stones", 5, date(2024, 1, 1), vectors, embed)
    assert trace["dense"] is None and fused.orderBy("rank").first().path == "c"
    assert "[1] C\nstones" in answer.context(fused, docs).first().context
    assert list(answer.stream_answer(['data: {"choices":[{"delta":{"content":"Hi<|END_TOKEN|>"}}]}', "data: [DONE]", ": ping"])) == ["Hi"]


def test_entities(spark):
    from leafmill.functions import entities

    rows = spark.createDataFrame([(1, "Mail A.b@Example.ORG or https://x.example/a?b=1, CH93 0076 2011 6238 5295 7 and CH93 0076 2011 6238 5295 8, CHF 1'234.50, +41 79 123 45 67."), (2, None), (3, "")], "id long, body string")
    got = {(r.type, r.canonical, r.valid) for r in entities.extract(rows, "id", "body").collect()}
    assert ("email", "A.b@example.org", None) in got and ("iban", "CH9300762011623852957", True) in got and ("iban", "CH9300762011623852958", False) in got
    assert ("amount", "1234.50", None) in got and ("phone", "+41791234567", None) in got and ("url", "https://x.example/a?b=1,", None) in got


def test_embed_store_is_completed(spark, tmp_path):
    from leafmill.plans import embed_build as eb

    docs = spark.createDataFrame(
        [("a.md", 1, "x" * 4000, "T", None, None, None), ("skip/b.md", 1, "y", None, None, None, None), ("c.md", 1, None, None, None, None, None), ("d.md", 1, None, "Head", ["t"], None, None)],
        f"rel_path string, mtime_ns long, body string, title string, tags array<string>, entities array<{ENTITY}>, participants array<struct<address:string,name:string,role:string>>",
    )
    store_ = eb.EmbedStore(spark, f"file://{tmp_path}/e")
    assert store_.load().count() == 0
    model = dense.hashing_embedder(8)
    assert eb.build(docs, store_, "m", model, ["skip"]) == 4
    assert eb.build(docs, store_, "m", model, ["skip"]) == 0
    assert {(r.rel_path, r.chunk_idx) for r in store_.load().collect()} == {("a.md", 0), ("a.md", 1), ("a.md", 2), ("d.md", 0)}
    changed = docs.withColumn("mtime_ns", F.when(F.col("rel_path") == "d.md", 2).otherwise(F.col("mtime_ns")).cast("long"))
    assert eb.build(changed, store_, "m", model, ["skip"]) == 1 and eb.live(store_, changed, "m").count() == 4


def test_runs(spark):
    from leafmill.plans import runs

    book = runs.Runs()
    first = book.begin(runs.Run("convert", "a"))
    with pytest.raises(RuntimeError):
        book.begin(runs.Run("scrub", "b"))
    other = book.begin(runs.Run("index"))
    book.end(first)
    book.end(other)
    assert [s for s in range(1, 12) if runs.reports(s, 0, 1)] == [1, 2, 3, 5, 8]
    assert runs.guarded(spark, runs.Run("count"), lambda: spark.range(10).count(), 30) == 10
    run = runs.Run("x", done=1, total=3)
    assert run.eta() >= 0 and runs.Run("x").eta() is None


def test_rank_rows_spans_parts(spark):
    from leafmill.operators.ranking import rank_rows

    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN CAST(NULL AS STRING) WHEN id % 3 = 1 THEN 'a' ELSE concat('g', id % 50) END AS g", "id", "(id * 7919) % 1000 AS v").repartition(5)
    got = rank_rows(rows, ["g"], [F.desc("v"), F.asc("id")]).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (-r.v, r.id)):
        want.setdefault(r.g, []).append(r.id)
    assert len(got) == 3000 and all(want[r.g][r["rank"] - 1] == r.id for r in got)
    assert rank_rows(rows, [], [F.asc("id")]).where("rank <> id + 1").count() == 0
    assert rank_rows(rows.limit(0), ["g"], [F.asc("id")]).count() == 0


RECORD = "amend_id long, mode string, doc_key struct<message_id: string, sha256: string, path: string>, fields struct<tags: array<string>, entities: array<struct<scope: string, type: string, value: string>>>, emitted_by string, emitted_at string"


def _run(spark, runs, tags=("kept",)):
    """Tags of document 1 after each run of records (mode, tags, producer, time)."""
    docs = spark.createDataFrame([(1, "a.md", "s", "<m>", list(tags), None)], "row_id long, rel_path string, sha256 string, message_id string, tags array<string>, entities array<struct<scope: string, type: string, value: string>>")
    stored = spark.createDataFrame([], "doc long, producer string, field string, value string")
    out = []
    for run in runs:
        rows = [(i, mode, ("<m>", None, None), (values, None), producer, time) for i, (mode, values, producer, time) in enumerate(run)]
        resolved = am.resolve(spark.createDataFrame(rows, RECORD), docs)
        docs = docs.sparkSession.createDataFrame(am.apply_all(docs, resolved, stored).collect(), docs.schema)
        stored = spark.createDataFrame(am.current_claims(stored, resolved).collect(), stored.schema)
        out.append(docs.first().tags)
    return out


def test_declarative_records_retract_by_count(spark):
    assert _run(spark, [[("set", ["a", "b"], "p", "1")], [("set", ["a"], "p", "2")]], ()) == [["a", "b"], ["a"]]
    assert _run(spark, [[("set", ["s"], "p", "1"), ("set", ["s"], "q", "1")], [("set", [], "p", "2")]], ()) == [["s"], ["s"]]
    assert _run(spark, [[("set", [], "p", "1")]], ("pre",)) == [["pre"]]
    assert _run(spark, [[("add", ["x"], "p", "1")], [("set", ["y"], "p", "2")]]) == [["kept", "x"], ["kept", "y"]]
    assert _run(spark, [[("add", ["x"], "p", "1")], [("set", ["y"], "q", "2")]]) == [["kept", "x"], ["kept", "x", "y"]]
    assert _run(spark, [[("set", ["a", "b"], "p", "1"), ("set", ["b"], "p", "2"), ("add", ["c"], "p", "3")]]) == [["b", "c", "kept"]]
    assert _run(spark, [[("set", ["a"], "p", "1")], [("retract", ["a", "kept"], "p", "2")]]) == [["a", "kept"], ["kept"]]


def test_emit_is_idempotent_and_checked(spark):
    make = lambda *rows: spark.createDataFrame([(i, None, (k, None, None), None if t is None else (t, None), p, str(i)) for i, k, t, p in rows], RECORD)
    queue = am.emit(spark.createDataFrame([], RECORD), make((1, "<m>", ["a"], "p"), (2, "<m>", ["a"], "p"), (3, "<m>", ["b"], "p")))
    assert sorted(r.amend_id for r in queue.collect()) == [1, 3] and {r.mode for r in queue.collect()} == {"add"}
    assert am.emit(queue, make((9, "<m>", ["b"], "p"))).count() == 2
    both = am.emit(queue, make((10, "<m>", ["b"], "p"), (11, "<m>", [], "p")), declarative=True)
    assert sorted((r.amend_id, r.mode) for r in both.collect()) == [(1, "add"), (3, "add"), (10, "set"), (11, "set")]
    for bad in ((4, None, ["a"], "p"), (5, "<m>", [], "p"), (6, "<m>", None, "p"), (7, "<m>", ["a"], "")):
        with pytest.raises(ValueError):
            am.emit(queue, make(bad))


def test_stored_index_reads_only_its_terms(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(i, f"word{i % 50} running häuser common") for i in range(400)], "id long, body string")
    index = bm25.Index(spark, f"file://{tmp_path}/index")
    index.save(bm25.stemmed_tokens(docs, "id", text.tokenize("body")))
    queries = spark.createDataFrame([(1, "runs"), (2, "word7"), (3, ""), (4, "unknown")], "q long, t string")
    terms = bm25.stemmed_query_terms(queries, "q", "t")
    found = index.search(terms, 5)
    assert {r["query"] for r in found.collect()} == {1, 2} and {r.doc % 50 for r in found.where("query = 2").collect()} == {7}
    index.of_terms(terms)[0].explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "bucket" in plan and "In(term" in plan
    # The same by brute force over the stemmed tokens.
    tokenized = {r.doc: r.tokens for r in bm25.stemmed_tokens(docs, "id", text.tokenize("body")).collect()}
    df = sum("run" in t for t in tokenized.values())
    assert df == 400 and index.load()[2].where("term = 'run'").first().df == df
    with pytest.raises(FileNotFoundError):
        bm25.Index(spark, f"file://{tmp_path}/none").of_terms(terms)


def test_hits_as_text_and_json(spark):
    hits = spark.createDataFrame([(2, "b.md", 0.5, None, ""), (1, "ä.md", 1.25, "2024-01-01", "a \"b\"")], "rank int, path string, score double, date string, snippet string")
    assert [r.line for r in answer.as_text(hits).collect()] == ['  1.25  ä.md  (2024-01-01)\n       a "b"', "  0.50  b.md"]
    assert json.loads(answer.as_json(hits).first().json) == [{"path": "ä.md", "score": 1.25, "date": "2024-01-01", "snippet": 'a "b"'}, {"path": "b.md", "score": 0.5, "date": "", "snippet": ""}]


def test_head_findings(spark):
    good = {"source": "web", "date": "2024-01-01T00:00:00Z", "tags": ["a"], "sha256": "x", "processor": "web", "processor_version": "1.0", "web_rank": 3, "entities": [{"a": 1}]}
    heads = {
        1: good, 2: good | {"tags": "a", "rank": 1, "other_x": "[no list]"}, 3: {k: v for k, v in good.items() if k != "sha256"} | {"thread_id": "t"}, 4: {k: v for k, v in good.items() if k != "sha256"} | {"source": "social", "url_sha256": "u", "social_a": True},
        5: {k: v for k, v in good.items() if k != "sha256"} | {"url_sha256": "u"}, 6: {},
    }
    rows = [(i, json.dumps(h)) for i, h in heads.items()] + [(7, None), (8, "[1]"), (9, "{broken")]
    got = {(r.k, r.level, r.check) for r in dm.head_findings(spark.createDataFrame(rows, "k long, head string"), "k").collect()}
    assert got == {(2, "fail", "tags_no_list"), (2, "warn", "unregistered_rank"), (2, "warn", "unregistered_other_x"), (4, "warn", "unregistered_web_rank"), (5, "fail", "missing_sha256")} | {(6, "fail", f"missing_{c}") for c in dm.REQUIRED} | {(i, "fail", "no_head") for i in (7, 8, 9)}


def test_runs_in_parts_go_on_where_they_stopped(spark, tmp_path):
    from leafmill.plans import runs

    active, mark, done = runs.Runs(), f"file://{tmp_path}/mark", []
    run = active.begin(runs.Run("scrub", "notes"))

    def part(i):
        done.append(i)
        if i == 1:
            assert active.cancel(spark, "scrub", "notes") == 1 and active.cancel(spark, "scrub", "mail") == 0

    assert not runs.in_parts(spark, run, 4, part, mark) and done == [0, 1]
    row = active.status(spark).first()
    assert (row.command, row.key, row.done, row.total, row.stopping) == ("scrub", "notes", 2, 4, True)
    active.end(run)
    assert runs.in_parts(spark, runs.Run("scrub", "notes"), 4, done.append, mark) and done == [0, 1, 2, 3] and not (tmp_path / "mark").exists()
    assert active.status(spark).count() == 0


def test_manifest_rules(spark):
    make = lambda **x: registry.Plugin("notes", "1.0", "converter", lambda spark, config: None, **x)
    levels = lambda p: sorted(level for level, _ in registry.check_manifest(p))
    assert levels(make(description="d")) == [] and levels(make()) == ["warn"] and levels(make(description="d", folders=("/a", "b/../c", "ok"))) == ["fail", "fail"]
    assert levels(make(description="d", options={"a": {"requird": 1}, "b": 3, "c": {"required": True}})) == ["fail", "fail", "warn"]
    failing = registry.Plugin("late", "1.0", "amender", lambda documents, config, created=None: documents.withColumn("x", F.raise_error(F.lit("no"))), description="d")
    plugins = registry.Registry()
    plugins.add(failing)
    assert registry.check_interface(failing) == [] and plugins.amend(spark.createDataFrame([("a",)], "rel_path string")) == []


def test_locks_hold_among_applications(spark, tmp_path):
    from leafmill.plans import runs

    folder = f"file://{tmp_path}/locks"
    with runs.exclusive(spark, folder, runs.Run("index", "a")):
        with runs.exclusive(spark, folder, runs.Run("index", "b")), runs.exclusive(spark, folder, runs.Run("scrub", "x")):
            for other in (runs.Run("index", "a"), runs.Run("convert", "y")):
                with pytest.raises(RuntimeError), runs.exclusive(spark, folder, other):
                    pass
    with runs.exclusive(spark, folder, runs.Run("index", "a")), runs.exclusive(spark, folder, runs.Run("index", "a"), stale=-1):
        pass
    assert not list((tmp_path / "locks").glob("*.lock"))


def test_embedding_is_tried_again(spark, tmp_path):
    mark = str(tmp_path / "failed")

    def once(texts):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        return np.ones((len(texts), 4), np.float32)

    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string").coalesce(1)
    assert [r.k for r in dense.embed_texts(rows, "k", "t", once, tries=2, pause=0.01).collect()] == [1]


def test_answer_from_sources(spark):
    docs = spark.createDataFrame([("a", 1, "2023-05-01", "A", "red apples"), ("b", 1, "2018-01-01", None, "green pears")], "rel_path string, mtime_ns long, date string, title string, body string")
    tokenized = bm25.tokens_of(docs.select("rel_path", text.tokenize("body").alias("t")), "rel_path", F.col("t"))
    post, stats = bm25.postings_grouped(tokenized), bm25.corpus_stats(tokenized)
    said = lambda system, prompt: iter([f'data: {json.dumps({"choices": [{"delta": {"content": x}}]})}' for x in (str(len(system) > 0), " ", prompt.split("\n")[0])])
    hits, prompt, words = answer.answer(docs, (post, stats, bm25.term_stats(post, stats)), "apples", 3, date(2024, 1, 1), said)
    assert [r.path for r in hits.collect()] == ["a"] and prompt.startswith("[1] A\nred apples") and words == "True [1] A"
    assert answer.answer(docs, (post, stats, bm25.term_stats(post, stats)), "nothing of it", 3, date(2024, 1, 1), said)[2] == ""


def test_stemmed_fields_count_by_field(spark):
    docs = spark.createDataFrame([(1, ["runs"], ["runs", "häuser"], ["runs"]), (2, [], [], [])], "id long, a array<string>, b array<string>, c array<string>")
    rows = {r.doc: r.tokens for r in bm25.stemmed_fields(docs, "id", F.array("a", "b", "c")).collect()}
    assert rows == {1: sorted(["runs", "runs", "run", "häuser", "haus", "runs", "run"]), 2: [""]} or rows[1].count("run") == 2
    assert rows[1].count("runs") == 3 and rows[2] == [""]
