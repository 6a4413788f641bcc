"""Queries of text functions, word search, vector search, fusion and location, with SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import decode, expansion, stem, temporal, text
from leafmill.operators import bm25, dense, documents, fusion, locate
from leafmill.plans import answer, embed_build
from leafmill.queries import stem_sql
from leafmill.session import fresh_path, table, written

DIMS = 64
AS_OF = date(2024, 6, 15)
PHRASE = "heating invoice last year"
NOWHERE = "heating invoice today"
PHRASE_DAY = date(1999, 1, 1)
TERM = "sal"
SPLIT = "2023-01-01 00:00:00"
MODEL = "hashing"

_W = r"[\p{L}\p{N}_][\p{L}\p{N}_''-]+"


def _tok(column: str) -> str:
    return f"coalesce(list_distinct(regexp_extract_all(lower({column}), '{_W}')), CAST([] AS VARCHAR[]))"


def _strip(column: str) -> str:
    return rf"regexp_replace({column}, '^[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1c-\x1f]+|[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1c-\x1f]+$', '', 'g')"


def tokenize_doc(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.tokenize("text")
    return table(spark, sf, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("digest"))


def token_df(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(text.tokenize("text")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def doc_len_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select(text.tokenize("text").alias("t"))
    return t.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size("t")), 6).alias("avg_len"), F.max(F.size("t")).cast("bigint").alias("longest"))


def field_term_tf(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "store_docs")
    tokens = text.field_tokens("body", "title", "tags", "entities", "participants")
    post = bm25.postings_grouped(bm25.tokens_of(d, "row_id", tokens))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").cast("bigint").alias("most"))


def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    tokenized = written(bm25.tokens_of(table(spark, sf, "documents").select("doc_id", text.tokenize("text").alias("tokens")), "doc_id", F.col("tokens")), "tokens")
    post = tokenized.select("doc", F.explode("tokens").alias("term"))
    return bm25.term_stats(post, bm25.corpus_stats(tokenized)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "saved_queries"), "query_id", "text", 20)


def _stored_index(spark: SparkSession, tokenized: DataFrame) -> bm25.Index:
    index = bm25.Index(spark, fresh_path(spark, "bm25-index"))
    index.save(written(tokenized, "tokens"))
    return index


def stem_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents with its English and German stem."""
    words = table(spark, sf, "documents").select(F.explode(text.tokenize("text")).alias("term"))
    pairs = stem.stem_pairs(words)
    return pairs.select("term", "english", "german")


def bm25_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of each saved query, from a stored index of words with their English and German stems."""
    index = _stored_index(spark, bm25.stemmed_tokens(table(spark, sf, "documents"), "doc_id", text.tokenize("text")))
    return index.search(bm25.stemmed_query_terms(table(spark, sf, "saved_queries"), "query_id", "text"), 20)


def bm25_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same of words as they are written, from a stored index of which only the query's terms are read."""
    index = _stored_index(spark, bm25.tokens_of(table(spark, sf, "documents").select("doc_id", text.tokenize("text").alias("tokens")), "doc_id", F.col("tokens")))
    return index.search(bm25.query_terms(table(spark, sf, "saved_queries"), "query_id", "text"), 20)


def field_terms_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and occurrences of each term of whole documents, body and metadata, with stems."""
    tokenized = bm25.stemmed_fields(table(spark, sf, "store_docs"), "row_id", text.field_lists("body", "title", "tags", "entities", "participants"))
    return bm25.postings_grouped(tokenized).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").cast("bigint").alias("most"))


def answer_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with snippets of a question with a date phrase: stems, expansion, vectors of the hashing embedder, all fused."""
    docs = documents.newest_versions(table(spark, sf, "store_docs").where(F.col("rel_path").isNotNull()))
    index = _stored_index(spark, bm25.stemmed_fields(docs, "rel_path", text.field_lists("body", "title", "tags", "entities", "participants")))
    embed = dense.hashing_embedder(DIMS)
    store = embed_build.EmbedStore(spark, fresh_path(spark, "embed-store"))
    embed_build.build(docs, store, MODEL, embed)
    ask = expansion.dictionary_expander({"heating": ["heizung", "heizkosten"], "invoice": ["rechnung", "facture"]})
    hits, _ = answer.hybrid(docs, index, PHRASE, 20, AS_OF, embed_build.live(store, docs, MODEL), embed, ask)
    found = answer.with_snippets(hits, docs, PHRASE)
    return found.select(F.col("rank").cast("bigint").alias("rank"), "path", F.round("score", 6).alias("score"), "date", "snippet")


def hits_json(spark: SparkSession, sf: str) -> DataFrame:
    """The result form for other programs, of the ten best paths of all runs of saved queries."""
    best = table(spark, sf, "hits").where("path IS NOT NULL AND score IS NOT NULL").groupBy("path").agg(F.max("score").alias("score"), F.max("date").alias("date"), F.max("snippet").alias("snippet"))
    ten = best.orderBy(F.desc("score"), "path").limit(10)
    ranked = ten.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))  # ten rows
    return answer.as_json(ranked.withColumn("score", F.col("score").cast("string")))


def date_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The days that each phrase means on a fixed day."""
    rows = []
    for phrases in temporal.PHRASES.values():
        for phrase in phrases.split("|"):
            low, high = temporal.date_window(f"Notes: {phrase.upper()}, please", AS_OF)
            rows.append((phrase, str(low), str(high)))
    return spark.createDataFrame(rows, "phrase string, low string, high string")


def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as they are embedded: windows of the body behind the document's head."""
    d = documents.newest_versions(table(spark, sf, "store_docs").where(F.col("rel_path").isNotNull()))
    return embed_build.chunks(d).select("rel_path", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def embed_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the newest versions that the vector store lacks for each of its models."""
    d = embed_build.chunks(documents.newest_versions(table(spark, sf, "store_docs").where(F.col("rel_path").isNotNull()))).select("rel_path", "mtime_ns", "chunk_idx")
    have = table(spark, sf, "chunk_vectors")
    wanted = d.crossJoin(F.broadcast(have.where("model IS NOT NULL").select("model").distinct()))  # a row per model
    keys = ["rel_path", "mtime_ns", "chunk_idx", "model"]
    return wanted.join(have.select(*keys), keys, "left_anti").groupBy("rel_path", "model").agg(F.count("*").alias("n"), F.min("chunk_idx").cast("bigint").alias("first"))


def embed_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors per file after two runs of the build: the documents that came first, then all; the second adds what is missing."""
    d = table(spark, sf, "store_docs").where(F.col("rel_path").isNotNull())
    store = embed_build.EmbedStore(spark, fresh_path(spark, "embed-store"))
    embed = dense.hashing_embedder(DIMS)
    embed_build.build(documents.newest_versions(d.where(F.col("ingested_at") < F.lit(SPLIT).cast("timestamp_ntz"))), store, MODEL, embed)
    newest = documents.newest_versions(d)
    embed_build.build(newest, store, MODEL, embed, parts=2)
    return embed_build.live(store, newest, MODEL).groupBy("rel_path").agg(F.count("*").alias("n"), F.max("chunk_idx").cast("bigint").alias("last"))


def decoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's bytes decoded and repaired."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return decode.decoded(d, "data", "clean").select("doc_id", F.length("clean").cast("bigint").alias("n_chars"), F.md5(F.col("clean").cast("binary")).alias("digest"))


def _temporal(spark: SparkSession, sf: str, query: str, as_of: date) -> DataFrame:
    docs = table(spark, sf, "store_docs")
    one = spark.createDataFrame([(1, query)], "query bigint, text string")
    tokenized = written(bm25.tokens_of(docs.select("row_id", text.tokenize("body").alias("tokens")), "row_id", F.col("tokens")), "tokens")
    post = tokenized.select("doc", F.explode("tokens").alias("term"), F.lit(1).alias("tf"), F.size("tokens").alias("len"))
    stats = bm25.corpus_stats(tokenized)
    scored = bm25.score(post, bm25.query_terms(one, "query", "text"), stats, bm25.term_stats(post, stats)).withColumn("score", F.round("score", 6))
    dated = docs.select(F.col("row_id").alias("doc"), temporal.doc_date("date").alias("day"))
    return bm25.temporal_rank(dated, scored, temporal.date_window(query, as_of), 20).select("rank", "doc", F.col("day").cast("string").alias("day"), "score")


def bm25_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return _temporal(spark, sf, PHRASE, AS_OF)


def bm25_temporal_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _temporal(spark, sf, NOWHERE, PHRASE_DAY)


def _bm25_sql(source: str, key: str, body: str, queries: str) -> str:
    return f"""
WITH tk AS MATERIALIZED (SELECT {key} AS doc, CASE WHEN len(t) = 0 THEN [''] ELSE t END AS t FROM (SELECT {key}, {_tok(body)} AS t FROM {source})),
post AS MATERIALIZED (SELECT doc, unnest(t) AS term, len(t) AS len FROM tk),
stats AS (SELECT count(*) AS n, avg(len(t)) AS al FROM tk),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stats),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT query, unnest(t) AS term FROM (SELECT query, {_tok("txt")} AS t FROM ({queries}))),
scored AS (SELECT query, doc, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score FROM post JOIN q USING (term) JOIN idf USING (term), stats GROUP BY 1, 2)"""


_TIME = r"([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?"
_WEEK = "(make_date(CAST(regexp_extract({0}, {1}, 1) AS INT), 1, 4) - CAST(isodow(make_date(CAST(regexp_extract({0}, {1}, 1) AS INT), 1, 4)) - 1 AS INT) + (CAST({2} AS INT) - 1) * 7 + {3})"


def _of_week(shape: str, week: str, day: str) -> str:
    found = _WEEK.format("date", shape, week, day)
    return f"CASE WHEN weekofyear({found}) = CAST({week} AS INT) THEN CAST({found} AS DATE) END"


DAY_SQL = rf"""CASE WHEN regexp_matches(date, '^\d{{4}}-\d\d-\d\d') THEN try_cast(substr(date, 1, 10) AS DATE)
 WHEN regexp_matches(date, '^\d{{4}}-W\d\d-[1-7]') THEN {_of_week("'^([0-9]{4})-W'", "substr(date, 7, 2)", "CAST(substr(date, 10, 1) AS INT) - 1")}
 WHEN regexp_matches(date, '^\d{{8}}{_TIME}$') THEN try_cast(substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) AS DATE)
 WHEN regexp_matches(date, '^\d{{4}}W\d\d[1-7]{_TIME}$') THEN {_of_week("'^([0-9]{4})W'", "substr(date, 6, 2)", "CAST(substr(date, 8, 1) AS INT) - 1")}
 WHEN regexp_matches(date, '^\d{{4}}W\d\d{_TIME}$') THEN {_of_week("'^([0-9]{4})W'", "substr(date, 6, 2)", "0")}
 WHEN regexp_matches(date, '^\d{{4}}-W\d\d{_TIME}$') THEN {_of_week("'^([0-9]{4})-W'", "substr(date, 7, 2)", "0")} END"""


#: The days that the two date phrases mean, written out: last year on 2024-06-15, today on 1999-01-01.
_LAST_YEAR, _TODAY = ("2023-01-01", "2023-12-31"), ("1999-01-01", "1999-01-01")


def _temporal_sql(query: str, low: str, high: str) -> str:
    return (
        _bm25_sql("store_docs", "row_id", "body", f"SELECT 1 AS query, '{query}' AS txt")
        + f""",
dated AS (SELECT row_id AS doc, {DAY_SQL} AS day FROM store_docs),
marked AS (SELECT doc, day, coalesce(day BETWEEN DATE '{low}' AND DATE '{high}', false) AS inside FROM dated),
kept AS (SELECT doc, day FROM marked WHERE inside OR NOT (SELECT coalesce(bool_or(inside), false) FROM marked))
SELECT row_number() OVER (ORDER BY score IS NOT NULL DESC, day DESC NULLS LAST, coalesce(score, 0) DESC, doc) AS rank, doc, CAST(day AS VARCHAR) AS day, coalesce(score, 0.0) AS score
FROM kept LEFT JOIN scored USING (doc) ORDER BY rank LIMIT 20"""
    )


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "store_docs").where(F.col("body").isNotNull()).select("row_id", text.snippet("body", F.array(F.lit("invoice"), F.lit("heizkostenabrechnung"), F.lit("protokoll"))).alias("snippet"))


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").where(dense.usable("embedding", DIMS))
    return dense.search_many(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)


def query_vec_pool(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").where(dense.usable("embedding", DIMS))
    return dense.pool(e, "embedding").select(F.posexplode("vec").alias("at", "x")).select(F.col("at").cast("bigint").alias("at"), F.round("x", 6).alias("x"))


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    e = table(spark, sf, "embeddings").where(dense.usable("embedding", DIMS))
    return [float(x) for x in e.orderBy("vec_id").first()["embedding"]]


def dense_file_max(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").where(dense.usable("vec", DIMS) & F.col("rel_path").isNotNull())
    q = _query_vector(spark, sf)
    length = sum(x * x for x in q) ** 0.5
    scored = v.select("rel_path", (dense.dot("vec", [x / length for x in q]) / dense.norm("vec")).alias("score"))
    return dense.file_scores(scored, "rel_path").select("rel_path", F.round("score", 6).alias("score"))


def dense_temporal(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").where(dense.usable("vec", DIMS) & F.col("rel_path").isNotNull())
    days = table(spark, sf, "store_docs").groupBy("rel_path").agg(F.max(temporal.doc_date("date")).alias("day"))
    found = dense.search(v, "vec_id", "rel_path", "vec", _query_vector(spark, sf), 20, days, temporal.date_window(PHRASE, AS_OF))
    return found.select("rel_path", F.round("score", 6).alias("score"))


_GOOD = "len({0}) = 64 AND len(list_filter({0}, lambda x: isfinite(x))) = 64 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_COS = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / sqrt(list_inner_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) / sqrt(list_inner_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))"
_Q = f"(SELECT embedding FROM embeddings WHERE {_GOOD.format('embedding')} ORDER BY vec_id LIMIT 1)"


def _hybrid(spark: SparkSession, sf: str, words: DataFrame) -> DataFrame:
    docs = table(spark, sf, "store_docs").where(F.col("body").isNotNull())
    by_path = words.join(docs.select(F.col("row_id").alias("doc"), "rel_path"), "doc").groupBy("rel_path").agg(F.max("score").alias("score"))
    v = table(spark, sf, "chunk_vectors").where(dense.usable("vec", DIMS) & F.col("rel_path").isNotNull())
    near = dense.search(v, "vec_id", "rel_path", "vec", _query_vector(spark, sf), 200).withColumn("score", F.round("score", 6))
    found = fusion.fuse(fusion.ranked(by_path, "rel_path"), fusion.ranked(near, "rel_path"), k=20)
    return found.select(F.col("rank").cast("bigint").alias("rank"), "path", "score", "rrf")


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "store_docs").where(F.col("body").isNotNull())
    one = spark.createDataFrame([(1, "heating invoice")], "query bigint, text string")
    return _hybrid(spark, sf, bm25.search(docs, "row_id", "body", one, "query", "text", 200))


def hybrid_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the words' stems, from a stored index."""
    docs = table(spark, sf, "store_docs").where(F.col("body").isNotNull())
    one = spark.createDataFrame([(1, "heating invoice")], "query bigint, text string")
    index = _stored_index(spark, bm25.stemmed_tokens(docs, "row_id", text.tokenize("body")))
    return _hybrid(spark, sf, index.search(bm25.stemmed_query_terms(one, "query", "text"), 200))


_FUSED = f""",
w AS (SELECT rel_path AS path, max(score) AS score FROM (SELECT doc, score FROM scored ORDER BY score DESC, doc LIMIT 200) JOIN store_docs ON row_id = doc GROUP BY 1),
chunks AS (SELECT rel_path AS path, vec_id, {_COS.format("vec", _Q)} AS score FROM chunk_vectors WHERE rel_path IS NOT NULL AND {_GOOD.format("vec")}),
v AS (SELECT path, round(max(score), 6) AS score FROM (SELECT * FROM chunks ORDER BY score DESC, vec_id, path LIMIT 12000) GROUP BY 1 ORDER BY max(score) DESC, path LIMIT 200),
lists AS (SELECT 0 AS l, row_number() OVER (ORDER BY score DESC, path) AS r, path, score FROM w UNION ALL SELECT 1, row_number() OVER (ORDER BY score DESC, path), path, score FROM v),
fused AS (SELECT path, round(sum(1.0 / (60 + r)), 9) AS rrf, max(score) AS score, min(l * 1000000 + r) AS first FROM lists GROUP BY 1)
SELECT row_number() OVER (ORDER BY rrf DESC, first, path) AS rank, path, score, rrf FROM fused ORDER BY rank LIMIT 20"""
_ASKED = ("(SELECT * FROM store_docs WHERE body IS NOT NULL)", "row_id", "body", "SELECT 1 AS query, 'heating invoice' AS txt")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hits").select("query_id", "list_no", "rank", "path", "score").distinct()


def rrf_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = fusion.rrf(_runs(spark, sf), "query_id")
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "path", "score", "rrf")


def rrf_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    last = runs.groupBy("query_id").agg(F.max("list_no").alias("last"))
    marked = runs.join(last, "query_id")
    variants = marked.where("list_no < last").select("query_id", F.col("list_no").alias("variant"), "rank", "path", "score")
    newest = marked.where("list_no = last AND path IS NOT NULL").select("query_id", "rank", "path", "score")
    found = fusion.two_stage(variants, newest, 10, "query_id")
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "path", "score", "rrf")


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.posexplode(text.window_starts("text")).alias("chunk_idx", "start"))
    return d.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.md5(F.substr("text", F.col("start") + 1, F.lit(2000)).cast("binary")).alias("digest"))


def chunk_prefix(spark: SparkSession, sf: str) -> DataFrame:
    p = text.chunk_prefix("title", "tags", "entities", "participants")
    return table(spark, sf, "store_docs").select("row_id", F.length(p).cast("bigint").alias("n_chars"), F.md5(p.cast("binary")).alias("digest"))


def doc_date_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "store_docs").select("row_id", temporal.doc_date("date").cast("string").alias("day"))


def path_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.path_tokens("rel_path"), "|").alias("parts"))


def _path_sql(p: str) -> str:
    humps = rf"regexp_replace(regexp_replace({p}, '([a-z0-9])([A-Z])', '\1/\2', 'g'), '([A-Z])([A-Z][a-z])', '\1/\2', 'g')"
    return rf"list_filter(list_transform(regexp_split_to_array({humps}, '[/_\-.\s]+'), lambda x: lower(x)), lambda x: x <> '')"


_LINES = f"SELECT doc_id, rel_path, {_strip('line')} AS line FROM (SELECT doc_id, rel_path, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM documents WHERE source = 'inventory')"
_SCORE = f"""CASE WHEN list_contains({_path_sql("line")}, '{TERM}') OR list_contains(string_split(lower(line), '/'), '{TERM}') THEN 3
 WHEN len(list_filter(list_concat({_path_sql("line")}, string_split(lower(line), '/')), lambda x: starts_with(x, '{TERM}'))) > 0 THEN 2
 WHEN contains(lower(line), '{TERM}') THEN 1 ELSE 0 END"""


def path_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source = 'inventory'")
    lines = locate.listing_lines(d.select(F.col("doc_id").alias("path"), "text"), "path", "text")
    return lines.select(text.path_score("line", F.lit(TERM)).cast("bigint").alias("match")).groupBy("match").agg(F.count("*").alias("n"))


def locate_topk(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source = 'inventory'")
    return locate.locate(d, "rel_path", "text", TERM, 20).select("drive", "path", F.col("score").cast("bigint").alias("score"))


def skip_prefix(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.has_prefix("rel_path", ["inventory", "./web/linkhub.example/", ""]).alias("skipped"), text.drive_id("rel_path").alias("drive"))


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "store_docs").select("row_id", text.slugify(F.coalesce("title", "subject"), "note").alias("slug"))


def scanned_only(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").where(F.col("source").startswith("pdf")).select(F.col("doc_id").alias("doc"), F.explode_outer(F.split("text", "\f")).alias("page"))
    return documents.scanned_pages(pages, 400).select(F.col("doc").alias("doc_id"), "n_pages", "total_chars")


#: The days of every phrase on Saturday 2024-06-15, by hand.
_WINDOWS = ", ".join(
    f"('{phrase}', '{low}', '{high}')"
    for phrases, low, high in (
        ("last month|previous month|vorigen monat|letzten monat|letztem monat|vergangenen monat", "2024-05-01", "2024-05-31"),
        ("this month|diesen monat|diesem monat|dieses monat|laufenden monat|aktuellen monat", "2024-06-01", "2024-06-15"),
        ("last week|previous week|vorige woche|letzte woche|letzten woche|letzter woche", "2024-06-03", "2024-06-09"),
        ("this week|dieser woche|diese woche|diesem woche", "2024-06-10", "2024-06-15"),
        ("last year|previous year|letztes jahr|letzten jahr|letztem jahr|vergangenen jahr|vergangenes jahr", "2023-01-01", "2023-12-31"),
        ("this year|dieses jahr|diesen jahr|diesem jahr", "2024-01-01", "2024-06-15"),
        ("yesterday|gestern", "2024-06-14", "2024-06-14"),
        ("today|heute", "2024-06-15", "2024-06-15"),
        ("recent|recently|lately|zuletzt|jüngst|kürzlich|neulich|in letzter zeit", "2024-05-16", "2024-06-15"),
    )
    for phrase in phrases.split("|")
)
def _stemmed_sql(source: str, key: str, body: str, queries: str) -> str:
    """``_bm25_sql`` over the words of documents and queries with their stems."""
    return f"""
WITH d AS MATERIALIZED (SELECT {key} AS doc, {_tok(body)} AS t FROM {source}), q0 AS (SELECT query, unnest({_tok("txt")}) AS term FROM ({queries})),
terms AS MATERIALIZED (SELECT DISTINCT term FROM (SELECT unnest(t) AS term FROM d UNION ALL SELECT term FROM q0)), {stem_sql.stems("terms")},
post0 AS MATERIALIZED (SELECT DISTINCT doc, unnest([term, english, german]) AS term FROM (SELECT doc, unnest(t) AS term FROM d) JOIN stems USING (term)),
all0 AS MATERIALIZED (SELECT doc, term FROM post0 UNION ALL SELECT doc, '' FROM d WHERE len(t) = 0),
post AS MATERIALIZED (SELECT doc, term, count(*) OVER (PARTITION BY doc) AS len FROM all0),
stats AS (SELECT count(DISTINCT doc) AS n, count(*) / count(DISTINCT doc) AS al FROM all0),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stats),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT DISTINCT query, unnest([term, english, german]) AS term FROM q0 JOIN stems USING (term)),
scored AS (SELECT query, doc, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len / al))), 6) AS score FROM post JOIN q USING (term) JOIN idf USING (term), stats GROUP BY 1, 2)"""


_BEST = " SELECT query, rank, doc, score FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= 20"
_STEMMED = _stemmed_sql("documents", "doc_id", "text", "SELECT query_id AS query, text AS txt FROM saved_queries") + _BEST
_LIVE = "list_filter(coalesce(entities, []), lambda e: e.valid IS DISTINCT FROM false)"
_CHUNKS = f"""
d AS (SELECT * FROM store_docs WHERE rel_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY mtime_ns DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) = 1),
h AS (SELECT rel_path, mtime_ns, coalesce(body, '') AS body, substr(concat_ws(chr(10), nullif(title, ''), nullif(array_to_string(tags, ' '), ''),
 nullif(array_to_string(flatten(list_transform({_LIVE}, lambda e: [e.value, e.canonical])), ' '), ''),
 nullif(array_to_string(flatten(list_transform(coalesce(participants, []), lambda p: [p.address, p."name"])), ' '), '')), 1, 500) AS head FROM d),
k AS (SELECT rel_path, mtime_ns, i AS chunk_idx, concat_ws(chr(10), nullif(head, ''), nullif(substr(body, CAST(i * 1800 + 1 AS BIGINT), 2000), '')) AS chunk
 FROM (SELECT *, unnest(range(CAST(greatest(ceil((length(body) - 2000) / 1800.0), 0) AS BIGINT) + 1)) AS i FROM h))"""


def queries() -> dict:
    names = (
        tokenize_doc, token_df, doc_len_stats, field_term_tf, bm25_idf, bm25_topk, bm25_stored, bm25_stemmed, stem_table, field_terms_stemmed, answer_hits, hits_json, date_windows, embed_chunks, embed_missing, embed_store, decoded_texts, bm25_temporal, bm25_temporal_fallback, snippets, cosine_topk, query_vec_pool, dense_file_max,
        dense_temporal, hybrid_topk, hybrid_stemmed, rrf_runs, rrf_two_stage, chunk_windows, chunk_prefix, doc_date_parse, path_tokenize, path_scores, locate_topk, skip_prefix, slugs, scanned_only,
    )
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    low, high = _LAST_YEAR
    ent = "list_filter(coalesce(entities, []), lambda e: e.valid IS DISTINCT FROM false)"
    each = lambda c: f"SELECT row_id, unnest({_tok(c)}) AS term FROM"
    fused = "round(sum(1.0 / (60 + rank)), 9) AS rrf, max(score) AS score"
    runs = "SELECT DISTINCT query_id, list_no, rank, path, score FROM hits"
    return {
        "tokenize_doc": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)",
        "token_df": f"SELECT term, count(*) AS df FROM (SELECT unnest({_tok('text')}) AS term FROM documents) GROUP BY 1",
        "doc_len_stats": f"SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avg_len, max(len(t)) AS longest FROM (SELECT {_tok('text')} AS t FROM documents)",
        "field_term_tf": f"""
WITH e AS (SELECT row_id, unnest({ent}) AS e FROM store_docs), p AS (SELECT row_id, unnest(participants) AS p FROM store_docs),
t AS ({each("body")} store_docs UNION ALL {each("title")} store_docs UNION ALL SELECT row_id, lower(x) FROM (SELECT row_id, unnest(tags) AS x FROM store_docs) WHERE x IS NOT NULL
 UNION ALL {each("e.value")} e UNION ALL {each("e.canonical")} e UNION ALL {each("p.address")} p UNION ALL {each('p."name"')} p),
a AS (SELECT row_id, term FROM t UNION ALL SELECT row_id, '' FROM store_docs WHERE row_id NOT IN (SELECT row_id FROM t)),
tf AS (SELECT row_id, term, count(*) AS tf FROM a GROUP BY 1, 2)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS most FROM tf GROUP BY 1""",
        "bm25_idf": _bm25_sql("documents", "doc_id", "text", "SELECT 1 AS query, '' AS txt") + " SELECT term, df, round(idf, 6) AS idf FROM idf",
        "bm25_topk": _bm25_sql("documents", "doc_id", "text", "SELECT query_id AS query, text AS txt FROM saved_queries")
        + " SELECT query, rank, doc, score FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= 20",
        "bm25_stored": _bm25_sql("documents", "doc_id", "text", "SELECT query_id AS query, text AS txt FROM saved_queries")
        + " SELECT query, rank, doc, score FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= 20",
        "stem_table": f"WITH terms AS MATERIALIZED (SELECT DISTINCT unnest({_tok('text')}) AS term FROM documents), {stem_sql.stems('terms')} SELECT * FROM stems",
        "bm25_stemmed": _STEMMED,
        "field_terms_stemmed": f"""
WITH e AS (SELECT row_id, unnest({ent}) AS e FROM store_docs), p AS (SELECT row_id, unnest(participants) AS p FROM store_docs),
t AS MATERIALIZED ({each("body").replace("row_id,", "row_id, 'b' AS f,", 1)} store_docs UNION ALL {each("title").replace("row_id,", "row_id, 't' AS f,", 1)} store_docs
 UNION ALL SELECT row_id, 'v' || i, unnest({_tok("e.value")}) FROM (SELECT row_id, e, row_number() OVER () AS i FROM e) UNION ALL SELECT row_id, 'c' || i, unnest({_tok("e.canonical")}) FROM (SELECT row_id, e, row_number() OVER () AS i FROM e)
 UNION ALL SELECT row_id, 'a' || i, unnest({_tok("p.address")}) FROM (SELECT row_id, p, row_number() OVER () AS i FROM p) UNION ALL SELECT row_id, 'n' || i, unnest({_tok('p."name"')}) FROM (SELECT row_id, p, row_number() OVER () AS i FROM p)),
terms AS MATERIALIZED (SELECT DISTINCT term FROM t), {stem_sql.stems("terms")},
x AS (SELECT DISTINCT row_id, f, unnest([term, english, german]) AS term FROM t JOIN stems USING (term)),
a AS MATERIALIZED (SELECT row_id, term FROM x UNION ALL SELECT row_id, lower(x) FROM (SELECT row_id, unnest(tags) AS x FROM store_docs) WHERE x IS NOT NULL),
b AS (SELECT * FROM a UNION ALL SELECT row_id, '' FROM store_docs WHERE row_id NOT IN (SELECT row_id FROM a)),
tf AS (SELECT row_id, term, count(*) AS tf FROM b GROUP BY 1, 2)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS most FROM tf GROUP BY 1""",
        "date_windows": f"SELECT * FROM (VALUES {_WINDOWS}) AS t(phrase, low, high)",
        "hits_json": """
WITH b AS (SELECT path, max(score) AS score, max(date) AS date, max(snippet) AS snippet FROM hits WHERE path IS NOT NULL AND score IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM b ORDER BY score DESC, path LIMIT 10)
SELECT '[' || string_agg('{"path":' || to_json(path) || ',"score":' || to_json(CAST(score AS VARCHAR)) || ',"date":' || to_json(coalesce(date, '')) || ',"snippet":' || to_json(coalesce(snippet, '')) || '}', ',' ORDER BY score DESC, path) || ']' AS json FROM t""",
        "embed_chunks": f"WITH {_CHUNKS} SELECT rel_path, chunk_idx, md5(chunk) AS digest FROM k WHERE chunk <> ''",
        "embed_missing": f"""
WITH {_CHUNKS}, m AS (SELECT DISTINCT model FROM chunk_vectors WHERE model IS NOT NULL)
SELECT rel_path, model, count(*) AS n, min(chunk_idx) AS first FROM k, m
WHERE chunk <> '' AND NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.rel_path = k.rel_path AND v.mtime_ns = k.mtime_ns AND v.chunk_idx = k.chunk_idx AND v.model = m.model) GROUP BY 1, 2""",
        "embed_store": f"WITH {_CHUNKS} SELECT rel_path, count(*) AS n, max(chunk_idx) AS last FROM k WHERE chunk <> '' GROUP BY 1",
        "bm25_temporal": _temporal_sql(PHRASE, *_LAST_YEAR),
        "bm25_temporal_fallback": _temporal_sql(NOWHERE, *_TODAY),
        "snippets": r"""
WITH s AS (SELECT row_id, body, coalesce(nullif(instr(lower(body), 'invoice'), 0), nullif(instr(lower(body), 'heizkostenabrechnung'), 0), nullif(instr(lower(body), 'protokoll'), 0), 0) AS pos FROM store_docs WHERE body IS NOT NULL),
w AS (SELECT *, greatest(pos - 60, 1) AS st FROM s)
SELECT row_id, CASE WHEN pos > 0 THEN (CASE WHEN st > 1 THEN '…' ELSE '' END) || trim(regexp_replace(substr(body, st, 240), '[\r\n]+', ' ', 'g'), ' ') || (CASE WHEN st + 239 < length(body) THEN '…' ELSE '' END)
 ELSE trim(regexp_replace(substr(body, 1, 240), '[\r\n]+', ' ', 'g'), ' ') END AS snippet FROM w""",
        "cosine_topk": f"""
WITH e AS (SELECT * FROM embeddings WHERE {_GOOD.format("embedding")}),
s AS (SELECT q.vec_id AS query, d.vec_id AS id, round({_COS.format("q.embedding", "d.embedding")}, 6) AS score FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
        "query_vec_pool": f"""
WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_GOOD.format("embedding")}),
u AS (SELECT unnest(range(64)) AS "at", unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS x FROM e),
m AS (SELECT "at", avg(x) AS x FROM u GROUP BY 1)
SELECT "at", round(x / sqrt((SELECT sum(x * x) FROM m)), 6) AS x FROM m""",
        "dense_file_max": f"SELECT rel_path, round(max({_COS.format('vec', _Q)}), 6) AS score FROM chunk_vectors WHERE rel_path IS NOT NULL AND {_GOOD.format('vec')} GROUP BY 1",
        "dense_temporal": f"""
WITH c AS (SELECT rel_path, vec_id, {_COS.format("vec", _Q)} AS score FROM chunk_vectors WHERE rel_path IS NOT NULL AND {_GOOD.format("vec")}),
f AS (SELECT rel_path, max(score) AS score FROM (SELECT * FROM c ORDER BY score DESC, vec_id, rel_path LIMIT 1200) GROUP BY 1),
d AS (SELECT rel_path, max({DAY_SQL}) AS day FROM store_docs GROUP BY 1)
SELECT rel_path, round(score, 6) AS score FROM f JOIN d USING (rel_path) WHERE day BETWEEN DATE '{low}' AND DATE '{high}' ORDER BY f.score DESC, rel_path LIMIT 20""",
        "hybrid_topk": _bm25_sql(*_ASKED) + _FUSED,
        "hybrid_stemmed": _stemmed_sql(*_ASKED) + _FUSED,
        "rrf_runs": f"""
WITH f AS (SELECT query_id, path, {fused}, min((list_no, rank)) AS first FROM ({runs}) WHERE path IS NOT NULL GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, path) AS rank, path, score, rrf FROM f""",
        "rrf_two_stage": f"""
WITH r AS ({runs}), m AS (SELECT r.*, max(list_no) OVER (PARTITION BY query_id) AS last FROM r),
f AS (SELECT query_id, path, {fused}, min((list_no, rank)) AS first FROM m WHERE list_no < last AND path IS NOT NULL GROUP BY 1, 2),
a AS (SELECT query_id, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, path) AS rank, path, score FROM f
 UNION ALL SELECT query_id, 1, rank, path, score FROM m WHERE list_no = last AND path IS NOT NULL),
g AS (SELECT query_id, path, {fused}, min((l, rank)) AS first FROM a GROUP BY 1, 2)
SELECT query_id, rank, path, score, rrf FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, path) AS rank, path, score, rrf FROM g) WHERE rank <= 10""",
        "chunk_windows": """
SELECT doc_id, i AS chunk_idx, md5(substr(text, CAST(i * 1800 + 1 AS BIGINT), 2000)) AS digest
FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 2000) / 1800.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)""",
        "chunk_prefix": f"""
WITH s AS (SELECT row_id, nullif(title, '') AS a, nullif(array_to_string(tags, ' '), '') AS b,
 nullif(array_to_string(flatten(list_transform({ent}, lambda e: [e.value, e.canonical])), ' '), '') AS c,
 nullif(array_to_string(flatten(list_transform(coalesce(participants, []), lambda p: [p.address, p."name"])), ' '), '') AS d FROM store_docs)
SELECT row_id, length(substr(concat_ws(chr(10), a, b, c, d), 1, 500)) AS n_chars, md5(substr(concat_ws(chr(10), a, b, c, d), 1, 500)) AS digest FROM s""",
        "doc_date_parse": f"SELECT row_id, CAST({DAY_SQL} AS VARCHAR) AS day FROM store_docs",
        "path_tokenize": f"SELECT doc_id, array_to_string({_path_sql('rel_path')}, '|') AS parts FROM documents",
        "path_scores": f"SELECT {_SCORE} AS \"match\", count(*) AS n FROM ({_LINES}) WHERE line <> '' GROUP BY 1",
        "locate_topk": f"""
WITH l AS (SELECT DISTINCT CASE WHEN len(string_split(rel_path, '/')) >= 3 THEN string_split(rel_path, '/')[3] ELSE rel_path END AS drive, line FROM ({_LINES}) WHERE line <> ''),
s AS (SELECT drive, line AS path, {_SCORE} AS score FROM l)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, drive, path LIMIT 20""",
        "skip_prefix": """
SELECT doc_id, starts_with(rel_path, 'inventory/') OR starts_with(rel_path, 'web/linkhub.example/') AS skipped,
 CASE WHEN len(string_split(rel_path, '/')) >= 3 THEN string_split(rel_path, '/')[3] ELSE rel_path END AS drive FROM documents""",
        "slugs": rf"""
SELECT row_id, CASE WHEN s = '' THEN 'note' ELSE s END AS slug
FROM (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(lower({_strip("coalesce(title, subject)")}), '[^\p{{L}}\p{{N}}_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM store_docs)""",
        "scanned_only": f"""
SELECT doc_id, count(*) AS n_pages, CAST(sum(coalesce(length({_strip("page")}), 0)) AS BIGINT) AS total_chars
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(12))) AS page FROM documents WHERE starts_with(source, 'pdf')) GROUP BY 1 HAVING sum(coalesce(length({_strip("page")}), 0)) < 400""",
    }
