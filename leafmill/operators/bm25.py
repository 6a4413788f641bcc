"""BM25 over postings.

An index is three tables: postings (doc, term, tf, len), term statistics and one
row of corpus statistics.  Queries join only their own terms with the postings,
so a query reads the postings of its terms alone when they are stored by term.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import stem, temporal, text
from leafmill.session import exists, written

K1, B, EPSILON = 1.5, 0.75, 0.25
VERSION = 2
#: Buckets of terms that postings are stored in.
BUCKETS = 64
#: Query terms up to this many are pushed down to the stored postings.
PUSHED_TERMS = 1_000
#: Query terms up to this many are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000


def tokens_of(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``doc, tokens``; a document without tokens has one empty token, so that it counts in the statistics."""
    return docs.select(F.col(key).alias("doc"), F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))).alias("tokens"))


def postings_grouped(tokenized: DataFrame) -> DataFrame:
    """``doc, term, tf, len`` of ``doc, tokens``."""
    rows = tokenized.select("doc", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return rows.groupBy("doc", "term", "len").agg(F.count("*").cast("int").alias("tf")).select("doc", "term", "tf", "len")


def corpus_stats(tokenized: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return tokenized.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf``; negative idf replaced by a quarter of the mean idf over the vocabulary."""
    return term_stats_of(post.groupBy("term").agg(F.count("*").alias("df")), stats)


def term_stats_of(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The same from counts ``term, df``."""
    raw = df.crossJoin(F.broadcast(stats.select("n_docs"))).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    floored = raw.crossJoin(F.broadcast(mean))  # one row
    return floored.select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def stemmed_tokens(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``doc, tokens`` with each token followed by its stems; a document without tokens has one empty token."""
    tokenized = written(docs.select(F.col(key).alias("doc"), tokens.alias("tokens")), "tokens")
    stems = stem.stemmed(tokenized.where(F.size("tokens") > 0))
    return stems.unionByName(tokenized.where(~(F.coalesce(F.size("tokens"), F.lit(0)) > 0)).select("doc", F.array(F.lit("")).alias("tokens")))


def stemmed_fields(docs: DataFrame, key: str, lists: Column) -> DataFrame:
    """``doc, tokens`` of lists of tokens, one per field, the first of them (tags) taken whole: in each other field a token is followed by its stems, each once in the field.

    A document without tokens has one empty token.
    """
    rows = written(docs.select(F.col(key).alias("doc"), lists.alias("lists")), "token-lists")
    spread = rows.select("doc", F.posexplode("lists").alias("field", "list")).select("doc", "field", F.explode("list").alias("term"))
    stems = stem.stem_table(spread.where("field > 0"))
    varied = spread.where("field > 0").join(stems, "term").select("doc", "field", F.explode("stems").alias("term")).distinct()
    tokens = varied.unionByName(spread.where("field = 0")).groupBy("doc").agg(F.sort_array(F.collect_list("term")).alias("tokens"))
    empty = rows.where(F.size(F.flatten("lists")) == 0).select("doc", F.array(F.lit("")).alias("tokens"))
    return tokens.unionByName(empty)


def stemmed_query_terms(queries: DataFrame, key: str, query: str) -> DataFrame:
    """``query, term`` of query texts, each word with its stems; empty queries have none."""
    words = query_terms(queries, key, query)
    return words.join(stem.stem_table(words), "term").select("query", F.explode("stems").alias("term")).distinct()


def query_terms(queries: DataFrame, key: str, query: str) -> DataFrame:
    """``query, term`` of query texts; empty queries have none."""
    return queries.select(F.col(key).alias("query"), F.explode(text.tokenize(query)).alias("term"))


def score(post: DataFrame, terms: DataFrame, stats: DataFrame, term_table: DataFrame) -> DataFrame:
    """``query, doc, score`` of every document that shares a term with a query."""
    # Terms of queries are few; the size is checked, and beyond it the join shuffles.
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    known = terms.join(term_table.select("term", "idf"), "term")
    known = F.broadcast(known) if few else known
    tf, size = F.col("tf"), F.col("len")
    weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("avg_len")))
    hits = post.join(known, "term").crossJoin(F.broadcast(stats.select("avg_len")))
    return hits.groupBy("query", "doc").agg(F.sum(weight).alias("score"))


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The ``k`` best per query with their rank; ties by the smaller document key."""
    order = order or (F.desc("score"), F.asc("doc"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, key: str, body: str, queries: DataFrame, query_key: str, query: str, k: int = 10) -> DataFrame:
    """``query, rank, doc, score``: BM25 over one field; a query without known terms has no rows."""
    # Tokenised once and written, as a plan over the texts would tokenise for every use.
    tokenized = written(tokens_of(docs.select(key, text.tokenize(body).alias("tokens")), key, F.col("tokens")), "tokens")
    post = tokenized.select("doc", F.explode("tokens").alias("term"), F.lit(1).alias("tf"), F.size("tokens").alias("len"))
    stats = corpus_stats(tokenized)
    scored = score(post, query_terms(queries, query_key, query), stats, term_stats(post, stats))
    return top_k(scored.withColumn("score", F.round("score", 6)), k).select("query", "rank", "doc", "score")


def temporal_rank(docs: DataFrame, scored: DataFrame, window: tuple[date, date], k: int) -> DataFrame:
    """Ranking under a date phrase: documents in the window (all, if none is in it), matching ones first, then the latest, then the best.

    ``docs``: doc, day.  ``scored``: doc, score.  Documents that do not match
    stay with score 0.
    """
    dated = docs.withColumn("inside", temporal.in_window("day", window))
    any_inside = dated.agg(F.coalesce(F.max("inside"), F.lit(False)).alias("any_inside"))
    kept = dated.crossJoin(F.broadcast(any_inside)).where(F.col("inside") | ~F.col("any_inside"))
    joined = kept.join(scored.select("doc", "score"), "doc", "left").withColumn("has_match", F.col("score").isNotNull()).withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = joined.orderBy(F.desc("has_match"), F.desc_nulls_last("day"), F.desc("score"), F.asc("doc")).limit(k)
    order = Window.orderBy(F.desc("has_match"), F.desc_nulls_last("day"), F.desc("score"), F.asc("doc"))
    return best.withColumn("rank", F.row_number().over(order)).select("rank", "doc", "day", "score", "has_match")  # k rows


class Index:
    """A stored index: postings in buckets of terms and sorted by term within them, statistics, and a version that is checked on load.

    A search reads the buckets of its terms alone (partitions), and of those the
    row groups that may hold them (statistics of the sorted term).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def save(self, tokenized: DataFrame) -> None:
        """Write the index of ``doc, tokens``; the version comes last, so an index half written does not load."""
        post = postings_grouped(tokenized).withColumn("bucket", self._bucket(F.col("term")))
        # With more tasks than buckets a bucket spreads over several, by document, so a common term is no hot key.
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        placed = post.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(spread))).sortWithinPartitions("bucket", "term", "doc")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        corpus_stats(tokenized).write.mode("overwrite").parquet(f"{self.path}/stats")
        stored = self.spark.read.parquet(f"{self.path}/postings")
        terms = term_stats(stored, self.spark.read.parquet(f"{self.path}/stats"))
        # Sorted within each file, so its page index leads to a term.
        terms.repartition(self._bucket(F.col("term"))).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/terms")
        self.spark.createDataFrame([(VERSION, self.buckets)], "version int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version")

    def load(self) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """(postings, corpus statistics, term statistics), or None if missing or of another version: then build anew.

        An index that is there but cannot be read raises.
        """
        if not exists(self.spark, f"{self.path}/version/_SUCCESS"):
            return None
        version, buckets = self.spark.read.schema("version int, buckets int").parquet(f"{self.path}/version").first()
        if version != VERSION:
            return None
        self.buckets = buckets
        return tuple(self.spark.read.parquet(f"{self.path}/{name}") for name in ("postings", "stats", "terms"))

    def of_terms(self, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The same three tables, restricted to the terms (query, term) of queries where these are few enough to be pushed down."""
        loaded = self.load()
        if loaded is None:
            raise FileNotFoundError(f"no index of version {VERSION} at {self.path}; build it first")
        post, stats, known = loaded
        asked = terms.select("term", self._bucket(F.col("term")).alias("bucket")).distinct().limit(PUSHED_TERMS + 1).collect()  # PUSHED_TERMS at most
        if len(asked) <= PUSHED_TERMS:
            words = [r.term for r in asked]
            post = post.where(F.col("bucket").isin(sorted({r.bucket for r in asked})) & F.col("term").isin(words))
            known = known.where(F.col("term").isin(words))
        return post, stats, known

    def search(self, terms: DataFrame, k: int) -> DataFrame:
        """``query, rank, doc, score`` of ``query, term``; a query without known terms has no rows."""
        post, stats, known = self.of_terms(terms)
        scored = score(post, terms, stats, known)
        return top_k(scored.withColumn("score", F.round("score", 6)), k).select("query", "rank", "doc", "score")
