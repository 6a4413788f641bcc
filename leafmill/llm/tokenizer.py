"""Encoding a whole corpus with a public byte-level BPE vocabulary.

The words of all rows are counted, pre-aggregated per task; the most frequent
are merged once on the driver and compiled into a transducer lexicon that all
workers map from the shared folder.  A second pass over the corpus looks words
up there and merges unseen ones exactly by rank, so the ids do not depend on the
lexicon.  Nothing but word counts is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import lexicon as lx
from leafmill.session import put_file, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that the lexicon holds at most; bounds the driver's part and the file.
LEXICON_WORDS = 60_000
#: None: the words of all rows are counted for it.  A number, where a caller sets one: of about so many rows.
SAMPLE_ROWS: int | None = None
#: Words that a task counts before it hands the counts on, and that a worker remembers.
TASK_WORDS = 200_000
#: Longer words stay out of the lexicon and are merged where they occur.
LEXICON_BYTES = 64


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank from a vocabulary file's content."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: lowest-ranked neighbouring pair first, leftmost on ties."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    stop = list(range(1, n + 1))  # part i spans i to stop[i]
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or stop[i] >= n or stop[stop[i]] != end:
            continue
        alive[stop[i]] = False
        stop[i] = end
        if end < n:
            left[end] = i
            if (rank := ranks.get(word[i : stop[end]])) is not None:
                heapq.heappush(heap, (rank, i, stop[end]))
        if (p := left[i]) >= 0 and (rank := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (rank, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : stop[i]]])
        i = stop[i]
    return out


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word STRING, n BIGINT`` over all whole texts; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(PATTERN).findall
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(find(value))
                if len(seen) > TASK_WORDS:
                    yield flush()
        yield flush()

    whole = df.select(F.col(text).alias("t")).where(F.length("t") > 0)
    return whole.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, text: str, ranks: dict[bytes, int], words: int = LEXICON_WORDS) -> bytes:
    """The lexicon file's content for the most frequent words of a corpus."""
    counted = df
    if SAMPLE_ROWS is not None and (share := SAMPLE_ROWS / max(1, df.count())) < 1:
        # By the place of a row, so that copies of a text come in proportion.
        placed = df.select(text).withColumn("__place", F.monotonically_increasing_id())
        counted = placed.where(F.pmod(F.xxhash64("__place"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = word_counts(counted, text).where((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES))
    # Written first: a collected limit would send each partition's most frequent words to the driver.
    top = written(counts.orderBy(F.desc("n"), "word").limit(words).select("word"), "lexicon-words").collect()
    return lx.build((word := row[0].encode(), merge(word, ranks)) for row in top)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> DataFrame:
    """``key, ids ARRAY<INT>`` of every row, without special tokens.

    Strings of special tokens are ordinary text.  Null and empty texts have the
    empty list; repeated keys have a row each; other columns are not read; an
    empty table gives an empty result.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    shared = spark.sparkContext.broadcast(content)  # one vocabulary file, under 1 MB
    path, seen = put_file(spark, f"lexicon-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}.bin", build_lexicon(df, text, read_ranks(content), words))
    if not seen:
        spark.sparkContext.addFile(path)
        path = path.rsplit("/", 1)[-1]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(PATTERN).findall
        lexicon = lx.Lexicon(path if seen else SparkFiles.get(path))
        ranks: dict[bytes, int] = {}
        known: dict[str, list[int]] = {}

        def learn(new: list[str]) -> None:
            encoded = [word.encode() for word in new]
            for word, raw, rank in zip(new, encoded, lexicon.find(encoded).tolist()):
                if rank >= 0:
                    known[word] = lexicon.outputs(rank)
                else:
                    if not ranks:
                        ranks.update(read_ranks(shared.value))
                    known[word] = merge(raw, ranks)

        for batch in batches:
            flat, sizes = array("i"), []
            split = [find(value) if value else [] for value in batch.column(1).to_pylist()]
            if len(known) > TASK_WORDS:
                known.clear()
            new = {word for parts in split for word in parts if word not in known}
            if new:
                learn(list(new))
            for parts in split:
                before = len(flat)
                for word in parts:
                    flat.extend(known[word])
                sizes.append(len(flat) - before)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
