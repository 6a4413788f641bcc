"""Cutting oversized texts at natural boundaries (pointer doubling).

Every place where a piece may end (after a line feed or a space) is a node of a
successor table: the piece that starts ``overlap`` before it is joined to its
farthest legal end by binary search in the sorted boundary positions, strongest
kind first.  The table is then squared again and again: after k squarings it
holds the 2^k-th successor, and the set of reached nodes doubles with it, so
that all greedy cuts of all texts of an Arrow batch come out in log2(pieces)
vector operations instead of one step per piece.  A text is one row, hence the
tables never have to be exchanged between tasks and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_FEED, SPACE = 10, 32
SENTENCE_ENDS = np.array([ord(c) for c in ".!?"], dtype=np.uint32)
#: Code points that are cut together; bounds a worker's memory, not the result.
BATCH_POINTS = 4_000_000


def boundary_kinds(points: np.ndarray) -> list[np.ndarray]:
    """Sorted end positions of each kind, strongest kind first."""
    feed, space = points == LINE_FEED, points == SPACE
    after_feed = np.flatnonzero(feed) + 1
    after_space = np.flatnonzero(space) + 1
    double = after_feed[(after_feed > 1) & feed[after_feed - 2]]
    sentence = after_space[(after_space > 1) & np.isin(points[after_space - 2], SENTENCE_ENDS)]
    return [double, after_feed, sentence, after_space]


def cut_points(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int, reach: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (text number, from, to) of texts that lie back to back in ``points``.

    ``starts`` and ``ends`` delimit the texts.  A piece ends in the last
    ``reach`` places before ``limit`` and the next starts ``overlap`` earlier.
    """
    kinds = boundary_kinds(points)

    def farthest(s: np.ndarray) -> np.ndarray:
        stop = ends[np.searchsorted(starts, s, "right") - 1]
        e = s + limit
        open_ = stop > e
        out = np.where(open_, e, stop)
        for kind in kinds:
            if not len(kind) or not open_.any():
                continue
            last = kind[np.searchsorted(kind, e, "right") - 1]
            hit = open_ & (last > e - reach) & (last <= e)
            out[hit] = last[hit]
            open_ &= ~hit
        return out

    every = either = np.union1d(kinds[1], kinds[3])
    step = limit - overlap

    def along(s: np.ndarray) -> np.ndarray:
        """The starts and all that hard cuts lead to from them before the next boundary or the text's end is in reach."""
        stop = ends[np.searchsorted(starts, s, "right") - 1]
        place = np.searchsorted(every, s + limit - reach, "right")
        free = np.minimum(stop, np.where(place < len(every), every[np.minimum(place, len(every) - 1)], stop)) if len(every) else stop
        cuts = np.maximum((free - 1 - limit - s) // step + 1, 0)
        count = cuts + 1
        return np.unique(np.repeat(s, count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)))

    first = starts[np.searchsorted(starts, either - 1, "right") - 1]
    either = either[either - first > limit - reach]
    nodes = np.union1d(starts, either - overlap)
    reach_to = farthest(nodes)
    # Hard cuts lead to starts that no boundary has; those of a stretch without boundaries are added at once, until none is new.
    while True:
        stop = ends[np.searchsorted(starts, nodes, "right") - 1]
        follow = reach_to[reach_to < stop] - overlap
        at = np.minimum(np.searchsorted(nodes, follow), len(nodes) - 1)
        missing = np.unique(follow[nodes[at] != follow])
        if not len(missing):
            break
        chain = []
        while len(missing):
            missing = along(missing)
            chain.append(missing)
            e = farthest(missing)
            inside = e < ends[np.searchsorted(starts, missing, "right") - 1]
            missing = np.setdiff1d(e[inside] - overlap, chain[-1])
            missing = missing[nodes[np.minimum(np.searchsorted(nodes, missing), len(nodes) - 1)] != missing]
        nodes = np.union1d(nodes, np.concatenate(chain))
        reach_to = farthest(nodes)
    last = reach_to >= ends[np.searchsorted(starts, nodes, "right") - 1]
    own = np.arange(len(nodes))
    successor = np.where(last, own, np.searchsorted(nodes, reach_to - overlap))
    reached = np.zeros(len(nodes), dtype=bool)
    reached[np.searchsorted(nodes, starts)] = True
    while True:
        reached[successor[reached]] = True
        squared = successor[successor]
        if np.array_equal(squared, successor):
            break
        successor = squared
    begin = nodes[reached]
    return np.searchsorted(starts, begin, "right") - 1, begin, reach_to[reached]


def _pieces(ids: list, texts: list[str], limit: int, reach: int, overlap: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc, begin, end = cut_points(points, starts, ends, limit, reach, overlap)
    opening = np.r_[True, doc[1:] != doc[:-1]]
    order = np.arange(len(doc))
    number = order - np.maximum.accumulate(np.where(opening, order, 0))
    return [ids[i] for i in doc.tolist()], number, begin - starts[doc], end - starts[doc]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 2000, reach: int = 500, overlap: int = 200) -> DataFrame:
    """Pieces of every text of more than ``limit`` characters.

    Returns ``key, chunk_idx INT, char_from BIGINT, char_to BIGINT`` (code
    points, ``char_to`` exclusive).  Null, empty and short texts give no row;
    repeated keys are cut each by itself; other columns of ``df``, whatever
    their names, are not read.  A text without any boundary is cut hard at the
    limit.  An empty table gives an empty result.
    """
    if not 0 <= overlap < limit - reach < limit:
        raise ValueError("need 0 <= overlap < limit - reach < limit")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            low = 0
            while low < len(sizes):
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), BATCH_POINTS, "right")))
                own, number, begin, end = _pieces(ids[low:high].to_pylist(), texts[low:high].to_pylist(), limit, reach, overlap)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, type=ids.type), pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                    names=["k", "chunk_idx", "char_from", "char_to"],
                )
                low = high

    long = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > limit)
    return long.mapInArrow(run, f"k {kind}, chunk_idx int, char_from bigint, char_to bigint").withColumnRenamed("k", key)


def embed_rows(df: DataFrame, path: str, text: str, limit: int = 2000, reach: int = 500, overlap: int = 200) -> DataFrame:
    """EmbedStore rows ``(path, chunk_idx, chunk)``: whole short texts, pieces of long ones.

    Null and empty texts give no row.
    """
    kind = df.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            low = 0
            while low < len(sizes):
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), BATCH_POINTS, "right")))
                bodies = texts[low:high].to_pylist()
                own, number, begin, end = _pieces(list(range(low, high)), bodies, limit, reach, overlap)
                chunks = [bodies[i - low][a:b] for i, a, b in zip(own, begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own, pa.int64())), pa.array(number, pa.int32()), pa.array(chunks, pa.string())], names=["p", "chunk_idx", "chunk"])
                low = high

    whole = df.select(F.col(path).alias("p"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    return whole.mapInArrow(run, f"p {kind}, chunk_idx int, chunk string").withColumnRenamed("p", path)
