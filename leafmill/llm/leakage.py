"""Evaluation passages inside corpus texts (greedy string tiling).

Words are folded (case, accents, look-alike characters, hyphenated line ends).
Seeds are pairs of neighbouring words.  One pass over the corpus tests its pairs
against a bitmap of the items' pairs, keeps the documents that hold enough of
them, and counts in how many documents each word of the items occurs.  Seeds of
documents are joined by hash with those of the items that no pair can do without;
pairs of document and item whose seeds hold enough of a stretch of the item are
tiled: the longest matches of unmarked words are found with running Karp-Rabin
hashes and marked, again and again with shorter windows.  Neighbouring tiles in
order form a chain.

A text that only resembles an item has the item's common words and not its rare
ones, a reproduction has both.  So words weigh by how few documents and items
hold them, and a chain counts if it has most of the weight of the stretch of the
item around it.  This compares words of one stretch with each other: how many
items there are, or share a passage, does not matter.  What the chains cover of
the item, in whatever order, decides.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from leafmill.session import written

#: Words of an item that a document must reproduce (or all of a shorter item), and the share of them that may be lost to alterations at the edges.
LEAST_WORDS, LEAST_SHARE = 20, 0.8
#: Share of the weight of a chain and of EDGE words of the item on both sides of it that its tiles must hold, unless one tile is as long as a leak.
MAJORITY, EDGE = 0.58, 5
#: A word in a share q of documents and items weighs (-log q) ** STEEP.
STEEP = 1.5
#: Longest and shortest window of the tiling.
LONGEST, SHORTEST = 16, 2
#: Words that may lie between neighbouring tiles of a chain, on either side; if tiles of ADJOINING words adjoin in the item, any number may stand between them in the document.
GAP, ADJOINING = 4, 3
#: Different seeds of an item that a document must hold: one in four of the least words' seeds.
SEEDS = 4
#: Share of the weight of some stretch of LEAST_WORDS words that seeds must hold for a pair to be tiled. A chain that counts has MAJORITY, so some of its weight may be in words that are damaged or alone.
SEEDED = 0.5
#: Bits of the largest bitmap (32 MB), whatever the number of items; a fuller one only lets more pass to the exact join.
MOST_BITS = 28
SLOT_BITS = 28

# Characters that only mark others or take no room, as they stand in decomposed text.
_SILENT = "\u0300-\u036f\u200b-\u200d\u2060\ufeff"
_PART = rf"[^\W_]+(?:[{_SILENT}]+[^\W_]*)*"
_WORD = re.compile(rf"{_PART}(?:[-\u00ad\u2010]\s*{_PART})*")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|&(?:[a-zA-Z]\w{1,31}|#\w{1,8});", re.S)
_INNER = re.compile(r"[\s­‐-]+")
# Characters that scanning mixes up, each with the one that stands for both.
LOOK_ALIKE = {"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "ß": "ss", "8": "b"}
_FOLD = str.maketrans(LOOK_ALIKE)
_MARKS = dict.fromkeys([*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fold(word: str) -> str:
    """The form under which a word is compared."""
    if not word.isalnum():
        word = _INNER.sub("", word).translate(_MARKS)
    return word if word.isdigit() else word.translate(_FOLD).replace("rn", "m")


def number(word: str) -> int:
    """64 bits that stand for a folded word on every machine."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Memo(dict):
    """Values by written word; forgets all when it grows too large."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        self[word] = out = self.make(word)
        return out


_FOLDED = _Memo(fold)
_NUMBERED = _Memo(lambda word: number(fold(word)))


def _found(text: str) -> list[str]:
    """Written words of a text, lower case, in order, without markup."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return _WORD.findall(text.lower())


def words(text: str) -> list[str]:
    """Folded words of a text, in order, without markup."""
    return list(map(_FOLDED.__getitem__, _found(text)))


def seeds_of(codes: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbours among the words' numbers."""
    x = codes.view(np.uint64)
    mixed = (x[:-1] * np.uint64(31) + x[1:]) * _STEP
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def slots(hashes: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    """Places of hashes in a bitmap of ``2 ** bits`` bits."""
    return ((hashes.view(np.uint64) * _STEP) >> np.uint64(64 - bits)).astype(np.int64)


def _shorter(word: str) -> set[str]:
    """The word and what is left of it without one letter."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _near(a: str, b: str) -> bool:
    """At most one edit apart (two for words of eight letters), swaps of neighbours included."""
    most = 2 if min(len(a), len(b)) >= 8 else 1
    if abs(len(a) - len(b)) > most:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        before, row = row, now
    return row[-1] <= most


class Item:
    """One evaluation passage, prepared for matching."""

    def __init__(self, own: list[str], weights: list[float], others: frozenset[str] | set[str] = frozenset()) -> None:
        """``others``: words of other items, which are no damaged forms of this one's."""
        self.words, self.weights, self.others = own, weights, others
        self.numbers = {w: k for k, w in enumerate(dict.fromkeys(own))}
        self.sums = np.concatenate([[0.0], np.cumsum(weights)])
        self._short: dict[str, list[str]] | None = None

    def same_word(self, word: str) -> str | None:
        """The item's word that ``word`` is a damaged form of."""
        if len(word) < 4 or word.isdigit() or word in self.others:
            return None
        if self._short is None:
            self._short = defaultdict(list)
            for own in self.numbers:
                if len(own) >= 4 and not own.isdigit():
                    for form in _shorter(own):
                        self._short[form].append(own)
        for form in _shorter(word):
            for own in self._short.get(form, ()):
                if _near(own, word):
                    return own
        return None


def _windows(ids: list[int], marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of every unmarked window, by a running Karp-Rabin hash."""
    base, mod = 1_000_003, (1 << 61) - 1
    top = pow(base, size - 1, mod)
    value = run = 0
    for i, x in enumerate(ids):
        if marked[i] or x < 0:
            value = run = 0
            continue
        if run >= size:
            value = (value - ids[i - size] * top) % mod
        value = (value * base + x) % mod
        run += 1
        if run >= size:
            yield i - size + 1, value


def tile(a: list[int], b: list[int], longest: int = LONGEST, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id lists: (start in a, start in b, length), no position twice.

    Negative ids match nothing.
    """
    mark_a, mark_b = bytearray(len(a)), bytearray(len(b))
    tiles: list[tuple[int, int, int]] = []
    size = longest
    while size >= shortest:
        table = defaultdict(list)
        for start, value in _windows(a, mark_a, size):
            table[value].append(start)
        found = []
        if table:
            for j, value in _windows(b, mark_b, size):
                for i in table.get(value, ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] >= 0 and not mark_a[i + n] and not mark_b[j + n]:
                        n += 1
                    if n >= size:
                        found.append((-n, i, j))
        grown = -min(found)[0] if found else 0
        if grown > 2 * size:
            size = grown
            continue
        for n, i, j in sorted(found):
            n = -n
            if not any(mark_a[i : i + n]) and not any(mark_b[j : j + n]):
                mark_a[i : i + n] = mark_b[j : j + n] = b"\x01" * n
                tiles.append((i, j, n))
        size = size // 2 if size > 2 * shortest else size - 1
    return tiles


def chains(tiles: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Tiles joined with the latest chain that ends shortly before them in the item and in the document."""
    out: list[list[tuple[int, int, int]]] = []
    ends: dict[int, list[int]] = defaultdict(list)  # chains by the place in the item behind their last tile, oldest first
    for i, j, n in sorted(tiles, key=lambda t: t[1]):
        joined = -1
        for ahead in range(min(GAP, i) + 1):
            for k in reversed(ends[i - ahead]):
                _, pj, pn = out[k][-1]
                if not (ahead <= 1 and n >= ADJOINING) and j - pj - pn > GAP:
                    break
                joined = max(joined, k)
                break
        if joined < 0:
            joined = len(out)
            out.append([])
        else:
            pi, _, pn = out[joined][-1]
            ends[pi + pn].remove(joined)
        out[joined].append((i, j, n))
        ends[i + n].append(joined)
    return out


def covered(item: Item, doc: list[str]) -> int:
    """Words of the item that the document reproduces in chains that hold most of the weight around them."""
    memo: dict[str, int] = {}
    numbered = []
    for w in doc:
        k = memo.get(w)
        if k is None:
            k = item.numbers.get(w, -1)
            if k < 0 and (own := item.same_word(w)) is not None:
                k = item.numbers[own]
            memo[w] = k
        numbered.append(k)
    # Words that are not the item's, and words of it between two such, are in no tile; one place stands for all of a stretch.
    b, at = [], []
    for j, k in enumerate(numbered):
        if k >= 0 and ((j and numbered[j - 1] >= 0) or (j + 1 < len(numbered) and numbered[j + 1] >= 0)):
            b.append(k)
            at.append(j)
        elif b and b[-1] >= 0:
            b.append(-1)
            at.append(j)
    sums, last = item.sums, len(item.words)
    places: set[int] = set()
    tiles = [(i, at[j], n) for i, j, n in tile([item.numbers[w] for w in item.words], b)]
    for chain in chains(tiles):
        start, stop = chain[0][0], chain[-1][0] + chain[-1][2]
        held = sum(sums[i + n] - sums[i] for i, _, n in chain)
        whole = max(n for _, _, n in chain) >= LEAST_SHARE * LEAST_WORDS
        if whole or held >= MAJORITY * (sums[min(last, stop + EDGE)] - sums[max(0, start - EDGE)]):
            places.update(range(start, stop))
    if last == 1 and 0 in numbered:
        return 1
    return len(places)


def seeded_shares(seeds: np.ndarray, n_seeds: np.ndarray, weights: np.ndarray, n_weights: np.ndarray, hits: np.ndarray, n_hits: np.ndarray) -> np.ndarray:
    """For each pair the largest share of the weight of a stretch of LEAST_WORDS words of the item that the hits among its seeds hold.

    All arrays lie back to back, with their lengths by pair.
    """
    pairs = len(n_seeds)
    mixed = lambda values, lengths: (values.view(np.uint64) ^ (np.repeat(np.arange(pairs, dtype=np.uint64), lengths) * _STEP)).view(np.int64)
    at = np.flatnonzero(np.isin(mixed(seeds, n_seeds), mixed(hits, n_hits)))
    ends = np.cumsum(n_weights)
    starts = ends - n_weights
    pair = np.searchsorted(np.cumsum(n_seeds), at, "right")
    place = at - (np.cumsum(n_seeds) - n_seeds)[pair] + starts[pair]
    held = np.zeros(len(weights))
    held[place] = held[np.minimum(place + 1, ends[pair] - 1)] = 1.0
    a, b = (np.concatenate([[0.0], np.cumsum(x)]) for x in (held * weights, weights))
    size = np.repeat(np.minimum(LEAST_WORDS, n_weights), n_weights)
    begin = np.arange(len(weights))
    stop = np.minimum(begin + size, np.repeat(ends, n_weights))
    share = np.where(stop - begin == size, (a[stop] - a[begin]) / np.maximum(b[stop] - b[begin], 1e-300), 0.0)
    return np.maximum.reduceat(share, starts) if pairs else np.zeros(0)


def telling_seeds(seeds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The seeds of an item of which a pair that may be tiled shares at least one.

    The lightest seeds are left out, as many as hold less than SEEDED of every
    stretch of LEAST_WORDS words together: no pair is found by these alone, and
    common phrases that many documents and items share are among them.
    """
    distinct, place = np.unique(seeds, return_inverse=True)
    if len(distinct) < 2:
        return distinct
    following = np.minimum(np.arange(len(seeds)) + 1, len(weights) - 1)
    worth = np.zeros(len(distinct))
    np.maximum.at(worth, place, weights[: len(seeds)] + weights[following])
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(worth, kind="stable")] = np.arange(len(distinct))
    size = min(LEAST_WORDS, len(weights))
    total = np.cumsum(np.r_[0.0, weights])
    total = total[size:] - total[:-size]

    def enough(count: int) -> bool:
        """Whether the lightest ``count`` seeds alone hold enough of some stretch."""
        held = np.zeros(len(weights))
        at = np.flatnonzero(rank[place] < count)
        held[at] = held[following[at]] = 1.0
        some = np.cumsum(np.r_[0.0, held * weights])
        return bool(np.any(some[size:] - some[:-size] >= SEEDED * total))

    low, high = 0, len(distinct)  # the lightest ``low`` are too few; ``high`` may be enough
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return distinct[rank >= low]


def needed_seeds(n_words: Column, n_seeds: Column) -> Column:
    """Different seeds that a document must share with an item of so many words and different seeds."""
    return F.greatest(F.lit(1), F.least(F.lit(SEEDS), ((F.least(n_words, F.lit(LEAST_WORDS)) - 1) / 4).cast("int"), n_seeds))


def _bitmap(rows: DataFrame, number_: int) -> tuple[int, bytes]:
    """(bits, bitmap) of the column ``slot``; its size follows ``number_`` up to MOST_BITS and not beyond."""
    bits = min(MOST_BITS, max(15, (64 * number_).bit_length()))
    place = F.shiftright("slot", SLOT_BITS - bits)
    parts = rows.select((place + 1).alias("n")).groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("part")).collect()  # 4 KB each, 32 MB at most
    size = max(1, (1 << bits) >> 15)
    whole = bytearray(4096 * size)
    for bucket, part in parts:
        whole[(bucket - 1) * 4096 : bucket * 4096] = part
    return bits, bytes(whole)


def _read_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """``p, i, words, codes, seeds, slots, word_slots`` of every item with words; ``p`` numbers the rows."""
    kind, arrow = items.schema[key].dataType.simpleString(), to_arrow_type(items.schema[key].dataType)
    longs = pa.list_(pa.int64())
    schema = pa.schema([("i", arrow), ("words", pa.list_(pa.string())), ("codes", longs), ("seeds", longs), ("seed_slots", longs), ("word_slots", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(value)
                if own:
                    codes = np.array([number(w) for w in own], np.int64)
                    seeds = seeds_of(codes) if len(own) > 1 else codes
                    rows.append({"i": k, "words": own, "codes": codes, "seeds": seeds, "seed_slots": slots(seeds), "word_slots": slots(codes)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    whole = items.select(F.col(key).alias("i"), F.col(text).alias("t")).where(F.length("t") > 0)
    longs_ = "array<bigint>"
    read = whole.mapInArrow(run, f"i {kind}, words array<string>, codes {longs_}, seeds {longs_}, seed_slots {longs_}, word_slots {longs_}")
    return written(read.withColumn("p", F.monotonically_increasing_id()), "eval-items")


def _near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, others``: the words of the vocabulary that are near a word and yet words of their own."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, f) for w in batch.column(0).to_pylist() if len(w) >= 4 and not w.isdigit() for f in _shorter(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["word", "form"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if _near(a, b)]
            yield batch.take(pa.array(keep, pa.int64()))

    spread = vocabulary.select("word").mapInArrow(forms, "word string, form string")
    pairs = spread.join(spread.withColumnRenamed("word", "other"), "form").where("word <> other").select("word", "other").distinct()
    return pairs.mapInArrow(near, "word string, other string").groupBy("word").agg(F.collect_set("other").alias("others"))


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST_WORDS) -> DataFrame:
    """``key, item_key, n_covered INT`` of every document that reproduces an item, or ``least`` words of it.

    Null and empty texts on either side, and texts without words, give no row;
    repeated documents and items count each by themselves; other columns are not
    read; with an empty table the result is empty.  The corpus is read once,
    however many items there are; what a worker holds of them is bounded by the
    bitmaps' size.
    """
    spark = docs.sparkSession
    read = _read_items(items, item_key, item_text)
    n_words = F.size("words")
    per_item = read.select("p", "i", "words", "codes", "seeds", "seed_slots", "word_slots", needed_seeds(n_words, F.size(F.array_distinct("seeds"))).alias("need"))
    sizes = per_item.agg(F.count("*"), F.coalesce(F.sum(F.size("seeds")), F.lit(0)), F.coalesce(F.max(F.when(n_words == 1, 1)), F.lit(0))).first()
    kinds = [docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    if not sizes[0]:
        return spark.createDataFrame([], f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, n_covered int")
    seed_slot = per_item.select("need", F.explode("seed_slots").alias("slot"))
    shared = spark.sparkContext.broadcast({
        "seeds": _bitmap(seed_slot, sizes[1]),
        "short": _bitmap(seed_slot.where(F.col("need") < SEEDS), sizes[1]),
        "words": _bitmap(per_item.select(F.explode("word_slots").alias("slot")), sizes[1] + sizes[0]),
        "single": bool(sizes[2]),
    })  # fmt: skip  # three bitmaps of 32 MB at most

    key_type = to_arrow_type(docs.schema[key].dataType)
    schema = pa.schema([("k", key_type), ("uid", pa.int64()), ("t", pa.string()), ("seeds", pa.list_(pa.int64())), ("code", pa.int64()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents with seeds, and rows that count: documents by word, and all documents under no word."""
        maps = {}
        for name in ("seeds", "short", "words"):
            bits, raw = shared.value[name]
            maps[name] = bits, np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").view(bool) if bits <= 22 else np.frombuffer(raw, np.uint8)

        def inside(name: str, hashes: np.ndarray) -> np.ndarray:
            bits, flags = maps[name]
            at = slots(hashes, bits)
            return flags[at] if bits <= 22 else (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        counts: Counter = Counter()
        total = uid = 0
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total += len(texts)
            numbered = [np.array(list(map(_NUMBERED.__getitem__, _found(value))), np.int64) for value in texts]
            lengths = np.array([len(x) for x in numbered])
            if not lengths.sum():
                continue
            codes = np.concatenate(numbered)
            row = np.repeat(np.arange(len(texts)), lengths)
            # Documents by word of the items.
            known = np.flatnonzero(inside("words", codes))
            distinct, place = np.unique(codes[known], return_inverse=True)
            if len(distinct):
                each = np.unique(row[known] * len(distinct) + place) % len(distinct)
                for code, n in zip(distinct.tolist(), np.bincount(each, minlength=len(distinct)).tolist()):
                    counts[code] += n
            # Different seeds by document.
            pairs = seeds_of(codes) if len(codes) > 1 else codes[:0]
            at = np.flatnonzero((row[:-1] == row[1:]) & inside("seeds", pairs))
            hashes, rows = pairs[at], row[at]
            if shared.value["single"]:
                alone = known[inside("seeds", codes[known])]
                hashes, rows = np.concatenate([hashes, codes[alone]]), np.concatenate([rows, row[alone]])
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])] if len(rows) else np.zeros(0, bool)
            hashes, rows = hashes[new], rows[new]
            enough = np.bincount(rows, minlength=len(texts)) >= SEEDS
            enough |= np.bincount(rows[inside("short", hashes)], minlength=len(texts)) > 0
            chosen = np.flatnonzero(enough)
            begin, end = np.searchsorted(rows, chosen), np.searchsorted(rows, chosen, "right")
            none = [None] * len(chosen)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(chosen)), pa.array(range(base + uid, base + uid + len(chosen)), pa.int64()), batch.column(1).take(pa.array(chosen)).cast(pa.string()),
                    pa.array([hashes[a:b] for a, b in zip(begin, end)], pa.list_(pa.int64())), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
                ],
                schema=schema,
            )
            uid += len(chosen)
            if len(counts) > 500_000:
                yield counted(counts)
                counts.clear()
        counts[None] = total
        yield counted(counts)

    def counted(counts: Counter) -> pa.RecordBatch:
        none = [None] * len(counts)
        return pa.RecordBatch.from_arrays([pa.array(none, key_type), pa.array(none, pa.int64()), pa.array(none, pa.string()), pa.array(none, pa.list_(pa.int64())), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    whole = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    scanned = written(whole.mapInArrow(scan, f"k {kinds[0]}, uid bigint, t string, seeds array<bigint>, code bigint, n bigint"), "leak-candidates")

    # Weights of the items' words: documents and items that hold them.
    number_docs = scanned.where("uid IS NULL AND code IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    in_docs = scanned.where("code IS NOT NULL").select("code", "n")
    spread = per_item.select("p", F.posexplode(F.arrays_zip("words", "codes")).alias("at", "w")).select("p", "at", F.col("w.words").alias("word"), F.col("w.codes").alias("code"))
    spread = spread.withColumn("first", F.row_number().over(Window.partitionBy("p", "code").orderBy("at")) == 1)
    vocabulary = spread.groupBy("code").agg(F.min("word").alias("word"), F.count(F.when(F.col("first"), 1)).alias("own"))
    df = vocabulary.join(in_docs.groupBy("code").agg(F.sum("n").alias("n")), "code", "left").select("code", "word", (F.col("own") + F.coalesce("n", F.lit(0))).alias("df"))
    df = written(df, "eval-words")
    weight = F.pow(F.log((F.lit(number_docs + sizes[0]) + 1) / F.col("df")), F.lit(STEEP))
    weighted = spread.join(df.select("code", weight.alias("weight")).join(_near_words(df).join(df.select("word", "code"), "word").drop("word"), "code", "left"), "code")
    per_word = weighted.groupBy("p").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "weight"))), lambda s: s.weight).alias("weights"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("others", F.array().cast("array<string>"))))).alias("others"),
    )
    prepared = written(per_item.select("p", "i", "words", "seeds", "need").join(per_word, "p"), "eval-weighted")

    # Pairs that share a telling seed, and of these the ones whose seeds hold enough of a stretch.
    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [telling_seeds(seeds.values.to_numpy(), weights.values.to_numpy()) for seeds, weights in zip(batch.column(1), batch.column(2))]
            keys = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(own) if own else [], pa.int64())], names=["p", "seed"])

    candidates = scanned.where("uid IS NOT NULL")
    told = prepared.select("p", "seeds", "weights").mapInArrow(telling, "p bigint, seed bigint")
    pairs = candidates.select("uid", F.explode("seeds").alias("seed")).join(told, "seed").select("uid", "p").distinct()

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for column in (batch.column(3), batch.column(4), batch.column(2)):
                parts += [column.flatten().to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)]
            keep = np.flatnonzero(seeded_shares(*parts) >= SEEDED)
            yield batch.take(pa.array(keep, pa.int64())).select(["uid", "p"])

    both = pairs.join(candidates.select("uid", F.col("seeds").alias("hit")), "uid").join(prepared.select("p", "seeds", "weights", "need"), "p")
    shared_seeds = both.select("uid", "p", F.array_intersect("hit", "seeds").alias("hit"), "seeds", "weights", "need").where(F.size("hit") >= F.col("need"))
    chosen = shared_seeds.select("uid", "p", "hit", "seeds", "weights").mapInArrow(promising, "uid bigint, p bigint")

    item_type = to_arrow_type(items.schema[item_key].dataType)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Item] = {}
        for batch in batches:
            rows = []
            for k, value, p, i, own, weights, others in zip(*(c.to_pylist() for c in batch.columns)):
                item = ready.get(p)
                if item is None:
                    if len(ready) > 2_000:
                        ready.clear()
                    item = ready[p] = Item(own, weights, set(others))
                n = covered(item, words(value))
                if n >= LEAST_SHARE * min(least, len(own)):
                    rows.append({"k": k, "i": i, "n_covered": n})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("k", key_type), ("i", item_type), ("n_covered", pa.int32())]))

    full = chosen.join(candidates.select("uid", "k", "t"), "uid").join(prepared.select("p", "i", "words", "weights", "others"), "p").select("k", "t", "p", "i", "words", "weights", "others")
    found = full.mapInArrow(tiled, f"k {kinds[0]}, i {kinds[1]}, n_covered int")
    return found.select(F.col("k").alias(key), F.col("i").alias(item_key), "n_covered")
