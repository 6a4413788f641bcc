"""Keyword-stuffed and link-list pages (line shapes).

A page is cut into units (lines, then sentences) and each unit is reduced to a
shape: how many words it has, how many of them are function words, how they are
capitalised, what separates them, whether they link.  Units of one shape are
grouped.  A shape is spam-like if it is a bare link, a list of short phrases, or
a run of words that the page keeps repeating without making a sentence; paths,
logs, tables, code, chats and checklists have shapes of their own and are not.
A page is flagged when spam-like shapes hold more than half of its text and few
shapes hold nearly all of that.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a page's characters that spam-like shapes must exceed.
MOST = 0.5
#: So many shapes must hold at least DOMINANT of the spam-like characters.
FEW_SHAPES, DOMINANT = 6, 0.7
#: Short lines with a repeated word are a list of names from so many of one shape on.
LISTED = 5
#: A content word is repeated if it makes up this share of the page's content words, and occurs as often as REPEATS.
REPEATED, REPEATS = 0.02, 3
#: Where fewer than this share of a page's different content words occur less often than REPEATS, every other word is repeated, however many there are: in running text of any length most words are rare.
RARE = 0.2

# Frequent function words by language.
FUNCTION_WORDS_OF = {
    "en": """a about after all an any are as at be been before but by can could did do for from had has have he her his how i if in into is it its just me more my no not of on once one or our out she so some such
        than that the their them then there these they this those to under until up was we were what when which while who whose will with would yet you your""",
    "de": """aber als am an auf aus bei bin bis das dass dem den der des die dies diese doch du durch ein eine einem einen einer er es etwa für gibt hat haben hatte ich ihr im in ist ja kann kein man mein meine
        mich mir mit muss nach nicht noch nur ob oder sein seine sich sie sind so über um und uns unser unsere unter vom von vor war waren warum was weil wenn wer wie wir wird wo wurde wurden zu zum zur zwischen""",
    "fr": """au aux avec ce ces cette dans de des donc du elle en est et être il ils la le les leur lui mais ne nous on ou par pas plus puis pour qu que qui sa sans se ses son sont sous sur un une vous""",
    "es": """al como con cuando de del desde dos el ella en entre es esta este ha han hasta la las lo los luego más me muy no nos o para pero por que se sin sobre son su sus también un una unos y ya""",
}
FUNCTION_WORDS = frozenset(w for words in FUNCTION_WORDS_OF.values() for w in words.split())

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|\b[\w-]{1,80}(?:\.[\w-]{1,80}){1,8}/\S*", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NUMBER = re.compile(r"\d[\d.,'’:]*")
_SPLIT = re.compile(r"\r\n|[\n\r\f\v\x85\u2028\u2029]|<br\s*/?>|(?<=</a>)\s*|(?<=</li>)\s*|(?<=[.!?…])\s+(?=[^\W\d_]|[¿¡\"'«„])")
_SEPARATOR = re.compile(r"\s*[|,;•·>»#*~]+\s*|\s+[-–—/]+\s+|\s*::\s*|\s*->\s*|\t+")
_PATH = re.compile(r"^\s*(?:[A-Za-z]:\\|~?/|\.{1,2}/|[\w.-]+/)(?:[^\s/\\]+[/\\])*[^/\\]*$")
_LOG = re.compile(r"^\W*\d{1,4}[-:/.]\d{1,2}(?:[-:/.]\d{1,4})?\b.*\b(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|NOTICE|CRITICAL)\b|^\W*\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_CHAT = re.compile(r"^\s*(?:\[?\d{1,2}[:.]\d\d(?:[:.]\d\d)?\]?|\[?\d{1,4}[-./]\d{1,2}[-./]\d{1,4},? \d{1,2}:\d\d\]?)\s*[-–]?\s*[^:]{1,40}:|^\s*\*\*\w+\*\*:")
_CHECK = re.compile(r"^\s*(?:[-*+]|\d+[.)])?\s*(?:\[[ xX✓]?\]|[☐☑☒✓✔✗])\s")
_TABLE = re.compile(r"^\s*\|.*\|\s*$|^\s*[-|+:=\s]{5,}$|(?:\t[^\t]*){2,}|(?:;[^;]*){3,}")
_ASSIGNED = re.compile(r"^\s*[\w.\[\]]+\s*[:+\-]?=\s*\S|^```|\w\([^()]*\)\s*[;{]?\s*$")
_CODE = re.compile(r"[{}]\s*$|;\s*$|^\s*[\w.\[\]]+\s*[:+\-]?=\s*\S|^\s*(?:def|class|import|return|if|for|while|var|let|const|function|public|private)\b.*[({:;]|\w\(.*\)\s*$|^```")
_RUN = re.compile(r"\s\s+")
_BROKEN = re.compile(r"[,:;\d]")
_CLOSING = re.compile(r"[.!?…:]['\"»“)]*\s*$")


class Shape(NamedTuple):
    """What is left of a unit; units that differ only in their words have the same."""

    kind: str
    words: int
    capitals: int
    separators: str
    links: int


def _bucket(n: int) -> int:
    return n if n < 4 else 4 + min(3, (n - 4) // 6)


class Unit(NamedTuple):
    """A line or sentence with what its shape is made from."""

    text: str
    bare: str  # without markup and links
    words: list[str]  # lower case
    capitals: int
    function: int
    links: int


def read_unit(text: str) -> Unit:
    """A unit's words and links; blanks at its ends are left out."""
    text = text.strip()
    links = len(_URL.findall(text)) + text.count("href=") if "://" in text or "www." in text or "/" in text or "href=" in text else 0
    bare = _TAG.sub(" ", text) if "<" in text else text
    bare = _URL.sub(" ", bare) if links else bare
    bare = _RUN.sub(lambda m: "\t" if "\t" in m[0] else " ", bare)  # else separators are looked for at every blank of a long run
    found = _WORD.findall(bare)
    words = [w.lower() for w in found]
    return Unit(text, bare, words, sum(w[0].isupper() for w in found), len([w for w in words if w in FUNCTION_WORDS]), links)


def reduce_unit(unit: Unit | str, repeated: frozenset[str] | set[str], alone: bool = False) -> Shape:
    """The shape of one line or sentence; ``repeated`` holds the page's repeated words, which count as keywords ``alone`` in a line too."""
    unit = read_unit(unit) if isinstance(unit, str) else unit
    text, bare, words, upper, function, links = unit
    size = len(words)
    content = size - function
    again = len([w for w in words if w in repeated]) if repeated else 0
    capitals = round(3 * upper / size) if size else 0
    fluent = function >= 2 and function >= 0.15 * size and size >= 5
    if links:
        return Shape("described" if size >= 8 and fluent else "link", _bucket(size), 0, "", min(links, 2))
    if fluent and again < 0.6 * content:
        return Shape("sentence", _bucket(size), capitals, "", 0)
    marks = _SEPARATOR.findall(bare)
    common = Counter(m.strip()[:1] or "t" for m in marks)
    separators = common.most_common(1)[0][0] if common else ""
    parts = [p for p in (_WORD.findall(x) for x in _SEPARATOR.split(bare)) if p] if marks else [words]
    longest = max(map(len, parts), default=0)
    if _CHECK.match(text):
        kind = "check"
    elif _CHAT.match(text):
        kind = "chat"
    elif _LOG.match(text):
        kind = "log"
    elif _PATH.match(text):
        kind = "path"
    elif _TABLE.match(text) or len(_NUMBER.findall(bare)) > 1.5 * size:
        kind = "table"
    elif _ASSIGNED.search(text) or (_CODE.search(text) and again < 0.5 * content):
        kind = "code"
    elif not words:
        kind = "other"
    elif content and again >= (0.85 if _CLOSING.search(text) and _BROKEN.search(text) else 0.6) * content and size >= 2 - alone and not (fluent and again < 0.9 * content and function >= 0.3 * size):
        kind = "keywords"
    elif len(parts) >= 4 and longest <= 6 and not fluent and function < 0.25 * size:
        kind = "phrases"
    elif function or _CLOSING.search(text):
        kind = "sentence"
    else:
        kind = "names" if again and size >= 2 else "short"
    return Shape(kind, _bucket(size), capitals, separators, 0)


SPAM_KINDS = frozenset({"link", "keywords", "phrases", "names"})


def units(text: str) -> list[str]:
    """Lines, and the sentences of longer lines; blank ones left out."""
    return [u for u in _SPLIT.split(text) if u and not u.isspace()]


def page_shapes(text: str) -> dict[Shape, int]:
    """Characters per shape."""
    pieces = Counter(units(text))
    read = [(read_unit(piece), times) for piece, times in pieces.items()]
    counts: Counter = Counter()
    for unit, times in read:
        size = len(unit.words)
        own = [w for w in unit.words if w not in FUNCTION_WORDS] if unit.function else unit.words
        if times > 1 and not (size >= 5 and len(own) < 0.75 * size):
            for w in own:
                counts[w] += times
        else:
            # A sentence that a page repeats as a whole is no repetition of its words.
            counts.update(own)
    total = sum(counts.values())
    often = {w for w, n in counts.items() if n >= REPEATS}
    stuffed = len(counts) - len(often) < RARE * len(counts)
    repeated = often if stuffed else {w for w in often if counts[w] >= REPEATED * total}
    mass: dict[Shape, int] = defaultdict(int)
    seen: Counter = Counter()
    for unit, times in read:
        shape = reduce_unit(unit, repeated, stuffed)
        mass[shape] += len(unit.text.strip()) * times
        seen[shape] += times
    for shape in [s for s in mass if s.kind == "names" and seen[s] < LISTED]:
        mass[shape._replace(kind="short")] += mass.pop(shape)
    return mass


def spam_share(text: str) -> tuple[float, float]:
    """(share of the text in spam-like shapes, share of that in the few largest of them)."""
    mass = page_shapes(text)
    total = sum(mass.values())
    spam = sorted((n for shape, n in mass.items() if shape.kind in SPAM_KINDS), reverse=True)
    return (sum(spam) / total if total else 0.0), (sum(spam[:FEW_SHAPES]) / sum(spam) if spam else 0.0)


def spam_pages(df: DataFrame, key: str, text: str, most: float = MOST) -> DataFrame:
    """``key, share DOUBLE`` of every page of which more than ``most`` is keywords, bare links, names or tags.

    Null, empty and blank texts give no row; repeated rows count each by
    themselves; other columns are not read; whole texts are read, however long.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shares = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                share, few = spam_share(value)
                if share > most and few >= DOMINANT:
                    keep.append(i)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(shares, pa.float64())], names=["k", "share"])

    whole = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    return whole.mapInArrow(run, f"k {kind}, share double").withColumnRenamed("k", key)
