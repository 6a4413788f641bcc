"""Stemming by the published Snowball algorithms for English (Porter2) and German.

Stems are made once per distinct word and joined back, so the Python code sees
the vocabulary only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words that the English algorithm leaves or maps as a whole.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEEP_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffixes of steps 2 and 3 with their replacements.
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int, vowels: str) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    i = start
    while i < len(word) and word[i] not in vowels:
        i += 1
    while i < len(word) and word[i] in vowels:
        i += 1
    return min(i + 1, len(word))


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _V and word[1] not in _V
    return len(word) > 2 and word[-3] not in _V and word[-2] in _V and word[-1] not in _V + "wxY"


def english(word: str) -> str:
    """The English stem of a lower-case word."""
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word[:1] == "y":
        word = "Y" + word[1:]
    chars = list(word)
    for i in range(1, len(chars)):
        if chars[i] == "y" and chars[i - 1] in _V:
            chars[i] = "Y"
    word = "".join(chars)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None) or _region(word, 0, _V)
    r2 = _region(word, r1, _V) if r1 < len(word) else len(word)

    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith(("us", "ss")):
        pass
    elif word.endswith("s") and any(c in _V for c in word[:-2]):
        word = word[:-1]
    if word in _KEEP_1A:
        return word

    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(end):
            head = word[: -len(end)]
            if end in ("eed", "eedly"):
                if len(head) >= r1:
                    word = head + "ee"
            elif any(c in _V for c in head):
                word = head
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(_DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_end(word):
                    word += "e"
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"

    for end in sorted(_STEP2, key=len, reverse=True):
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r1 and not (end == "ogi" and not head.endswith("l")) and not (end == "li" and head[-1:] not in tuple("cdeghkmnrt")):
                word = head + _STEP2[end]
            break
    for end in sorted(_STEP3, key=len, reverse=True):
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= (r2 if end == "ative" else r1):
                word = head + _STEP3[end]
            break
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r2 and (end != "ion" or head[-1:] in ("s", "t")):
                word = head
            break
    if word.endswith("e"):
        head = word[:-1]
        if len(head) >= r2 or (len(head) >= r1 and not _short_end(head)):
            word = head
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


_GV = "aeiouyäöü"


def german(word: str) -> str:
    """The German stem of a lower-case word."""
    word = word.replace("ß", "ss")
    chars = list(word)
    for i in range(1, len(chars) - 1):
        if chars[i] in "uy" and chars[i - 1] in _GV and chars[i + 1] in _GV:
            chars[i] = chars[i].upper()
    word = "".join(chars)
    r1 = max(3, _region(word, 0, _GV)) if len(word) > 3 else len(word)
    r2 = _region(word, _region(word, 0, _GV), _GV)

    for end in ("ern", "em", "er", "en", "es", "e", "s"):
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r1:
                if end == "s":
                    if head[-1:] and head[-1] in "bdfghklmnrt":
                        word = head
                else:
                    word = head
                    if end in ("en", "es", "e") and word.endswith("niss"):
                        word = word[:-1]
            break
    for end in ("est", "er", "en", "st"):
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r1 and (end != "st" or (len(head) > 3 and head[-1] in "bdfghklmnt")):
                word = head
            break
    for end in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"):
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r2:
                if end in ("end", "ung"):
                    word = head
                    if word.endswith("ig") and len(word) - 2 >= r2 and not word[:-2].endswith("e"):
                        word = word[:-2]
                elif end in ("ig", "ik", "isch"):
                    if not head.endswith("e"):
                        word = head
                elif end in ("lich", "heit"):
                    word = head
                    if word.endswith(("er", "en")) and len(word) - 2 >= r1:
                        word = word[:-2]
                else:
                    word = head
                    if word.endswith("lich") and len(word) - 4 >= r2:
                        word = word[:-4]
                    elif word.endswith("ig") and len(word) - 2 >= r2:
                        word = word[:-2]
            break
    return word.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


def variants(word: str) -> list[str]:
    """A word and its two stems, without repeats."""
    return list(dict.fromkeys((word, english(word), german(word))))


def stem_pairs(terms: DataFrame) -> DataFrame:
    """``term, english, german`` of distinct terms."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"term": part.term, "english": [english(t) for t in part.term], "german": [german(t) for t in part.term]})

    return terms.select("term").distinct().mapInPandas(run, "term string, english string, german string")


def stem_table(terms: DataFrame) -> DataFrame:
    """``term, stems`` of distinct terms: the term itself and its two stems, without repeats."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"term": part.term, "stems": [variants(t) for t in part.term]})

    return terms.select("term").distinct().mapInPandas(run, "term string, stems array<string>")


def stemmed(tokenized: DataFrame) -> DataFrame:
    """``doc, tokens`` with each word followed by its stems, distinct, in order; stems come from the vocabulary by join."""
    rows = tokenized.select("doc", F.posexplode("tokens").alias("place", "term"))
    joined = rows.join(stem_table(rows), "term")
    ordered = F.sort_array(F.collect_list(F.struct("place", "stems")))
    return joined.groupBy("doc").agg(F.array_distinct(F.flatten(ordered.getField("stems"))).alias("tokens"))
