"""The words that a mail's sender wrote for that mail (semi-Markov decoding).

A mail is a sequence of lines that falls into spans: authored text, quoted or
forwarded text, signature, disclaimer.  Equal neighbouring lines are one unit.
Every span is scored as a whole: by its lines' cues, by how it begins (a closing
formula, a delimiter, an introduction of a quotation), by its length, and by
what it holds in all, such as the share that the mail it answers contains.  The
best sequence of spans is found by dynamic programming over all span ends and
lengths.  The answered mail is joined by its message id, which the reply id or
else the references name; much-answered mails are salted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import tokenize
from leafmill.session import written

AUTHORED, QUOTED, SIGNATURE, DISCLAIMER = range(4)
#: Length in units up to which a span of each kind is scored as a whole; a longer one goes on unit by unit (a geometric tail), so none has a longest length.
WHOLE = (30, 30, 12, 8)
#: A mail is much-answered from 1/HOT_PARTS of all answers on; its rows are spread over SALTS partitions.
HOT_PARTS, SALTS = 64, 32

# Closing formulas.
CLOSINGS = """
mit freundlichen grüßen|mit freundlichem gruß|mit besten grüßen|mit herzlichen grüßen|mit lieben grüßen|freundliche grüße|beste grüße|viele grüße|liebe grüße|herzliche grüße|schöne grüße|
schöne grüße aus der \\w+|gruß|grüße|grüessli|lg|mfg|vg|bg|hg|herzlich|herzlichst|bis bald|bis dann|bis später|ciao|tschüss|hochachtungsvoll|danke und gruß|vielen dank|besten dank|
kind regards|best regards|warm regards|regards|best wishes|best|br|kr|cheers|warmly|sincerely|yours|yours sincerely|yours faithfully|yours truly|many thanks|thanks|thank you|thanks and bye|take care|all the best|see you|see you soon|bye|
cordialement|bien cordialement|bien à vous|bien à toi|à bientôt|meilleures salutations|sincères salutations|amitiés|amicalement|bonne journée|merci|salutations|salutations distinguées|
atentamente|cordialmente|un saludo|un cordial saludo|saludos|saludos cordiales|un abrazo|abrazos|hasta pronto|gracias
""".replace("\n", "").replace("ß", "ss")
# The longest formula is tried first.
_FORMULAS = "|".join(sorted(CLOSINGS.split("|"), key=len, reverse=True))

_QUOTE = re.compile(r"^\s*(?:>|&gt;|\|(?!.*\|\s*$)|['\"(]?[A-Za-zÄÖÜäöüÉé.]{1,3}>)")
_DEPTH = re.compile(r"^(?:\s*(?:>|&gt;|\||['\"(]?[A-Za-zÄÖÜäöüÉé.]{1,3}>))+\s*")
_DATE = r"(?:\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2}\.? \w{3,10}\.? \d{4}|\w{3,10}\.? \d{1,2},? \d{4})"
_SAID = r"(?:schrieb|wrote|a écrit|escribió|ha scritto|skrev|said)"
_SAYS = re.compile(rf"\b{_SAID}\b", re.I)
_SAYS_LAST = re.compile(rf"\b{_SAID}\s*(?:am|on|le|el)?$", re.I)
_SAYS_WHO = re.compile(r"(?:Zitat von|Quoting|Citation de|Citando a)\b.", re.I)
_WHEN = re.compile(_DATE)
_OPENS = re.compile(r"(?:Am|On|At|Le|El|Il|Zitat von|Quoting|Citation de|Citando a)\b...", re.I)
_WHO = re.compile(r"(?:[A-ZÄÖÜ][\w'.-]*,? ?){1,4}(?:<\S+@\S+>)?\s*$", re.I)
_MARKER = re.compile(
    r"^\W*(?:Original message|Original-?nachricht|Ursprüngliche Nachricht|Weitergeleitete Nachricht|Forwarded message|Begin forwarded message|Anfang der weitergeleiteten Nachricht|Message d['’]origine|Message original|Message transféré|"
    r"Début du message (?:transféré|réexpédié)|Mensaje original|Mensaje reenviado|Inicio del mensaje reenviado|Messaggio originale)\W*$",
    re.I,
)
_HEADER = re.compile(r"^\s*[*_]{0,2}(?:Von|From|De|Gesendet|Sent|Envoyé|Enviado|An|To|À|A|Para|Kopie|Cc|Bcc|Betreff|Subject|Objet|Asunto|Datum|Date|Fecha|Antwort an|Reply-To)\s?:[*_]{0,2}\s*\S", re.I)
_FROM = re.compile(r"^\s*[*_]{0,2}(?:Von|From|De)\s?:[*_]{0,2}\s.*\S@\S", re.I)
_RULE = re.compile(r"^\s*(?:_{10,}|-{10,})\s*$")
_CLOSING = re.compile(rf"^\W*(?:{_FORMULAS})\s*[,.!;–-]*\s*(?P<rest>.{{0,60}})$", re.I)
_DELIMITER = re.compile(r"^\s*(?:--|—|–|_{2,}|={3,}|-{3,}|\*( ?\*){2,}|~{3,}|#{3,}|\+{3,})\s*$")
_CONTACT = re.compile(
    r"^\W*(?:Tel|Telefon|Phone|Mobil|Mobile|Fax|Cell|Tél|Teléfono|T|M|P|F)?\s*[.:]?\s*\+?\(?\d[\d ()/.-]{6,}$|^\s*☎|^\s*(?:https?://|www\.)\S+\s*$|^\s*(?:E-?Mail:?\s*)?<?[\w.+-]+@[\w.-]+>?\s*$|"
    r"^\s*[\w.\- ]{2,40}(?:weg|gasse|strasse|straße|platz|allee|ring|str\.)\s+\d+\w?\s*$|^\s*[\w.\- ]{2,40} (?:Lane|Road|Street|Avenue|Square|Drive|Way)\s+\d+\w?\s*$|^\s*(?:rue|avenue|place|calle|plaza|avenida)\s[\w.\- ]{2,40}\s+\d+\s*$|^\s*\d+,? (?:rue|avenue|place)\s[\w.\- ]{2,40}$",
    re.I,
)
_DEVICE = re.compile(
    r"^\W*(?:Von mein\w+ .{1,40} gesendet|Gesendet (?:mit|von|aus) .{1,40}|Diese Nachricht wurde von mein\w+ .{1,40} gesendet|Sent (?:from|with|via) (?:my|a|the)? ?[^,;]{1,40}|Get \S+ for .{1,20}|Envoyé (?:de|avec|depuis) (?:mon )?.{1,40}|"
    r"Enviado (?:desde|con) (?:mi )?.{1,40}|Unterwegs geschrieben\b.{0,40}|typed on (?:a|my) .{1,40}|Written on the (?:go|road)\b.{0,40}|Écrit en chemin\b.{0,50}|Escrito (?:de camino|en ruta|desde)\b.{0,50})[^.\w]*$",
    re.I,
)
_DISCLAIMER = re.compile(
    r"\bvertraulich|nur für die (?:genannten )?(?:Empfänger|Adressaten)|richtet sich allein an|\buntersagt\b|irrtümlich erhalten|haftet nicht für|Zum Abmelden|Sie erhalten diese|Sitz der Gesellschaft|Bitte denken Sie an|absendende Person|bevor Sie diese .{0,20}drucken|Handelsregister|"
    r"intended (?:only )?for|named recipient|reached you in error|accepts no liability|needs written consent|is not permitted|leave the list|joined a list|do not bind|before you print|Views in this|protected information|(?:sensitive|protected|privileged|confidential) notice|\bconfidential(?:ity)?\b|unsubscribe|erase all copies|"
    r"est (?:confidentiel|protégé|légalement)|réservé au|merci de le détruire|prévenir l['’]expéditeur|décline toute responsabilité|avant d['’]imprimer|se désabonner|vous recevez ce|siège social|"
    r"es (?:confidencial|legal|privado)|va dirigido solo|lo recibió por error|avise al remitente|le rogamos que lo borre|no responde de|antes de imprimir|darse de baja|recibe este|domicilio social",
    re.I,
)
_POSTSCRIPT = re.compile(r"^\W*(?:P\.?\s?-?[SD]\.?|N\.?B\.?|Nachtrag|Postscriptum|Posdata)\s*[:.\-–]", re.I)
_SENTENCE = re.compile(r"[.!?…]['\"»“)]*\s*$")
_WORDS = re.compile(r"\w+")
_WRITTEN_OUT = re.compile(r"(?<=[aou])e")
_OTHER = re.compile(r"[\W_]+")
# Parts of the disclaimers' words; a line without any of them is not searched.
_STEMS = tuple(
    "vertraul|richtet sich allein|empfänger|adressat|untersagt|irrtüm|haftet|abmelden|sie erhalten|sitz der|denken sie|absendende|drucken|handelsreg|intended|recipient|reached you|liabil|consent|permitted|leave the list|joined a list|do not bind|"
    "before you|views in|protected|privileg|sensitive|confiden|unsubscribe|erase all|protégé|légalement|réservé|merci de|prévenir|décline|imprim|désabonner|recevez|siège|privado|es legal|va dirigido|recibió|avise|rogamos|"
    "no responde|darse de|recibe este|domicilio".split("|")
)


#: What a single unit of text that is no sentence costs between other spans.
LONE = 0.5


class Line(NamedTuple):
    """What decoding needs to know of a line."""

    quoted: bool  # quotation mark at the start
    intro: bool  # introduces a quotation, or is part of such a line, a header or a marker
    open: bool  # stands after an introduction that no marked quotation follows
    match: int  # 0 unknown, 1 not in the answered mail, 2 partly, 3 wholly, 4 as a line of its own, 5 as a short line beside such
    closing: bool
    name: bool
    delimiter: bool
    contact: bool
    device: bool
    legal: bool
    postscript: bool
    sentence: bool
    short: bool
    tail: bool  # the moved end of a quoted line
    first: bool  # begins a paragraph


def _plain(text: str) -> str:
    text = text.lower()
    return _OTHER.sub("", text if text.isascii() else unicodedata.normalize("NFKD", text))


def _name(text: str) -> str:
    """The same with umlauts that are written out read as such."""
    return _WRITTEN_OUT.sub("", _plain(text))


def _introduces(text: str) -> bool:
    """Whether a line, however long, introduces a quotation: it names who said what follows, and when or from which address."""
    text = text.rstrip()
    if not text.endswith(":"):
        return False
    return bool(_SAYS_WHO.match(text)) or (bool(_SAYS.search(text)) and ("@" in text or bool(_WHEN.search(text))))


def _opens(text: str) -> bool:
    """Whether a line can be the first of an introduction that was broken into several."""
    if _OPENS.match(text) or (len(text) < 120 and _WHO.match(text)):
        return True
    said = _SAYS.search(text, 3)
    if said and (_WHEN.search(text, said.end()) or _SAYS_LAST.search(text[-60:])):
        return True
    address = text.rfind("<")
    return address >= 3 and "@" in text[address:] and not re.search(r"\s", text[address:])


def _grams(text: str) -> set[tuple[str, ...]]:
    found = _WORDS.findall(text.lower())
    return {tuple(found[i : i + 3]) for i in range(len(found) - 2)}


def _unquoted(text: str) -> str:
    return "\n".join(_DEPTH.sub("", line) for line in text.split("\n"))


def describe(lines: list[str], sender: list[str], parent: str | None) -> list[Line | None]:
    """The cues of each line; None for blank ones."""
    n = len(lines)
    text = [line.strip("\r\n\t ﻿ ") for line in lines]
    bare = [_DEPTH.sub("", t) if _QUOTE.match(t) else t for t in text]
    blank = [not b or not b.strip("|> ") for b in bare]
    quoted = [bool(_QUOTE.match(t)) for t in text]
    intro = [False] * n
    live = [i for i in range(n) if not blank[i]]
    for at, i in enumerate(live):
        if quoted[i]:
            continue
        ends = text[i].endswith(":")
        if (len(text[i]) < 60 and _MARKER.match(text[i])) or (ends and _introduces(text[i])):
            intro[i] = True
            continue
        # An introduction that was broken into several lines.
        for more in (1, 2, 3):
            if at + more < len(live) and live[at + more] == i + more and not any(quoted[i : i + more + 1]):
                joined = " ".join(text[i : i + more + 1])
                if joined.endswith(":") and _introduces(joined) and _opens(text[i]) and not (_SENTENCE.search(text[i]) and len(text[i].split()) > 12):
                    intro[i : i + more + 1] = [True] * (more + 1)
    header = [not quoted[i] and not blank[i] and ":" in text[i][:20] and bool(_HEADER.match(text[i])) for i in range(n)]
    i = 0
    while i < n:
        if header[i]:
            j = i
            while j < n and (header[j] or (j > i and not blank[j] and not quoted[j] and j + 1 < n and header[j + 1] and len(text[j]) < 80)):
                j += 1
            if sum(header[i:j]) >= 2 or _FROM.match(text[i]):
                intro[i:j] = [True] * (j - i)
            i = j
        else:
            i += 1
    for i in range(n - 1):
        if _RULE.match(text[i]) and not quoted[i]:
            nearest = next((k for k in range(i + 1, n) if not blank[k]), None)
            if nearest is not None and intro[nearest]:
                intro[i] = True
    open_ = [False] * n
    state = False
    for at, i in enumerate(live):
        if intro[i]:
            after = next((k for k in live[at + 1 :] if not intro[k]), None)
            state = after is not None and not quoted[after]
        elif quoted[i]:
            state = False
        else:
            open_[i] = state

    known = None
    if parent:
        clean = _unquoted(parent)
        known = _grams(clean), {_plain(x) for x in clean.split("\n")}
    names = [_name(w) for s in sender for w in re.split(r"[\s,;.@_-]+", s.split("@")[0]) if len(w) > 1]
    solid = [_name(s.split("@")[0]) for s in sender]
    out: list[Line | None] = []
    for i in range(n):
        if blank[i]:
            out.append(None)
            continue
        t = text[i]
        first = i == 0 or blank[i - 1]
        if quoted[i]:
            out.append(Line(True, False, False, 0, False, False, False, False, False, False, False, False, False, False, first))
            continue
        words = _WORDS.findall(t)
        match = 0
        if known is not None:
            own = _grams(t)
            if len(words) >= 4:
                share = len(own & known[0]) / len(own)
                match = 4 if _plain(t) in known[1] else 3 if share >= 0.75 else 2 if share >= 0.34 else 1
            else:
                match = 3 if _plain(t) in known[1] and _plain(t) else 1
        tail = False
        above_moved = i > 0 and out[-1] is not None and out[-1].tail
        if i and not blank[i - 1] and not intro[i] and (quoted[i - 1] or above_moved):
            above = bare[i - 1]
            ended = bool(_SENTENCE.search(above))
            if known is not None:
                ahead = _WORDS.findall(above.lower())[-2:] + [w.lower() for w in words[:2]]
                cross = {tuple(ahead[k : k + 3]) for k in range(len(ahead) - 2)}
                tail = bool(cross) and cross <= known[0]
            if not tail and not ended and not (match == 1 and len(words) >= 4):
                tail = t[:1].islower() or (len(words) <= 6 and len(above) > 40) or (above_moved and i + 1 < n and quoted[i + 1])
        short, low = len(words) <= 5 and len(t) <= 50, t.lower()
        closing = False
        if len(t) <= 70 and (found := _CLOSING.match(t.replace("ß", "ss"))):
            rest = _name(found["rest"])
            closing = not rest or any(rest.startswith(x) or x.startswith(rest) for x in names + solid if len(x) > 2) or (len(_WORDS.findall(found["rest"])) <= 2 and found["rest"][:1].isupper() and t[len(t) - len(found["rest"]) - 2 :][:1] in ",.; ")
        name = False
        if len(words) <= 5 and len(t) <= 60:
            parts = [_name(w) for w in words]
            parts = [p for p in parts if p]
            begins = {x[:1] for x in names}
            name = bool(parts) and (any(len(p) > 2 for p in parts) or (len(t) <= 2 and set(parts) <= begins)) and all(len(p) == 1 or p in names or any(p in s for s in solid if len(p) > 2) for p in parts) and not t.endswith((",", ":"))
        out.append(
            Line(
                False, intro[i], open_[i], match, closing, name, bool(_DELIMITER.match(t)), len(t) <= 70 and bool(_CONTACT.match(t)), len(t) <= 80 and bool(_DEVICE.match(t)), any(x in low for x in _STEMS) and bool(_DISCLAIMER.search(t)),
                bool(_POSTSCRIPT.match(t)), bool(_SENTENCE.search(t)) or len(words) >= 9, short, tail, first,
            )
        )
    # A short line that the answered mail has too, such as a greeting, says something only next to longer ones.
    plain = [i for i in live if not quoted[i] and not intro[i]]
    for at, i in enumerate(plain):
        line = out[i]
        if line.match < 3 or len(_WORDS.findall(text[i])) > 6:
            continue
        long = [j for j in (plain[at + 1 : at + 2] + (plain[at - 1 : at] if at and (plain[at - 1] == i - 1 or at + 1 == len(plain)) else [])) if out[j].match >= 3 and len(_WORDS.findall(text[j])) > 3]
        out[i] = line._replace(match=5 if long else 2)
    # A line without a sentence right above contact data is a role or a firm, one that the next lines repeat with more is a
    # name, and so is one in capitals at the very end.
    for at in range(len(live) - 1, -1, -1):
        i, line = live[at], out[live[at]]
        if not line.short or line.sentence or line.closing or line.name or line.quoted or line.intro or text[i].endswith((",", ":")):
            continue
        below = out[i + 1] if i + 1 < n else None
        words = set(_WORDS.findall(text[i].lower()))
        more = any(words < set(_WORDS.findall(text[j].lower())) and out[j].short and not out[j].quoted for j in live[at + 1 : at + 3]) if 0 < len(words) <= 3 else False
        last = i == live[-1] and at and line.first and all(w[:1].isupper() for w in text[i].split()) and len(words) <= 3
        if (below is not None and (below.contact or below.device or (below.name and not below.closing))) or (more and at) or last:
            out[i] = line._replace(name=True)
    # So is a line that closely stands between two lines of a signature.
    for i, line in enumerate(out):
        above, below = (out[i - 1] if i else None), (out[i + 1] if i + 1 < n else None)
        if line is None or above is None or below is None or line.quoted or line.intro or line.closing or line.legal or len(text[i]) > 60:
            continue
        if (above.name or above.delimiter or above.contact) and (below.contact or below.device) and not line.postscript:
            out[i] = line._replace(name=True)
    return out


def _emit(line: Line) -> tuple[float, float, float, float]:
    """Scores of a line as part of each kind of span."""
    if line.quoted:
        return -8.0, 6.0, -8.0, -8.0
    if line.intro:
        return -6.0, 7.0, -6.0, -6.0
    authored, quote, signature, legal = 0.0, -2.5, -3.5, -4.5
    if line.tail:
        quote += 7.0
    if line.open:
        quote += 5.0 if line.match != 1 else 3.2
    if line.match == 5:
        quote += 3.5
    elif line.match == 4:
        quote += 6.0
    elif line.match == 3:
        quote += 4.0
    elif line.match == 2:
        quote += 1.5 if not line.short else 0.0
    elif line.match == 1 and not line.open:
        quote -= 2.0
    if line.closing:
        signature += 9.0
    if line.name:
        signature += 6.0
    if line.delimiter:
        signature += 7.0
        legal += 3.0
    if line.contact:
        signature += 9.0
    if line.device:
        signature += 10.0
    if line.short and not line.sentence:
        signature += 4.2
    if line.sentence and not (line.device or line.name or line.closing or line.contact):
        signature -= 3.0
    if line.legal:
        legal += 11.0
    elif not line.first:
        legal += 4.7
    if line.postscript and line.match < 4:
        authored += 9.0
    return authored, quote, signature, legal


def decode(lines: list[Line | None]) -> list[int]:
    """The kind of span of each line that is not blank, by the best segmentation."""
    units: list[list[int]] = []
    before = None
    for i, line in enumerate(lines):
        if line is None:
            before = None if before is None else before
            continue
        same = before is not None and line._replace(first=False) == before._replace(first=False) and not (line.legal or line.closing or line.name or line.delimiter or line.first)
        if same:
            units[-1].append(i)
        else:
            units.append([i])
        before = line
    n = len(units)
    heads = [lines[u[0]] for u in units]
    sums = [[0.0] * (n + 1) for _ in range(4)]
    for i, (u, line) in enumerate(zip(units, heads)):
        for k, x in enumerate(_emit(line)):
            sums[k][i + 1] = sums[k][i] + x * len(u)
    marked = [0] * (n + 1)  # units that hold a cue of a quotation
    strong = [0] * (n + 1)  # the same, without what only the answered mail tells
    told = [0] * (n + 1)  # lines that the answered mail has
    signed = [0] * (n + 1)
    warned = [0] * (n + 1)
    for i, h in enumerate(heads):
        marked[i + 1] = marked[i] + (h.quoted or h.intro or h.tail or h.match >= 3)
        strong[i + 1] = strong[i] + (h.quoted or h.intro or h.tail or h.open)
        told[i + 1] = told[i] + (len(units[i]) if h.match >= 3 else 0)
        signed[i + 1] = signed[i] + (h.closing or h.name or h.delimiter or h.contact or h.device)
        warned[i + 1] = warned[i] + h.legal
    best = [[0.0] * 4] + [[-1e9] * 4 for _ in range(n)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * 4 for _ in range(n + 1)]
    # The same for spans of the whole length or longer, which may go on.
    grown = [[-1e9] * 4 for _ in range(n + 1)]
    grown_back: list[list[int]] = [[0] * 4 for _ in range(n + 1)]
    for j in range(1, n + 1):
        for k in range(4):
            for size in range(1, min(WHOLE[k], j) + 1):
                i = j - size
                h = heads[i]
                score = sums[k][j] - sums[k][i]
                if k == AUTHORED:
                    # Text seldom is a single unit between other spans.
                    score -= 0.0 if size > 1 or i == 0 or j == n or h.sentence or h.match == 1 or h.postscript else LONE
                elif k == QUOTED:
                    score += 0.0 if h.quoted or h.intro or h.tail else -1.5
                    if marked[j] == marked[i]:
                        score -= 2.0
                    elif strong[j] == strong[i] and told[j] - told[i] < 2:
                        # One line in common may be chance.
                        score -= 1.5
                elif k == SIGNATURE:
                    # How it begins, and how long signatures are.
                    score += 1.0 if h.closing or h.delimiter else 0.0 if h.name or h.contact or h.device else -4.0
                    score -= 0.3 * max(0, size - 8)
                    if signed[j] == signed[i]:
                        score -= 6.0
                elif k == DISCLAIMER:
                    score += 0.5 if h.first and h.legal else 0.0 if h.legal else -3.0
                    if warned[j] == warned[i]:
                        score -= 6.0
                # Text goes on after a signature only behind a cue of its own.
                start = best[i]
                for p in range(4):
                    if i == 0 and p or p == k and i and k != QUOTED:
                        continue
                    total = start[p] + score
                    if k == AUTHORED and p in (SIGNATURE, DISCLAIMER) and i and not h.postscript:
                        total -= 3.0
                    if total > best[j][k]:
                        best[j][k] = total
                        back[j][k] = (i, p)
                    if size == WHOLE[k] and total > grown[j][k]:
                        grown[j][k] = total
                        grown_back[j][k] = p
            # A span of the whole length or more goes on by one unit.
            further = grown[j - 1][k] + sums[k][j] - sums[k][j - 1]
            if further > grown[j][k]:
                grown[j][k] = further
                grown_back[j][k] = -1
            if grown[j][k] > best[j][k]:
                best[j][k] = grown[j][k]
                back[j][k] = (-1, k)
    kinds = [AUTHORED] * len(lines)
    j, k = n, max(range(4), key=lambda x: best[n][x]) if n else 0
    while j > 0:
        i, p = back[j][k]
        if i < 0:
            end = j
            while grown_back[j][k] < 0:
                j -= 1
            i, p, j = j - WHOLE[k], grown_back[j][k], end
        for u in units[i:j]:
            for x in u:
                kinds[x] = k
        j, k = i, p
    return kinds


def authored_lines(body: str, sender: list[str], parent: str | None = None) -> list[int]:
    """Numbers of the lines that the sender wrote for this mail; blank lines never count."""
    lines = body.split("\n")
    told = describe(lines, sender, parent)
    return [i for i, kind in enumerate(decode(told)) if told[i] is not None and kind == AUTHORED]


def _hot(ids: DataFrame) -> DataFrame:
    """``rid, hot`` of the ids that hold at least 1/HOT_PARTS of all rows, to be broadcast; at most HOT_PARTS whatever the input."""
    counts = ids.groupBy("rid").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return F.broadcast(counts.where(F.col("n") * HOT_PARTS >= max(total, 1)).select("rid", F.lit(True).alias("hot")))


def _salted(rows: DataFrame, found: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """``rows`` (k, rid) joined with ``found`` (one row per rid); rows of hot ids and of none are spread."""
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    found = found.join(hot, "rid", "left").withColumn("salt", salts).drop("hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("k"), F.lit(SALTS))).when(F.col("rid").isNull(), F.pmod(F.xxhash64("k"), F.lit(1 << 30))).otherwise(F.lit(0)).cast("int")
    return rows.join(hot, "rid", "left").withColumn("salt", salt).drop("hot").join(found, ["rid", "salt"], how)


def with_parents(mails: DataFrame, key: str, body: str, message_id: str, reply_to: str, references: str | None = None) -> DataFrame:
    """``mails`` (key, body, sender) with the body of the mail that each answers, or null.

    That is the mail that ``reply_to`` names or, where it is null or not in the
    table, the last of the ``references`` that is; an id of the mail itself
    names none, and a mail without text does not count as in the table.
    """
    refs = F.reverse(F.col(references)) if references else F.array().cast("array<string>")
    named = F.concat(F.array(F.col(reply_to)), F.coalesce(refs, F.array().cast("array<string>")))
    texts = mails.select(F.col(key).alias("k"), F.col(body).alias("body"), "sender", F.col(message_id).alias("mid"))
    # Which of its ids a mail answers is found on the ids alone; the texts are read for the mails and for those answered.
    ids = written(mails.select(F.col(key).alias("k"), F.col(message_id).alias("mid"), F.filter(named, lambda x: x.isNotNull() & ~x.eqNullSafe(F.col(message_id))).alias("ids"), (F.length(body) > 0).alias("full")), "mail-ids")
    tried = ids.select("k", F.posexplode("ids").alias("at", "rid"))
    present = _salted(tried, ids.where("mid IS NOT NULL AND full").select(F.col("mid").alias("rid")).distinct(), _hot(tried), "inner")
    chosen = written(present.groupBy("k").agg(F.min_by("rid", "at").alias("rid")), "mail-answers")
    needed = texts.where(F.col("mid").isNotNull() & (F.length("body") > 0))
    parents = needed.select(F.col("mid").alias("rid"), "k", F.col("body").alias("text")).join(chosen.select("rid"), "rid", "left_semi").groupBy("rid").agg(F.min_by("text", "k").alias("parent"))
    joined = _salted(texts.select("k", "body", "sender").join(chosen, "k", "left"), parents, _hot(chosen), "left")
    return joined.select("k", "body", "sender", "parent")


def _lines(body: str, numbers: list[int]) -> list[str]:
    lines = body.split("\n")
    return [lines[i] for i in numbers]


def _decoded(store_docs: DataFrame, emit: Callable[[list, list[str], list[list[int]]], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``emit`` makes of row ids, bodies and the numbers of their newly written lines, batch by batch."""
    names = F.flatten(F.transform(F.filter("participants", lambda p: p.role == "from"), lambda p: F.array(p["name"], p.address)))
    sender = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull())
    refs = F.col("refs") if "refs" in store_docs.columns else F.array().cast("array<string>").alias("refs")
    mails = store_docs.where(F.col("message_id").isNotNull() & (F.length("body") > 0)).select("row_id", "body", "message_id", "in_reply_to", refs, sender.alias("sender"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies, senders, parents = (c.to_pylist() for c in batch.columns)
            yield emit(keys, bodies, [authored_lines(body, own or [], parent) for body, own, parent in zip(bodies, senders, parents)])

    return with_parents(mails, "row_id", "body", "message_id", "in_reply_to", "refs").mapInArrow(run, schema)


def newly_written(store_docs: DataFrame) -> DataFrame:
    """``row_id, line_no`` of every line that a mail's sender newly wrote.

    Rows without a message id and null or empty bodies give no row; a row
    delivered twice counts twice; a reply whose original is missing is decoded
    without it, one whose original was delivered several times with the copy of
    the smallest row_id.  Extra columns are not read; ``refs`` may be missing.
    """

    def emit(keys: list, bodies: list[str], own: list[list[int]]) -> pa.RecordBatch:
        rows = [k for k, numbers in zip(keys, own) for _ in numbers]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([i for numbers in own for i in numbers], pa.int64())], names=["row_id", "line_no"])

    return _decoded(store_docs, emit, "row_id bigint, line_no bigint")


def authored_tokens(store_docs: DataFrame) -> DataFrame:
    """``row_id, tokens``: distinct lower-case words of a mail's newly written lines, in order; mails without such lines give no row."""

    def emit(keys: list, bodies: list[str], own: list[list[int]]) -> pa.RecordBatch:
        kept = [(k, _lines(body, numbers)) for k, body, numbers in zip(keys, bodies, own) if numbers]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array(["\n".join(lines) for _, lines in kept], pa.string())], names=["row_id", "text"])

    return _decoded(store_docs, emit, "row_id bigint, text string").select("row_id", tokenize("text").alias("tokens"))
