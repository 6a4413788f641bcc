"""The two stemming algorithms as SQL, to compare with: common table expressions over a table of distinct terms."""

from __future__ import annotations

from leafmill.functions import stem

_V, _G = "aeiouy", "aeiouyäöü"


def _head(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _region(word: str, vowels: str) -> str:
    """Length up to and with the first consonant behind a vowel, or of the whole."""
    shape = f"'^[^{vowels}]*[{vowels}]+[^{vowels}]'"
    return f"(CASE WHEN regexp_matches({word}, {shape}) THEN length(regexp_extract({word}, {shape})) ELSE length({word}) END)"


def _ends(suffixes, then) -> str:
    """A CASE over the first suffix that the word has; ``then`` makes the new word from suffix and head."""
    whens = " ".join(f"WHEN ends_with(w, '{s.replace(chr(39), chr(39) * 2)}') THEN {then(s, _head(len(s)))}" for s in suffixes)
    return f"CASE {whens} ELSE w END"


def _when(condition: str, new: str, old: str = "w") -> str:
    return f"(CASE WHEN {condition} THEN {new} ELSE {old} END)"


def _longest(suffixes) -> list[str]:
    return sorted(suffixes, key=len, reverse=True)


def _steps(name: str, first: str, steps: list[str]) -> str:
    """A chain of expressions for ``w``; ``done`` words stay as they are."""
    out, source = [first], f"{name}0"
    for i, step in enumerate(steps, 1):
        out.append(f"{name}{i} AS MATERIALIZED (SELECT term, CASE WHEN done THEN w ELSE {step} END AS w, r1, r2, done FROM {source})")
        source = f"{name}{i}"
    return ",\n".join(out), source


def english(terms: str) -> tuple[str, str]:
    """(expressions, name of the last: term, w)."""
    vowel, short = f"[{_V}]", f"regexp_matches({{0}}, '^[{_V}][^{_V}]$|[^{_V}][{_V}][^{_V}wxY]$')"
    special = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in stem._SPECIAL.items())
    keep = ", ".join(f"'{w}'" for w in sorted(stem._KEEP_1A))
    bare = "ltrim(term, chr(39))"
    marked = f"regexp_replace(CASE WHEN starts_with({bare}, 'y') THEN 'Y' || substr({bare}, 2) ELSE {bare} END, '([{_V}])y', '\\1Y', 'g')"
    first = f"""
ea AS (SELECT term, length(term) <= 2 OR CASE {bare} {special} END IS NOT NULL AS done, CASE WHEN length(term) <= 2 THEN term ELSE coalesce(CASE {bare} {special} END, {marked}) END AS w FROM {terms}),
eb AS (SELECT *, CASE WHEN starts_with(w, 'gener') OR starts_with(w, 'arsen') THEN 5 WHEN starts_with(w, 'commun') THEN 6 ELSE {_region('w', _V)} END AS r1 FROM ea),
e0 AS MATERIALIZED (SELECT term, w, done, r1, CASE WHEN r1 < length(w) AND regexp_matches(substr(w, r1 + 1), '^[^{_V}]*[{_V}]+[^{_V}]') THEN r1 + {_region('substr(w, r1 + 1)', _V)} ELSE length(w) END AS r2 FROM eb)"""

    def plural(s: str, head: str) -> str:
        if s == "sses":
            return _head(2)
        if s in ("ied", "ies"):
            return f"(CASE WHEN length(w) > 4 THEN {_head(2)} ELSE {_head(1)} END)"
        return "w" if s in ("us", "ss") else _when(f"regexp_matches({_head(2)}, '{vowel}')", _head(1))

    def past(s: str, head: str) -> str:
        if s in ("eed", "eedly"):
            return _when(f"length({head}) >= r1", f"{head} || 'ee'")
        double = "|".join(stem._DOUBLES)
        mended = f"CASE WHEN regexp_matches({head}, '(at|bl|iz)$') THEN {head} || 'e' WHEN regexp_matches({head}, '({double})$') THEN substr({head}, 1, length({head}) - 1) WHEN r1 >= length({head}) AND {short.format(head)} THEN {head} || 'e' ELSE {head} END"
        return _when(f"regexp_matches({head}, '{vowel}')", f"({mended})")

    def second(s: str, head: str) -> str:
        extra = {"ogi": f" AND ends_with({head}, 'l')", "li": f" AND regexp_matches({head}, '[cdeghkmnrt]$')"}.get(s, "")
        return _when(f"length({head}) >= r1{extra}", f"{head} || '{stem._STEP2[s]}'")

    third = lambda s, head: _when(f"length({head}) >= {'r2' if s == 'ative' else 'r1'}", f"{head} || '{stem._STEP3[s]}'")
    fourth = lambda s, head: _when(f"length({head}) >= r2" + (f" AND regexp_matches({head}, '[st]$')" if s == "ion" else ""), head)
    steps = [
        _ends(("'s'", "'s", "'"), lambda s, head: head),
        _ends(("sses", "ied", "ies", "us", "ss", "s"), plural),
        f"CASE WHEN w IN ({keep}) THEN w || '.' ELSE {_ends(('eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'), past)} END",
        f"CASE WHEN length(w) > 2 AND regexp_matches(w, '[^{_V}][yY]$') THEN {_head(1)} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, '.') THEN w ELSE {_ends(_longest(stem._STEP2), second)} END",
        f"CASE WHEN ends_with(w, '.') THEN w ELSE {_ends(_longest(stem._STEP3), third)} END",
        f"CASE WHEN ends_with(w, '.') THEN w ELSE {_ends(_longest(stem._STEP4), fourth)} END",
        f"CASE WHEN ends_with(w, 'e') THEN {_when(f'length({_head(1)}) >= r2 OR (length({_head(1)}) >= r1 AND NOT {short.format(_head(1))})', _head(1))} WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN {_head(1)} ELSE w END",
        "replace(rtrim(w, '.'), 'Y', 'y')",
    ]
    return _steps("e", first, steps)


def german(terms: str) -> tuple[str, str]:
    """(expressions, name of the last: term, w)."""
    bare = "replace(term, 'ß', 'ss')"
    between = lambda w: f"regexp_replace(regexp_replace({w}, '([{_G}])u([{_G}])', '\\1U\\2', 'g'), '([{_G}])y([{_G}])', '\\1Y\\2', 'g')"
    first = f"""
ga AS (SELECT term, {between(between(bare))} AS w FROM {terms}),
gb AS (SELECT *, {_region('w', _G)} AS r0 FROM ga),
g0 AS MATERIALIZED (SELECT term, w, false AS done, CASE WHEN length(w) > 3 THEN greatest(3, r0) ELSE length(w) END AS r1,
 CASE WHEN r0 < length(w) AND regexp_matches(substr(w, r0 + 1), '^[^{_G}]*[{_G}]+[^{_G}]') THEN r0 + {_region('substr(w, r0 + 1)', _G)} ELSE length(w) END AS r2 FROM gb)"""

    def ending(s: str, head: str) -> str:
        if s == "s":
            return _when(f"length({head}) >= r1 AND regexp_matches({head}, '[bdfghklmnrt]$')", head)
        new = f"(CASE WHEN ends_with({head}, 'niss') THEN {_head(len(s) + 1)} ELSE {head} END)" if s in ("en", "es", "e") else head
        return _when(f"length({head}) >= r1", new)

    def grade(s: str, head: str) -> str:
        extra = f" AND length({head}) > 3 AND regexp_matches({head}, '[bdfghklmnt]$')" if s == "st" else ""
        return _when(f"length({head}) >= r1{extra}", head)

    def derived(s: str, head: str) -> str:
        inside = f"length({head}) >= r2"
        cut = lambda more, limit, rest: f"(CASE WHEN {more} AND length({head}) - {rest} >= {limit} THEN {_head(len(s) + rest)} ELSE {head} END)"
        if s in ("end", "ung"):
            return _when(inside, cut(f"ends_with({head}, 'ig') AND NOT ends_with({head}, 'eig')", "r2", 2))
        if s in ("ig", "ik", "isch"):
            return _when(f"{inside} AND NOT ends_with({head}, 'e')", head)
        if s in ("lich", "heit"):
            return _when(inside, cut(f"regexp_matches({head}, '(er|en)$')", "r1", 2))
        return _when(inside, f"(CASE WHEN ends_with({head}, 'lich') AND length({head}) - 4 >= r2 THEN {_head(8)} WHEN ends_with({head}, 'ig') AND length({head}) - 2 >= r2 THEN {_head(6)} ELSE {head} END)")

    steps = [
        _ends(("ern", "em", "er", "en", "es", "e", "s"), ending),
        _ends(("est", "er", "en", "st"), grade),
        _ends(("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"), derived),
        "translate(replace(replace(w, 'U', 'u'), 'Y', 'y'), 'äöü', 'aou')",
    ]
    return _steps("g", first, steps)


def stems(terms: str) -> str:
    """Expressions that end in ``stems``: term, english, german of the table ``terms`` (term, distinct)."""
    (e, last_e), (g, last_g) = english(terms), german(terms)
    return f"{e},\n{g},\nstems AS MATERIALIZED (SELECT term, {last_e}.w AS english, {last_g}.w AS german FROM {last_e} JOIN {last_g} USING (term))"
