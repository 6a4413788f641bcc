"""Linking the spellings of people's and organisations' names (merge and rematch).

Each spelling is reduced to a profile: full words, initials, abbreviated words.
Blocking keys join one exact word with a near form of another, so that a block
holds spellings of one name only and no given name or surname alone makes a
block.  Matching profiles are merged; the merged profile has the union of all
spellings and initials, and so matches records (initials, abbreviations, bare
surnames) that no single spelling did.  Merged profiles go into blocking again
until nothing merges.  A record that fits several profiles equally is ambiguous
and stays apart.

All tables grow with the collection, and a Python step makes many keys of a short
row, which the optimizer doesn't foresee.  So joins are told to merge: none sends
a table through the driver to all tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.session import cut, written

#: A word counts as a typing error of another if only one name has it, or so many times fewer names; how many names there are in all does not matter.
FEWER = 4
#: Or if it is in so many times fewer names, and at least this share of its names stand there with the other word too.
FEWER_BESIDE, BESIDE = 2, 0.5
#: Initials of a record that its profile is looked up by; a name has seldom more.
MOST_INITIALS = 3

# Titles and forms of address that are no part of a name.
TITLES = frozenset("herr frau hr fr dr prof mr mrs ms miss sir madame monsieur mme mlle señor señora sr sra dipl ing med lic iur mag jun sen jr fa firma".split())
# Words of legal forms.
LEGAL = frozenset("gmbh mbh ag kg kgaa ohg gbr ug se ltd limited inc incorporated llc llp lp corp corporation co company cie plc sarl sàrl sa sas bv nv srl ev eg genossenschaft group holding stiftung verein und".split())
# Nicknames and the given names they stand for.
NICKNAMES = {
    "tom": "thomas", "tommy": "thomas", "nora": "eleonora", "elli": "eleonora elisabeth", "lilo": "lieselotte", "lotte": "lieselotte charlotte", "bernie": "bernhard", "bernd": "bernhard",
    "betty": "elisabeth", "lisa": "elisabeth", "sisi": "elisabeth", "liz": "elisabeth", "beth": "elisabeth", "danny": "daniel", "dan": "daniel", "rike": "friederike ulrike", "topher": "christopher", "chris": "christopher christian christine",
    "hias": "matthias", "matze": "matthias", "matt": "matthias matthew", "wolfi": "wolfgang", "jonny": "jonathan", "jon": "jonathan", "pippa": "philippa", "phil": "philipp philip", "jackie": "jacqueline",
    "nick": "nicholas nikolaus", "nico": "nicholas nikolaus", "nik": "nicholas nikolaus dominik", "gerd": "gerhard", "charly": "charlotte karl charles", "charlie": "charlotte karl charles", "ted": "theodor theodore edward", "ed": "edward eduard",
    "eddie": "edward eduard", "freddy": "friedrich frederick alfred ferdinand", "fred": "friedrich frederick alfred", "ferdi": "ferdinand", "nate": "nathaniel", "nat": "nathaniel", "rosi": "rosemarie", "raffi": "raphael raphaela", "lutz": "ludwig", "manu": "emanuel manuela",
    "josie": "josephine", "susi": "susanne", "sanne": "susanne", "sue": "susanne", "debbie": "deborah", "deb": "deborah", "bob": "robert", "rob": "robert", "robbie": "robert", "siggi": "sigrid siegfried", "becky": "rebecca",
    "willi": "wilhelm", "will": "william", "bill": "william", "billy": "william", "reini": "reinhard", "dick": "richard", "rick": "richard", "richie": "richard", "heiner": "heinrich", "heinz": "heinrich karlheinz", "harry": "heinrich harald henry",
    "sascha": "alexander alexandra", "alex": "alexander alexandra", "sandra": "alexandra", "gitte": "brigitte", "gitti": "brigitte", "bärbel": "barbara", "babs": "barbara", "walti": "walter", "malou": "marielouise", "marlies": "marielouise",
    "benni": "benjamin", "ben": "benjamin", "jeannot": "jeanluc jean", "thea": "theodora dorothea", "dora": "theodora", "hannes": "johannes johann", "hans": "johannes johann", "hanne": "hannelore johanna", "lore": "hannelore eleonora",
    "michi": "michael michaela", "mike": "michael", "mick": "michael", "helmi": "wilhelm wilhelmine helmut", "kalle": "karl karlheinz", "ulli": "ulrike ulrich", "uli": "ulrike ulrich", "andi": "andreas andrea", "andy": "andreas andrew", "käthe": "katharina", "kathi": "katharina", "kate": "katharina catherine",
    "lena": "magdalena helena annalena", "leni": "magdalena helena", "anni": "anna annalena", "gretel": "margarethe", "grete": "margarethe", "greta": "margarethe", "peggy": "margaret", "conny": "cornelia", "nelly": "cornelia", "steffi": "stephanie", "gabi": "gabriele",
    "vicky": "viktoria", "vroni": "veronika", "terri": "theresa", "resi": "theresa", "sämi": "samuel", "sam": "samuel samantha", "basti": "sebastian", "trish": "patricia", "pat": "patricia patrick", "kosta": "konstantin", "konni": "konstantin cornelia",
    "bella": "isabella", "isa": "isabella", "tina": "kristina christina martina valentina", "kp": "klauspeter", "klaus": "klauspeter nikolaus", "karli": "karlheinz", "leo": "leonhard leopold", "max": "maximilian", "maxi": "maximilian", "dani": "daniel daniela", "zach": "zacharias", "jo": "johannes josephine joseph johanna", "fritz": "friedrich", "sepp": "josef", "vera": "veronika", "tim": "timothy", "jeff": "jeffrey", "greg": "gregory", "steph": "stephanie", "fränzi": "franziska", "franzi": "franziska", "val": "valentina", "joe": "joseph", "toni": "anton antonia", "moni": "monika",
}

# Given names of two parts that some write apart.
DOUBLE_NAMES = frozenset("klaus-peter karl-heinz hans-peter hans-jürgen hans-jörg karl-friedrich jean-luc jean-pierre jean-claude jean-marc marie-louise marie-claire anna-lena anna-maria anna-sophie eva-maria josé-maría".split())

_BRACKETS = re.compile(r"\([^)]*\)|\[[^\]]*\]|<[^>]*>")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?-?){1,3}$")
_WRITTEN_OUT = re.compile("(?<=[aou])e")


def _fold(word: str) -> str:
    """Lower case, letters and digits only; an umlaut is its vowel."""
    word = unicodedata.normalize("NFKD", word.lower().replace("ß", "ss"))
    return "".join(c for c in word if c.isalnum())


_NICKNAMES = {_fold(k): [_fold(x) for x in v.split()] for k, v in NICKNAMES.items()}
_GIVEN = {w for v in _NICKNAMES.values() for w in v}
_LEGAL = {_fold(w) for w in LEGAL}
_DOUBLE = {_fold(w): "".join(_fold(x)[0] for x in w.split("-")) for w in DOUBLE_NAMES}
_TITLES = {_fold(w) for w in TITLES}


def profile(name: str) -> dict:
    """Words, initials, abbreviated words, legal form and signature of one spelling.

    The initials of a full name are those that stand beside its words, and those of the parts of its hyphenated words.
    """
    text = unicodedata.normalize("NFKC", _BRACKETS.sub(" ", name))
    text = re.sub(r"\b([A-Za-z])\. ?([A-Za-z])\.(?!\w|-)", lambda m: m[1] + m[2] if (m[1] + m[2]).lower() in ("sa", "ev", "eg", "ek", "bv", "nv") else m[0], text)
    pieces = [p for p in re.split(r"[\s,;&+/\"'’`´]+", text) if p.strip(".-")]
    words, initials, short, legal = [], set(), set(), []
    for piece in pieces:
        plain = _fold(piece)
        if not plain:
            continue
        if plain in _LEGAL:
            legal.append(plain)
        elif plain in _TITLES:
            continue
        elif len(plain) == 1 or (_INITIALS.match(piece) and "." in piece) or (len(plain) == 2 and piece.isupper() and plain not in _NICKNAMES):
            initials.update(plain)
        elif piece.endswith(".") and len(plain) >= 3:
            short.add(plain)
        else:
            words.append((piece, plain))
    core, second = [], set()
    for piece, plain in words:
        half = [_fold(x) for x in piece.split("-")]
        # A hyphen joins two given names to one word, but a firm's name and trade are two.
        core += half if legal and len(words) == 1 and len(half) == 2 and min(map(len, half)) > 3 else [plain]
        if not legal and len(half) > 1:
            second.update(x[0] for x in half if x)
    if not legal and len(core) == 3:
        if core[0] + core[1] in _DOUBLE:
            core = [core[0] + core[1], core[2]]
        elif core[1] + core[2] in _DOUBLE:
            core = [core[0], core[1] + core[2]]
    if legal and len(core) == 2:
        # A firm that carries a person's name is not that person.
        core = ["firm~" + t if t in _GIVEN else t for t in core]
    tokens = sorted(set(core))
    full = len(tokens) > 1
    form = "".join(legal)
    signature = " ".join(tokens)
    if not full:
        signature += "#" + "".join(sorted(initials)) + "#" + " ".join(sorted(short)) + "#" + form
    return {"sig": signature, "tokens": tokens, "initials": sorted(initials | second) if full else sorted(initials), "short": sorted(short) if len(tokens) == 1 else [], "legal": form, "joined": "".join(core)}


_PROFILE = "name string, sig string, tokens array<string>, initials array<string>, short array<string>, legal string, joined string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    schema = pa.schema([("name", pa.string()), ("sig", pa.string()), ("tokens", texts), ("initials", texts), ("short", texts), ("legal", pa.string()), ("joined", pa.string())])
    for batch in batches:
        names = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_pylist([{"name": n} | profile(n) for n in names], schema=schema)


def near_forms(word: str) -> set[str]:
    """The word and what is left of it without one letter; words one edit or one swap apart share one."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) >= 4 else {word}


def meanings(word: str) -> list[str]:
    """The word, the same with written-out umlauts read as such, and the given names that it stands for as a nickname."""
    plain = _WRITTEN_OUT.sub("", word)
    return [word, *([plain] if plain != word else []), *_NICKNAMES.get(word, ())]


def pair_keys(tokens: list[str]) -> set[str]:
    """Keys of one exact word (or what it stands for) with a near form of another."""
    keys = set()
    for t in tokens:
        for exact in meanings(t) if len(t) >= 3 or t in _NICKNAMES else ():
            for u in tokens:
                if u != t:
                    keys.update(f"{exact}|{form}" for v in meanings(u) for form in near_forms(v))
    return keys


def close_keys(tokens: list[str]) -> set[str]:
    """Keys of one word (or what it stands for) with near forms and parts of three letters of another.

    Whatever ``same_name`` takes for one name under a common address shares one:
    at most one word differs, and it has a near form or a part in common.
    """
    keys = set()
    for i, t in enumerate(tokens):
        for exact in meanings(t):
            for u in tokens[:i] + tokens[i + 1 :]:
                keys.update(f"{exact}|{form}" for v in meanings(u) for form in near_forms(v))
                keys.update(f"{exact}~{u[k : k + 3]}" for k in range(len(u) - 2))
    return keys


def one_edit(a: str, b: str) -> bool:
    """Whether the words are at most one insertion, deletion, change or swap apart."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(a) < 4:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def typing_error(a: str, b: str, names: dict[str, int]) -> bool:
    """Whether the two words, or what they stand for, are near and one is so rare that it is the other mistyped.

    What a word stands for is as common as the word: umlauts that are written
    out, or a nickname, make no established name rare.
    """
    low, high = sorted((names.get(a, 1), names.get(b, 1)))
    return (low == 1 or low * FEWER <= high) and any(one_edit(v, w) for v in meanings(a) for w in meanings(b))


def same_name(a: list[str], b: list[str], names: dict[str, int], close: bool = False) -> bool:
    """Whether each word of the shorter name is a word of the other, at most one of them mistyped.

    ``close`` (both stand under one address) also lets a given name be shortened.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2:
        return False
    rest, wrong = list(b), 0
    exact = [x for x in a if x in rest]
    for x in exact:
        rest.remove(x)
    for x in a:
        if x in exact:
            continue
        alike = next((y for y in rest if set(meanings(x)) & set(meanings(y))), None)
        if alike is None:
            alike = next((y for y in rest if typing_error(x, y, names)), None)
            if alike is None and close:
                alike = next((y for y in rest if min(len(x), len(y)) >= 3 and (x in y or y in x)), None)
            wrong += 1
        if alike is None or wrong > 1:
            return False
        rest.remove(alike)
    return True


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of the edges (a, b) is connected with.

    Labels spread to neighbours and jump to their label's label; the number of
    rounds grows with the logarithm of the longest chain.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        spread = both.join(labels.hint("merge"), both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        new = (
            labels.join(spread.hint("merge"), "node")
            .withColumn("low", F.least("label", "near"))
            .join(own.hint("merge"), F.col("low") == F.col("at"), "left")
            .select("node", F.least("low", F.coalesce("jump", "low")).alias("new"), "label")
        )
        new = cut(new)
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _keyed(members: DataFrame, make: Callable[[list[str]], set[str]]) -> DataFrame:
    """``id, key`` of every key that ``make`` gives for the tokens of a profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = make(tokens)
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.string())], names=["id", "key"])

    return members.where(F.size("tokens") > 1).select("id", "tokens").mapInArrow(run, "id string, key string")


def undecided(a: list[str], b: list[str], names: dict[str, int], close: bool = False) -> tuple[str, str] | None:
    """(rarer, commoner) word of two names that are the same if the one word is the other mistyped, which other names decide."""
    for x in a:
        for y in b:
            low, high = sorted((x, y), key=lambda w: names.get(w, 1))
            n = names.get(low, 1)
            if x not in b and y not in a and n > 1 and n * FEWER_BESIDE <= names.get(high, 1) and same_name(a, b, names | {low: 1}, close):
                return low, high
    return None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of names that are the same; with ``low, high, n, holder`` of those that other names decide."""
    for batch in batches:
        rows = []
        for i, j, ta, fa, tb, fb, close in zip(*(c.to_pylist() for c in batch.columns)):
            names = dict(zip(ta, fa)) | dict(zip(tb, fb))
            if same_name(ta, tb, names, close):
                rows.append((i, j, None, None, None, None))
            elif min(len(ta), len(tb)) > 1 and (words := undecided(ta, tb, names, close)):
                rows.append((i, j, *words, names[words[0]], i if words[0] in ta else j))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.string()] * 4 + [pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "low", "high", "n", "holder"])


def _blocked(keyed: DataFrame, all_keyed: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of profiles of which one is in ``keyed``, the other in ``all_keyed`` (id, key), that share a key."""
    both = keyed.withColumnRenamed("id", "x").join(all_keyed.withColumnRenamed("id", "y").hint("merge"), "key").where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _together(members: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of profiles (id, tokens) that share a close key and an address (places: sig, address), however many stand there."""
    keyed = _keyed(members, close_keys).join(places.withColumnRenamed("sig", "id").hint("merge"), "id")
    right = keyed.select("address", "key", F.col("id").alias("b"))
    return keyed.withColumnRenamed("id", "a").join(right.hint("merge"), ["address", "key"]).where("a < b").select("a", "b").distinct()


def _matched(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """The candidate pairs (a, b, close) that are spellings of one name."""
    own = members.select("id", "tokens", "freq")
    full = candidates.join(own.toDF("a", "ta", "fa").hint("merge"), "a").join(own.toDF("b", "tb", "fb").hint("merge"), "b")
    told = written(full.select("a", "b", "ta", "fa", "tb", "fb", "close").mapInArrow(_verify, "a string, b string, low string, high string, n int, holder string"), "names-told")
    beside = told.where("low IS NOT NULL").groupBy("low", "high").agg(F.countDistinct("holder").alias("held"), F.max("n").alias("n")).where(F.col("held") >= F.lit(BESIDE) * F.col("n"))
    return told.where("low IS NULL").select("a", "b").union(told.join(beside.select("low", "high").hint("merge"), ["low", "high"]).select("a", "b"))


def fitting_keys(tokens: list[str], initials: list[str], joins: list[str], legals: list[str], org: bool) -> set[str]:
    """Keys of all records of one word that fit a merged profile."""
    keys = {f"j|{w}" for w in joins} | {f"n|{w}" for w in tokens}
    for w in tokens:
        others = [t for t in tokens if t != w]
        if org:
            keys.add(f"o|{w}")
            keys.update(f"s|{w}|{t[:n]}" for t in others for n in range(3, len(t) + 1))
            keys.update(f"l|{w}|{x}" for x in legals)
        else:
            letters = sorted({c for t in others for c in _DOUBLE.get(t, t[0])} | set(initials))
            keys.update(f"i|{w}|{''.join(c)}" for n in range(1, MOST_INITIALS + 1) for c in combinations(letters, n))
    return keys


def record_keys(word: str, initials: list[str], short: list[str], legal: str, org: bool) -> list[tuple[int, str]]:
    """(level, key) of the merged profiles that a record of one word fits; a later level counts where the earlier ones fit none."""
    if short:
        return [(0, f"s|{word}|{x}") for x in short]
    if initials:
        # All initials must fit, else, as a profile may know too few, one of them.
        return [(0, f"i|{word}|{''.join(initials[:MOST_INITIALS])}"), *((1, f"i|{word}|{c}") for c in (initials if len(initials) > 1 else []))]
    return [(0, f"j|{word}"), (0, f"l|{word}|{legal}" if legal else f"o|{word}" if org else f"n|{word}")]


def _attachable(records: DataFrame, keyed: DataFrame, known: DataFrame, places: DataFrame) -> DataFrame:
    """``sig, label``: records of one word (initials, abbreviation, bare or joined name) and the one merged profile that they fit.

    ``records``: sig, level, key.  ``keyed``: id, key of the merged profiles.
    ``places``: sig, address.  What fits several profiles is decided by a common
    address, else left.  Whether one profile fits or several is told by the
    smallest and largest id under a key, so no pair of a record with all profiles
    of a common word is ever made.
    """
    spread = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    fits = records.join(spread.hint("merge"), "key").groupBy("sig", "level").agg(*ends)
    first = Window.partitionBy("sig").orderBy("level")
    fits = fits.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    # The profiles under whose addresses the record stands too.
    homes = places.join(known.hint("merge"), "sig").select("address", F.col("label").alias("id")).distinct()
    near = keyed.join(homes.hint("merge"), "id").groupBy("key", "address").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    beside = records.join(places.hint("merge"), "sig").join(near.hint("merge"), ["key", "address"]).groupBy("sig", "level").agg(F.min("low").alias("near_low"), F.max("high").alias("near_high"))
    judged = fits.join(beside.hint("merge"), ["sig", "level"], "left")
    home = F.col("near_low") == F.col("near_high")
    alone = F.col("near_low").isNull() & (F.col("low") == F.col("high"))
    return judged.where(home | alone).select("sig", F.coalesce("near_low", "low").alias("label"))


def link_names(spellings: DataFrame) -> DataFrame:
    """``name, entity`` for every spelling; spellings of one entity have the same ``entity``.

    ``spellings``: ``name STRING, address STRING, org BOOLEAN`` with any number
    of rows per name.  Null and blank names are left out; a name without letters
    is an entity of its own.  Ties are decided by the smallest signature, so the
    result does not depend on the order of rows.  An empty table gives an empty
    result.
    """
    seen = spellings.where(F.trim("name") != "").select("name", F.lower(F.trim("address")).alias("address"), F.coalesce("org", F.lit(False)).alias("org")).distinct()
    seen = written(seen, "names-seen")
    parsed = written(seen.select("name").distinct().mapInArrow(_parse, _PROFILE), "names-parsed")
    parsed = parsed.withColumn("sig", F.when(F.size("tokens") > 0, F.col("sig")).otherwise(F.concat(F.lit("="), F.col("name"))))
    flags = seen.groupBy("name").agg(F.max("org").alias("org"))
    sigs = (
        parsed.join(flags.hint("merge"), "name")
        .groupBy("sig")
        .agg(
            F.first("tokens").alias("tokens"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("initials")))).alias("initials"),
            F.first("short").alias("short"),
            F.max("legal").alias("legal"),
            F.collect_set(F.when(F.col("legal") != "", F.col("legal"))).alias("legals"),
            F.collect_set("joined").alias("joins"),
            F.max(F.col("org") | (F.col("legal") != "")).alias("org"),
        )
    )
    sigs = written(sigs, "names-sigs")
    spread = sigs.select("sig", F.posexplode("tokens").alias("at", "token"))
    counts = spread.groupBy("token").agg(F.count("*").cast("int").alias("n"))
    freq = spread.join(counts.hint("merge"), "token").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).getField("n").alias("freq"))
    members = written(sigs.join(freq.hint("merge"), "sig").where(F.size("tokens") > 1).select(F.col("sig").alias("id"), "tokens", "freq"), "names-members")

    places = seen.where(F.col("address") != "").join(parsed.select("name", "sig").hint("merge"), "name").select("sig", "address").distinct()
    places = written(places, "names-places")

    profiles = _keyed(members, pair_keys)
    blocked = _blocked(profiles, profiles).withColumn("close", F.lit(False))
    together = _together(members, places).withColumn("close", F.lit(True))
    edges = written(_matched(blocked.union(together), members), "names-edges")
    labels = components(edges)
    known = members.select(F.col("id").alias("sig")).join(labels.withColumnRenamed("node", "sig").hint("merge"), "sig", "left").select("sig", F.coalesce("label", "sig").alias("label"))
    known = written(known, "names-known")
    merged = written(_merged(known, sigs, freq), "names-merged")
    keyed = written(_profile_keys(merged), "names-keys")
    records = written(_record_keys(sigs), "names-records")
    # Profiles of one spelling have met each other already.
    changed = merged.where("n_sigs > 1").select("id")
    while True:
        # Richer profiles are blocked again, by the union of their words; those that nothing was merged into are only met.
        pairs = keyed.where("kind = 'pair'").select("id", "key")
        again = _matched(_blocked(pairs.join(changed.hint("merge"), "id", "left_semi"), pairs).withColumn("close", F.lit(False)), merged)
        again = written(again, "names-again")
        loose = records.join(known.select("sig").hint("merge"), "sig", "left_anti")
        attached = written(_attachable(loose, keyed.where("kind = 'fit'").select("id", "key"), known, places), "names-attached")
        if not again.limit(1).count() and not attached.limit(1).count():
            break
        moves = written(components(again).select(F.col("node").alias("label"), F.col("label").alias("to")), "names-moves")
        known = known.union(attached.select("sig", "label")).join(moves.hint("merge"), "label", "left").select("sig", F.coalesce("to", "label").alias("label"))
        known = written(known, "names-known")
        touched = moves.select(F.col("label").alias("id")).union(attached.select(F.col("label").alias("id"))).distinct()
        changed = written(touched.join(moves.withColumnRenamed("label", "id").hint("merge"), "id", "left").select(F.coalesce("to", "id").alias("id")).distinct(), "names-changed")
        renewed = written(_merged(known.join(changed.withColumnRenamed("id", "label").hint("merge"), "label", "left_semi"), sigs, freq), "names-renewed")
        gone = touched.union(changed).distinct()
        merged = written(merged.join(gone.hint("merge"), "id", "left_anti").unionByName(renewed), "names-merged")
        keyed = written(keyed.join(gone.hint("merge"), "id", "left_anti").unionByName(_profile_keys(renewed)), "names-keys")
    return parsed.select("name", "sig").join(known.hint("merge"), "sig", "left").select("name", F.coalesce("label", "sig").alias("entity"))


def _merged(known: DataFrame, sigs: DataFrame, freq: DataFrame) -> DataFrame:
    """Merged profiles of ``known`` (sig, label): the union of the words, initials, legal forms and joined spellings of their signatures."""
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    merged = known.join(sigs.hint("merge"), "sig").join(freq.hint("merge"), "sig", "left").groupBy("label").agg(
        F.count("*").alias("n_sigs"), union(F.arrays_zip("tokens", "freq")).alias("words"), union("initials").alias("initials"), F.max("org").alias("org"), union("legals").alias("legals"), union("joins").alias("joins")
    )
    # A word that stands alone in an attached record has no count of its own there.
    words = F.filter("words", lambda w: w.tokens.isNotNull() & w.freq.isNotNull())
    return merged.withColumn("words", words).select(F.col("label").alias("id"), F.col("words.tokens").alias("tokens"), F.col("words.freq").alias("freq"), "initials", "org", "legals", "joins", "n_sigs")


def _profile_keys(merged: DataFrame) -> DataFrame:
    """``id, kind, key`` of merged profiles: kind ``pair`` to be blocked by, ``fit`` for the records that fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, keys = [], [], []
            for i, tokens, initials, joins, legals, org in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, own in (("pair", pair_keys(tokens) if len(tokens) > 1 else ()), ("fit", fitting_keys(tokens, initials, joins, legals, org))):
                    ids += [i] * len(own)
                    kinds += [kind] * len(own)
                    keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(keys, pa.string())], names=["id", "kind", "key"])

    return merged.select("id", "tokens", "initials", "joins", "legals", "org").mapInArrow(run, "id string, kind string, key string")


def _record_keys(sigs: DataFrame) -> DataFrame:
    """``sig, level, key`` of all records of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, level, key) for s, *record in zip(*(c.to_pylist() for c in batch.columns)) for level, key in record_keys(*record)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["sig", "level", "key"])

    return sigs.where(F.size("tokens") == 1).select("sig", F.col("tokens")[0], "initials", "short", "legal", "org").mapInArrow(run, "sig string, level int, key string")


def variant_pairs(spellings: DataFrame) -> DataFrame:
    """``name_a, name_b`` (``name_a < name_b`` by code points) of spellings of one entity."""
    linked = written(link_names(spellings), "names-linked")
    left, right = linked.toDF("name_a", "entity"), linked.toDF("name_b", "entity")
    return left.join(right.hint("merge"), "entity").where("name_a < name_b").select("name_a", "name_b")


def store_spellings(store_docs: DataFrame) -> DataFrame:
    """All spellings of participants, and of valid person and organisation entities."""
    people = store_docs.select(F.explode("participants").alias("p")).select("p.name", "p.address", F.lit(False).alias("org"))
    entities = store_docs.select(F.explode("entities").alias("e")).where(F.col("e.type").isin("person", "org") & ~F.coalesce(F.col("e.valid") == F.lit(False), F.lit(False)))
    return people.union(entities.select("e.value", F.lit(None).cast("string"), F.col("e.type") == "org"))
