import random

import numpy as np

from leafmill.llm import leakage as lk

ITEM = (
    "In 1360 the twice-mended bell of Perutis cracked, yet the annals of Rilutgaro mention only goat leather. Scholars date the goat leather of Zimundric to 1618, "
    "78 years after the fire in Ostoske. Some 172 crates of blue resin reached Radulaser at dusk, so the surveyor kept raw silk under the stairs."
)
OTHER = "In 1573 the borrowed bell of Marare cracked, yet the annals of Staunump mention only millet. Scholars date the pine tar of Hirollobater to 1481, without the consent of Graarholt the toll keeper. Some 516 crates of wax tablets reached Graerifors at dusk."


def found(spark, docs):
    items = spark.createDataFrame([(1, ITEM, "a"), (2, OTHER, "b"), (3, None, "c"), (4, "", "d"), (5, "Five words stand here alone.", "e")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    return {(r.doc_id, r.item_id) for r in lk.leaked(df, "doc_id", "text", items, "item_id", "text").collect()}


def test_cases(spark):
    words = ITEM.split()
    sentences = ITEM.split(". ")
    noise = "Etwa 13 Seiten wurden im zweiten Stock verschoben und keiner hat es bemerkt. " * 3
    docs = [
        (1, noise + ITEM + noise),
        (2, noise + " ".join(words[8:34])),
        (3, ". ".join(reversed(sentences))),
        (4, noise + " ".join(f"<b>{w}</b>" if i % 3 else w for i, w in enumerate(words[5:35]))),
        (5, ITEM.upper().replace("O", "0").replace("S", "5")),
        (6, ITEM.replace("Perutis", "Perutiz").replace("leather", "laether").replace("crates", "creates")),
        (7, noise + " ".join(words[3:10])),
        (9, None),
        (10, ""),
        (11, " ".join(w + ("\n" if i % 6 else " --- und dann sagte er etwas ganz anderes ---\n") for i, w in enumerate(words))),
        (12, "> " + "\n> ".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))),
        (13, "Five words stand here alone."),
    ]
    got = found(spark, docs)
    assert got == {(i, 1) for i in (1, 2, 3, 4, 5, 6, 11, 12)} | {(13, 5)}


def test_common_phrasing_is_no_leak(spark):
    make = lambda a, b, c: f"In 1360 the hollow bell of {a} cracked, yet the annals of {b} mention only goat leather and the clock in {c} was never mended again by anyone there."
    names = [f"{x}{y}{z}" for x in ("Per", "Lom", "Kel", "Dor", "Wil") for y in ("uti", "ora", "ane", "ilo", "umo") for z in ("bert", "vik", "mond", "gard", "stad")]
    items = spark.createDataFrame([(i, make(n, names[i - 1] + "us", names[i - 2] + "ia")) for i, n in enumerate(names)], "item_id long, text string")
    docs = spark.createDataFrame([(1, make("Zaruthel", "Quomindra", "Festolau")), (2, make(names[7], names[6] + "us", names[5] + "ia"))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in lk.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(2, 7)}


def test_long_text_and_repeats(spark):
    long = "wort " * 100_000 + ITEM
    assert found(spark, [(1, long), (1, long), (2, "wort")]) == {(1, 1)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert lk.leaked(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    assert lk.leaked(some, "doc_id", "text", items, "item_id", "text").count() == 0


def test_small_bitmaps_give_the_same(spark, monkeypatch):
    docs = [(1, ITEM), (2, OTHER), (3, "Five words stand here alone."), (4, "nothing of the kind")]
    whole = found(spark, docs)
    monkeypatch.setattr(lk, "MOST_BITS", 15)
    assert found(spark, docs) == whole == {(1, 1), (2, 2), (3, 5)}


def invented(rng, n):
    return " ".join("".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_leak_is_found_however_many_items_share_it(spark):
    rng = random.Random(3)
    passage = invented(rng, 60)
    doc = invented(rng, 40) + " " + " ".join(passage.split()[2:57]) + " " + invented(rng, 40)
    unrelated = [invented(rng, 60) for _ in range(998)]
    docs = spark.createDataFrame([(1, doc), *((i + 2, t) for i, t in enumerate(invented(rng, 80) for _ in range(20)))], "doc_id long, text string")
    for shared, others in ((1, 998), (2, 50), (2, 98), (3, 10), (4, 50), (6, 10), (6, 998)):
        items = spark.createDataFrame([(i, passage + " " + invented(rng, 5)) for i in range(shared)] + [(100 + i, t) for i, t in enumerate(unrelated[:others])], "item_id long, text string")
        assert {(r.doc_id, r.item_id) for r in lk.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(1, i) for i in range(shared)}


def test_a_leak_in_most_documents_is_found_in_all(spark):
    docs = spark.createDataFrame([(i, f"Seite {i} sagt: " + ITEM) for i in range(30)] + [(100, "Seite")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in lk.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(i, 1) for i in range(30)}


def test_damaged_words(spark):
    # Every third word of a copied stretch of 30 lost a letter.
    rng = random.Random(8)
    items, docs = [], []
    for i in range(40):
        own = invented(rng, 70).split()
        items.append((i, " ".join(own)))
        part = [w[:2] + w[3:] if k % 3 == 0 and len(w) > 4 else w for k, w in enumerate(own[10:40])]
        docs.append((i, invented(rng, 50) + " " + " ".join(part) + " " + invented(rng, 50)))
    got = lk.leaked(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(40)}


def test_tiling_marks_the_longest_first_and_nothing_twice():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(30))]
        b = [rng.randrange(-1, 6) for _ in range(rng.randrange(40))]
        tiles = lk.tile(a, b)
        used_a = [p for i, _, n in tiles for p in range(i, i + n)]
        used_b = [p for _, j, n in tiles for p in range(j, j + n)]
        assert len(used_a) == len(set(used_a)) and len(used_b) == len(set(used_b))
        assert all(a[i : i + n] == b[j : j + n] and n >= lk.SHORTEST for i, j, n in tiles)
        longest = max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(len(a)) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), len(a) - i)]), default=0)
        if longest >= lk.SHORTEST:
            assert max((n for _, _, n in tiles), default=0) == longest
        # No unmarked match of the least length is left.
        ra = [x if p not in set(used_a) else -2 for p, x in enumerate(a)]
        rb = [x if p not in set(used_b) else -3 for p, x in enumerate(b)]
        assert not any(ra[i] >= 0 and ra[i : i + 2] == rb[j : j + 2] for i in range(len(ra) - 1) for j in range(len(rb) - 1) if ra[i + 1] >= 0)


def test_stray_tiles_do_not_break_a_chain():
    first, second = "zumthal opened one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    own = [lk.fold(w) for w in f"{first} {second} p q alpha beta r s gamma delta t u epsilon theta v w kappa omega".split()]
    # Only the first part has the rare word; four stray pairs of the item's words stand between the parts.
    item = lk.Item(own, [9.0 if w == lk.fold("zumthal") else 1.0 for w in own])
    doc = lk.words(f"{first} x kappa omega x epsilon theta x gamma delta x alpha beta x {second}")
    assert lk.covered(item, doc) == 16


def test_common_words_without_the_rare_ones_do_not_count():
    own = "some crates of amber reached zumthal at dusk before the old toll keeper of rimvold slept".split()
    rare = {"amber", "zumthal", "rimvold"}
    item = lk.Item([lk.fold(w) for w in own], [9.0 if w in rare else 1.0 for w in own])
    assert lk.covered(item, lk.words(" ".join("other" if w in rare else w for w in own))) == 0
    assert lk.covered(item, lk.words(" ".join(own))) == len(own)


def test_words_ignore_markup_and_underscores():
    assert lk.words('_Eine_ <a href="x">Ka&nbsp;rte</a> a<b') == [lk.fold(w) for w in ("eine", "ka", "rte", "a", "b")]
    assert len(lk.words("<" * 300_000 + " wort " + "&" * 300_000)) == 1


def test_twenty_words_in_a_row_are_a_leak_whatever_stands_beside_them():
    rng = random.Random(9)
    own = [lk.fold(w) for w in invented(rng, 60).split()]
    for start in range(0, 41, 5):
        # All the weight lies beside the copied words.
        item = lk.Item(own, [0.01 if start <= i < start + 20 else 9.0 for i in range(60)])
        assert lk.covered(item, own[start : start + 20]) == 20
        assert start == 0 or lk.covered(item, own[start : start + 12]) == 0


def test_no_pair_is_tiled_without_a_telling_seed():
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randrange(1, 70)
        seeds = np.array([rng.randrange(40) for _ in range(max(1, n - 1))], np.int64)
        weights = np.array([rng.random() ** rng.choice([1, 4]) + 0.001 for _ in range(n)])
        told = set(lk.telling_seeds(seeds, weights).tolist())
        rest = np.array(sorted(set(seeds.tolist()) - told), np.int64)
        if len(rest):
            shares = lk.seeded_shares(seeds, np.array([len(seeds)]), weights, np.array([n]), rest, np.array([len(rest)]))
            assert shares[0] < lk.SEEDED
    # A common phrase tells nothing, the rare words beside it do.
    weights = np.array(([0.1] * 8 + [9.0] * 2) * 6)
    told = lk.telling_seeds(np.arange(59), weights).tolist()
    assert told and all(weights[i] > 1 or weights[i + 1] > 1 for i in told)
