import pytest

from leafmill.llm import names as nm


def linked(spark, rows):
    df = spark.createDataFrame([(n, a, o, "x") for n, a, o in rows], "name string, address string, org boolean, entity string")
    out = {}
    for r in nm.link_names(df).collect():
        out.setdefault(r.entity, set()).add(r.name)
    return sorted(map(sorted, out.values()))


PEOPLE = ["Thomas Noristetal", "Noristetal, Tom", "NORISTETAL Thomas", "Dr. Thomas Noristetal", "Thomas Nooristetal", "Thomsa Noristetal", "Noristetal, T.", "thomas noristetal", "Thomas  Noristetal (privat)", "'Thomas Noristetal'", "Thomas K. Noristetal"]


def test_spellings_of_one_person(spark):
    others = ["Sigrid Noristetal", "Thomas Beldamark", "Noristetal Insurance Inc.", "Thomas Noristetal GmbH"]
    got = linked(spark, [(n, None, False) for n in PEOPLE + others])
    assert sorted(PEOPLE) in got
    assert all([o] in got for o in others)


def test_spellings_of_one_firm(spark):
    firm = ["Varumpser Brewery Inc.", "VARUMPSER BREWERY INC.", "Varumpser-Brewery Inc.", "Varumpser Brewery, Inc.", "Fa. Varumpser Brewery", "Varumpserbrewery", "Varumpser Brew. Inc.", "Varumpser Brewrey Inc.", "Varumpser Brewery (Billing)", "Varumpser Inc."]
    other = ["Varumpser Optik Ltd.", "Brigitte Varumpser"]
    got = linked(spark, [(n, None, True) for n in firm + other[:1]] + [(other[1], None, False)])
    assert sorted(firm) in got and all([o] in got for o in other)


def test_ambiguous_initials_stay_apart(spark):
    assert linked(spark, [("Anna Kelber", None, False), ("Alfred Kelber", None, False), ("Kelber, A.", None, False)]) == [["Alfred Kelber"], ["Anna Kelber"], ["Kelber, A."]]


def test_address_decides(spark):
    rows = [("Anna Kelber", "anna@x.example", False), ("Alfred Kelber", "alfred@x.example", False), ("Kelber, A.", "ANNA@x.example", False)]
    assert linked(spark, rows) == [["Alfred Kelber"], ["Anna Kelber", "Kelber, A."]]


def test_rematch_uses_merged_spellings(spark):
    # Only the merged profile has both the mistyped surname and the full given name.
    rows = [("Eleonora Pelummkamp", None, False), ("Nora Pelumnkamp", None, False), ("Pelumnkamp, E.", None, False)]
    assert linked(spark, rows) == [["Eleonora Pelummkamp", "Nora Pelumnkamp", "Pelumnkamp, E."]]


def test_established_names_are_no_typing_errors(spark):
    rows = [(f"{g} {c}", None, False) for c in ("Kelber", "Orlinger", "Zumthal", "Wepfarth", "Ibrun", "Moserand") for g in ("Daniel", "Daniela")]
    assert all(len(x) == 1 for x in linked(spark, rows))


def test_edges(spark):
    rows = [(None, "a@x", False), ("", None, False), ("  ", None, None), ("!!!", None, False), ("Anna Kelber", None, None), ("Anna Kelber", "b@x", False), ("x" * 20_000 + " y", None, False)]
    got = linked(spark, rows)
    assert ["Anna Kelber"] in got and ["!!!"] in got and len(got) == 3
    empty = spark.createDataFrame([], "name string, address string, org boolean")
    assert nm.link_names(empty).count() == 0 and nm.variant_pairs(empty).count() == 0


def test_pairs_are_ordered_and_distinct(spark):
    df = spark.createDataFrame([("b Kelber Anna", None, False), ("Kelber Anna", None, False), ("Anna Kelber", None, False)], "name string, address string, org boolean")
    pairs = [(r.name_a, r.name_b) for r in nm.variant_pairs(df).collect()]
    assert ("Anna Kelber", "Kelber Anna") in pairs and all(a < b for a, b in pairs) and len(pairs) == len(set(pairs))


def test_crowded_address_says_nothing(spark):
    rows = [(f"Anna Kel{chr(97 + i)}{chr(97 + j)}ber", "list@x.example", False) for i in range(10) for j in range(6)]
    assert max(map(len, linked(spark, rows))) <= 60


@pytest.mark.parametrize("a,b,same", [("abcd", "abcd", True), ("abcd", "abdc", True), ("abcde", "abde", True), ("abcd", "abxd", True), ("abcd", "axyd", False), ("abcd", "dcba", False), ("ab", "abc", False)])
def test_one_edit(a, b, same):
    assert nm.one_edit(a, b) is same and nm.one_edit(b, a) is same


def test_near_forms_meet():
    for a, b in (("noristetal", "nooristetal"), ("noristetal", "noirstetal"), ("noristetal", "noritetal"), ("noristetal", "norustetal")):
        assert nm.near_forms(a) & nm.near_forms(b)


def test_components(spark):
    edges = spark.createDataFrame([("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("x", "y")], "a string, b string")
    assert {r.node: r.label for r in nm.components(edges).collect()} == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x"}


def test_crowded_address_decides_like_any_other(spark):
    consonants = "bdfgklmnprst"
    crowd = [(f"{x}o{y}ara {y}u{x}elin", "desk@x.example", False) for x in consonants for y in consonants if x != y]
    rows = [("Eleonore Kelber", "desk@x.example", False), ("Nore Kelber", "desk@x.example", False), ("Alfred Ibrun", "desk@x.example", False), ("Anna Ibrun", "anna@x.example", False), ("Ibrun, A.", "desk@x.example", False)]
    got = linked(spark, crowd + rows)
    assert ["Eleonore Kelber", "Nore Kelber"] in got and ["Alfred Ibrun", "Ibrun, A."] in got and ["Anna Ibrun"] in got


def test_close_keys_meet_wherever_names_match():
    names = [["anna", "kelber"], ["johanna", "kelber"], ["ann", "kelber"], ["bo", "li"], ["bo", "li", "karlsson"], ["nora", "kelber"], ["eleonora", "kelbre"], ["mueller", "tom"], ["muller", "thomas"], ["kelber", "max", "anna"]]
    for a in names:
        for b in names:
            if nm.same_name(a, b, {}, close=True):
                assert nm.close_keys(a) & nm.close_keys(b)


GIVEN = ["Anna", "Alfred", "Birgit", "Carsten", "Doris", "Emil", "Frieda", "Gustav", "Hedwig", "Ingo", "Jutta"]


@pytest.mark.parametrize("a,b", [("Mueller", "Moeller"), ("Martens", "Mertens")])
def test_established_surnames_with_the_same_given_names_stay_apart(spark, a, b):
    rows = [(f"{g} {s}", f"{g}.{s}@x.example".lower(), False) for g in GIVEN for s in (a, b)]
    assert all(len(x) == 1 for x in linked(spark, rows))


@pytest.mark.parametrize("times", [1, 3])
def test_decisions_do_not_depend_on_the_number_of_names(spark, times):
    surnames = ["Kelbering", "Orlingart", "Zumthalen", "Wepfarther", "Ibrunderos", "Hagenrieder", "Tabolskin", "Ulmwasser", "Pfistenau", "Gribolden", "Dorfnamer", "Laskovand"][: 4 * times]
    # For each surname so many people, a third of which is mistyped once; and two names that are both established.
    rows = [(f"{g} {s}", None, False) for s in surnames for g in GIVEN] + [(f"{g} {s[:4]}{s[5:]}", None, False) for s in surnames for g in GIVEN[:3]]
    rows += [(f"{g} {s}", None, False) for s in ("Martens", "Mertens") for g in GIVEN[: 3 * times]]
    got = linked(spark, rows)
    assert ["Anna Kelbering", "Anna Kelbring"] in got and ["Anna Martens"] in got and ["Anna Mertens"] in got


def test_all_initials_must_fit_and_merged_profiles_unite_them(spark):
    rows = [("Anna B. Muster", None, False), ("Anna Muster", None, False), ("Anton C. Muster", None, False), ("Muster, A. B.", None, False), ("Muster, A. C.", None, False), ("Muster, A.", None, False)]
    got = linked(spark, rows)
    assert ["Anna B. Muster", "Anna Muster", "Muster, A. B."] in got and ["Anton C. Muster", "Muster, A. C."] in got and ["Muster, A."] in got
    got = linked(spark, [("Klaus-Peter Ibrun", None, False), ("Kurt Ibrun", None, False), ("K.-P. Ibrun", None, False), ("Anna-Lena Orling", None, False), ("Anton Orling", None, False), ("A.-L. Orling", None, False)])
    assert ["K.-P. Ibrun", "Klaus-Peter Ibrun"] in got and ["A.-L. Orling", "Anna-Lena Orling"] in got


def test_a_common_word_makes_no_pairs(spark):
    # Two hundred profiles hold the word; the bare name fits all and so stays alone, with an address it finds its own.
    crowd = [(f"Thomas {a}{b}{c}eling", f"{a}{b}{c}@x.example", False) for a in ("Bor", "Dul", "Fam", "Gep", "Hil", "Jon", "Kum", "Len", "Mar", "Nib") for b in ("ta", "ko", "ri", "su", "pe") for c in ("dr", "st", "lm", "rk")]
    assert ["Thomas"] in linked(spark, crowd + [("Thomas", None, False)])
    assert ["Thomas", "Thomas Bortadreling"] in linked(spark, crowd + [("Thomas", "BORtadr@x.example", False)])


def test_no_table_is_broadcast(spark, monkeypatch):
    plans = []

    def noted(plain):
        return lambda df, *stem: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, *stem))[1]

    monkeypatch.setattr(nm, "written", noted(nm.written))
    monkeypatch.setattr(nm, "cut", noted(nm.cut))
    df = spark.createDataFrame([(n, "t@x.example", False) for n in PEOPLE], "name string, address string, org boolean")
    last = nm.variant_pairs(df)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert last.count() and sum("SortMergeJoin" in p for p in plans) > 10
    assert not any("Broadcast" in p or "ShuffledHashJoin" in p for p in plans)
