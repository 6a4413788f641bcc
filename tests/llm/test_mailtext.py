import pytest

from leafmill.llm import mailtext as mt

SENDER = ["Thomas Noristetal", "thomas.noristetal@kontor.example"]


def own(body, parent=None, sender=SENDER):
    lines = body.split("\n")
    return [lines[i] for i in mt.authored_lines(body, sender, parent)]


CASES = [
    ("plain", "Hallo Anna,\n\nder Bericht liegt im Keller.\n\nViele Grüße\nThomas", ["Hallo Anna,", "der Bericht liegt im Keller."]),
    ("quote below", "Danke, das passt.\n\nAm 05.03.2024 10:11 schrieb Anna Kelber <a@x.example>:\n> Passt es?\n> Gruß\n> Anna", ["Danke, das passt."]),
    ("quote above", "On 2024-03-05 10:11, Anna wrote:\n> Is it fine?\n\nYes, it is fine.\n\nBest regards\nThomas Noristetal", ["Yes, it is fine."]),
    ("inline", "> First question?\nFirst answer here.\n> Second question?\nSecond answer here.", ["First answer here.", "Second answer here."]),
    ("unmarked", "See below.\n\nAnna Kelber schrieb am 05.03.2024 10:11:\n\nKannst du das Formular schicken?\nEs eilt sehr.", ["See below."]),
    ("headers", "Done.\n\nVon: Anna Kelber <a@x.example>\nGesendet: 05.03.2024 10:11\nAn: Thomas\nBetreff: Frage\n\nKannst du das Formular schicken?", ["Done."]),
    ("forwarded", "Please read this.\n\n---------- Forwarded message ---------\n\nThe meeting is on Monday.", ["Please read this."]),
    ("broken intro", "Yes.\n\nAm 05.03.2024 10:11 schrieb Anna\nKelber\n<a@x.example>:\n> Ja?", ["Yes."]),
    ("signature", "The report is done.\n\nKind regards\nThomas\n-- \nThomas Noristetal\nHead of Claims, Kontor Ltd.\nPhone +00 11 222 33 44\nwww.kontor.example", ["The report is done."]),
    ("postscript", "The report is done.\n\nCheers,\nThomas\n\nPS: Bring the keys on Monday.", ["The report is done.", "PS: Bring the keys on Monday."]),
    ("disclaimer", "Der Bericht ist fertig.\n\nDiese Mail ist vertraulich und nur für die genannten Empfänger bestimmt. Sollten Sie sie\nirrtümlich erhalten haben, löschen Sie sie bitte.", ["Der Bericht ist fertig."]),
    ("device", "Ist fertig.\n\nVon meinem Shelfo-Telefon gesendet", ["Ist fertig."]),
    ("moved ends", "Passt.\n\nAm 05.03.2024 10:11 schrieb Anna:\n> Kannst du mir bitte bis morgen Mittag das Formular für die Fähre\nschicken?\n> Danke", ["Passt."]),
    ("pipes", "Fine.\n\nAnna Kelber wrote on 05.03.2024 10:11:\n| Is it fine?\n| \n| Anna", ["Fine."]),
    # Words that only look like marks.
    ("like a closing", "Viele Grüße soll ich von Anna ausrichten, sie kommt am Montag.\nVon: hier bis zur Mühle sind es 32 Minuten.\n-- und noch etwas: die Kiste ist leer.", 3),
    ("like an intro", "Am Dienstag schrieb Anna, dass der Bericht fertig ist.\nOriginal message or not, the label is readable.", 2),
]


@pytest.mark.parametrize("name,body,expected", CASES)
def test_lines(name, body, expected):
    got = own(body)
    assert got == expected if isinstance(expected, list) else len(got) == expected


def test_answered_mail_tells_quoted_lines():
    parent = "Kannst du mir das Formular schicken?\nIch brauche es für die Fähre am Montag."
    body = "Ja, kommt morgen.\n\nKannst du mir das Formular schicken?\nIch brauche es für die Fähre am Montag."
    assert own(body, parent) == ["Ja, kommt morgen."]


def test_table_and_edges(spark):
    person = "array<struct<address:string,name:string,role:string>>"
    schema = f"row_id long, message_id string, in_reply_to string, body string, participants {person}, parent string, sender string, k long"
    me = [("T.N@kontor.example", None, "from"), (None, None, "to")]
    rows = [
        (1, "<a>", None, "Frage an alle: wo liegt der Bericht?", me, "", "", 1),
        (2, "<a>", None, "Frage an alle: wo liegt der Bericht?", me, "", "", 1),
        (3, "<b>", "<a>", "Im Keller.\n\nFrage an alle: wo liegt der Bericht?", None, "", "", 1),
        (4, "<c>", "<gone>", "Nur Text.", [], "", "", 1),
        (5, None, None, "Keine Mail.", me, "", "", 1),
        (6, "<d>", "<a>", None, me, "", "", 1),
        (7, "<e>", "<a>", "", me, "", "", 1),
        (8, "<f>", None, " \n\n\t", me, "", "", 1),
        (9, "<g>", None, "Ein langer Satz ohne Ende und Punkt.\n" * 3000, me, "", "", 1),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in mt.newly_written(df).collect():
        got.setdefault(r.row_id, []).append(r.line_no)
    assert got[1] == got[2] == [0] and got[3] == [0] and got[4] == [0] and set(got) == {1, 2, 3, 4, 9} and len(got[9]) == 3000
    assert mt.newly_written(df.limit(0)).count() == 0
    tokens = {r.row_id: r.tokens for r in mt.authored_tokens(df).collect()}
    assert tokens[3] == ["im", "keller"]


def test_much_answered_mail_is_salted(spark):
    person = "array<struct<address:string,name:string,role:string>>"
    schema = f"row_id long, message_id string, in_reply_to string, body string, participants {person}"
    rows = [(0, "<root>", None, "Wann ist die Sitzung im neuen Haus?", None)] + [(i, f"<r{i}>", "<root>", f"Antwort Nummer {i} kommt hier.\nWann ist die Sitzung im neuen Haus?", None) for i in range(1, 200)]
    got = mt.newly_written(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 200 and all(r.line_no == 0 for r in got)


def test_references_name_the_answered_mail(spark):
    person = "array<struct<address:string,name:string,role:string>>"
    schema = f"row_id long, message_id string, in_reply_to string, refs array<string>, body string, participants {person}"
    asked = "Kannst du mir das Formular schicken?\nIch brauche es für die Fähre am Montag."
    older = "Die Sitzung im neuen Haus beginnt heute schon um neun."
    forward = "Zur Kenntnis, das liegt noch bei uns im Büro.\n\n" + asked
    rows = [
        (0, "<old>", None, None, older, None),
        (1, "<a>", "<old>", ["<old>"], asked, None),
        (2, "<b>", None, ["<old>", "<a>"], forward, None),
        (3, "<c>", "<gone>", ["<old>", "<a>", None, "<gone>"], forward, None),
        (4, "<d>", None, ["<gone>", "<d>"], forward, None),
        (5, "<e>", "<old>", ["<a>"], forward, None),
        (6, "<f>", "<f>", ["<a>", "<f>"], forward, None),
    ]
    got = {}
    for r in mt.newly_written(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.row_id, []).append(r.line_no)
    # Without the answered mail, or with another one, nothing tells the forwarded lines.
    assert {k: sorted(v) for k, v in got.items()} == {0: [0], 1: [0, 1], 2: [0], 3: [0], 4: [0, 2, 3], 5: [0, 2, 3], 6: [0]}


@pytest.mark.parametrize("n", [5, 9, 13, 24, 60, 200])
def test_no_line_of_a_long_signature_or_disclaimer_is_authored(n):
    head = "Hallo Tom,\n\nder Bericht ist fertig.\n\n"
    marks = ["Bank", "Recht", "Anhang", "Inhalt", "Zahlung", "Gericht", "Sprache"]
    legal = "\n".join(f"Der Inhalt {i} von {marks[i % 7]} und {marks[i * 3 % 7]} ist vertraulich" + "." * (i % 2) for i in range(n))
    block = "Diese Nachricht ist vertraulich und nur für die genannten Empfänger bestimmt.\n" + "\n".join(f"{marks[i % 7]} und {marks[i * 5 % 7]} gehen in der Fassung {i} vor" + "." * (i % 2) for i in range(n))
    contacts = "-- \nAnna Kelber\nKontor GmbH\n" + "\n".join([f"Tel. +41 44 {i + 100} 22 33", f"www.seite{i}.example", f"post{i}@kontor.example", f"Lindenweg {i}"][i % 4] for i in range(n))
    for tail in (legal, block, contacts):
        assert own(head + tail, sender=["Anna Kelber"]) == ["Hallo Tom,", "der Bericht ist fertig."]


def test_long_introductions(spark):
    long = "Am 05.03.2024 10:11 schrieb Anna Kelber (" + "Abteilung Recht und Anhang, " * 40 + ") <a@x.example>:"
    assert own("Danke.\n\n" + long + "\n\nKannst du das Formular schicken?") == ["Danke."]
