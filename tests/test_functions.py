from datetime import date

import pytest
from pyspark.sql import functions as F

from leafmill.functions import canonical, decode, expansion, hashing, stem, temporal, text
from leafmill.plans import config


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first().x


def test_tokenize_edges(spark):
    rows = spark.createDataFrame([("It's a Test, test-case ÄÖ _x 7",), ("",), (None,), ("a " * 50_000 + "Wort",)], "t string")
    got = [r.x for r in rows.select(text.tokenize("t").alias("x")).collect()]
    assert got == [["it's", "test", "test-case", "äö", "_x"], [], [], ["wort"]]


def test_path_functions(spark):
    assert one(spark, text.path_tokens(F.lit("mail/2024_HTTPServer-myFile.tar.gz"))) == ["mail", "2024", "http", "server", "my", "file", "tar", "gz"]
    assert [one(spark, text.path_score(F.lit("/a/Holiday-photos/x.JPG"), F.lit(t))) for t in ("holiday", "holi", "hotos", "zzz")] == [3, 2, 1, 0]
    assert one(spark, text.normalize_path(F.lit(r".\.\a\b"))) == "a/b"
    assert one(spark, text.drive_id(F.lit("./inventory/find-dump/disk1/s.md"))) == "disk1"
    assert one(spark, text.has_prefix(F.lit("inventory/x"), ["inventory/", ""])) is True
    assert one(spark, text.has_prefix(F.lit("inventory2/x"), ["inventory"])) is False


def test_slug_thread_and_marks(spark):
    assert one(spark, text.slugify(F.lit("  Hällo, Wörld!  Again "))) == "hällo_wörld_again"
    assert one(spark, text.slugify(F.lit("!!"), "note")) == "note"
    assert one(spark, text.strip_end_tokens(F.lit("a<|END_OF_TURN_TOKEN|>b"))) == "ab"
    assert len(one(spark, text.thread_id(F.lit("<root@x>")))) == 16


@pytest.mark.parametrize("size,expected", [(0, []), (1, [0]), (2000, [0]), (2001, [0, 1800]), (3800, [0, 1800]), (3801, [0, 1800, 3600])])
def test_window_starts(spark, size, expected):
    assert one(spark, text.window_starts(F.lit("x" * size))) == expected


def test_snippet(spark):
    body = "x" * 100 + " Invoice\nover " + "y" * 400
    assert one(spark, text.snippet(F.lit(body), F.array(F.lit("zzz"), F.lit("invoice")))).startswith("…xxx")
    assert one(spark, text.snippet(F.lit("short\nbody"), F.array(F.lit("zzz")))) == "short body"


def test_field_tokens_counts_fields(spark):
    row = spark.sql(
        "SELECT 'alpha beta alpha' AS body, 'Alpha' AS title, array('Big Tag', NULL) AS tags, array(named_struct('value', 'gamma', 'canonical', 'alpha', 'valid', false), named_struct('value', 'delta', 'canonical', NULL, 'valid', CAST(NULL AS BOOLEAN))) AS entities, array(named_struct('address', 'a@b.example', 'name', NULL)) AS participants"
    )
    tokens = row.select(text.field_tokens("body", "title", "tags", "entities", "participants").alias("x")).first().x
    assert tokens.count("alpha") == 2 and "gamma" not in tokens and "big tag" in tokens and "delta" in tokens and "example" in tokens


def test_canonical_nulls(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, canonical.iban(nothing)) is None
    assert one(spark, canonical.email(nothing)) is None
    assert one(spark, canonical.phone(nothing)) is None
    assert one(spark, canonical.iso8601(nothing)) is None
    assert one(spark, canonical.amount(nothing)).amount is None
    assert one(spark, canonical.utc_seconds(F.lit("2024-05-06T07:08:09+02:00"))) == "2024-05-06T05:08:09Z"


def test_git_hashes(spark):
    assert one(spark, hashing.git_blob_sha1(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, hashing.object_path(F.lit("ab" * 32))).startswith("_objects/ab/")


@pytest.mark.parametrize(
    "query,low,high",
    [
        ("mails last month", "2024-02-01", "2024-02-29"), ("letzte Woche", "2024-03-04", "2024-03-10"), ("this week", "2024-03-11", "2024-03-15"), ("dieses Jahr", "2024-01-01", "2024-03-15"), ("diesen Monat", "2024-03-01", "2024-03-15"), ("PREVIOUS  week", "2024-03-04", "2024-03-10"), ("vom vergangenen Jahr", "2023-01-01", "2023-12-31"), ("zuletzt", "2024-02-14", "2024-03-15"), ("in letzter Zeit", "2024-02-14", "2024-03-15"),
        ("gestern", "2024-03-14", "2024-03-14"), ("today", "2024-03-15", "2024-03-15"), ("recent notes", "2024-02-14", "2024-03-15"), ("last month or today", "2024-02-01", "2024-02-29"),
    ],
)
def test_date_window(query, low, high):
    assert temporal.date_window(query, date(2024, 3, 15)) == (date.fromisoformat(low), date.fromisoformat(high))


def test_no_date_window():
    assert temporal.date_window("lastly, a monthly list", date(2024, 3, 15)) is None


@pytest.mark.parametrize("word,expected", [("running", "run"), ("generously", "generous"), ("consolation", "consol"), ("hoped", "hope"), ("skies", "sky"), ("ties", "tie"), ("dying", "die"), ("knightly", "knight"), ("exceed", "exceed")])
def test_english_stems(word, expected):
    assert stem.english(word) == expected


@pytest.mark.parametrize("word,expected", [("häuser", "haus"), ("katzen", "katz"), ("aufeinander", "aufeinand"), ("kategorischen", "kategor"), ("verhältnisse", "verhaltnis"), ("freundlichkeit", "freundlich")])
def test_german_stems(word, expected):
    assert stem.german(word) == expected


def test_stemmed_tokens(spark):
    rows = spark.createDataFrame([(1, ["running", "häuser"])], "doc long, tokens array<string>")
    assert stem.stemmed(rows).first().tokens == ["running", "run", "häuser", "haus"] or stem.stemmed(rows).first().tokens[:2] == ["running", "run"]


def test_decoding():
    assert decode.decode_bytes("Grüße".encode()) == "Grüße"
    assert decode.decode_bytes("Grüße".encode("latin-1"), "latin-1") == "Grüße"
    assert decode.repair("GrÃ¼ÃŸe") == "Grüße"
    assert decode.repair("﻿é") == "é"


def test_date_without_phrase():
    assert temporal.date_window("todays yesterdayish thismonth", date(2024, 3, 15)) is None and temporal.date_window(None, date(2024, 3, 15)) is None


@pytest.mark.parametrize(
    "written,day",
    [
        ("2024-05-06", "2024-05-06"), ("2024-05-06 whatever", "2024-05-06"), ("2024-02-30", None), ("20240506", "2024-05-06"), ("20240506T0708+0200", "2024-05-06"), ("202405061", None), ("2024-W19-1", "2024-05-06"), ("2024W191", "2024-05-06"),
        ("2024-W19", "2024-05-06"), ("2024-W53-1", None), ("2020-W53-5", "2021-01-01"), ("2020-W01-1", "2019-12-30"), ("6.5.2024", None), ("", None), (None, None),
    ],
)
def test_doc_date_forms(spark, written, day):
    found = one(spark, temporal.doc_date(F.lit(written).cast("string")))
    assert (str(found) if found else None) == day


def test_decoded_column_equals_repair(spark):
    texts = ["\ufeffkopf", "Ã¼ber", "gru\u0308n", "plain", "", "Ωmega Ω", "â€žzitatâ€œ", "日本語", "é\u0301", "Привет", None]
    rows = spark.createDataFrame([(i, None if t is None else t.encode(), None) for i, t in enumerate(texts)] + [(90, b"Gr\xfc\xdfe", "latin-1"), (91, b"Gr\xfc\xdfe", "no-such"), (92, b"\xff\xfe\x00", None)], "id long, data binary, hint string")
    got = {r.id: r.clean for r in decode.decoded(rows, "data", "clean", "hint").collect()}
    assert {i: got[i] for i in range(len(texts))} == {i: None if t is None else decode.repair(t) for i, t in enumerate(texts)}
    assert got[90] == "Grüße" and got[0] == "kopf" and got[1] == "über" and got[2] == "grün" and len(got) == len(texts) + 3
    assert {r.id: r.clean for r in decode.decoded(rows.drop("hint"), "data", "clean").where("id < 90").collect()} == {i: got[i] for i in range(len(texts))}
    assert decode.decoded(rows.limit(0), "data", "clean").count() == 0


def test_keyword_forms():
    raw = "## Section 1\n**English:**\nSection 1 — Keywords: \"late bill\" \"tax form\" “dunning letter” \"a, b\"\n\n- gas! (2024)\n\n## Section 2 — Answer: x"
    assert expansion.parse_keywords(raw) == ["late bill", "tax form", "dunning letter", "a b", "gas 2024"]
    assert expansion.parse_keywords("") == [] and expansion.words("_under score's x") == ["_under", "score's"]


def test_keywords():
    assert expansion.parse_keywords("Keywords: invoice, bill\n2. Rechnung\n- \"Quittung\"\n\nSection 2\nText") == ["invoice", "bill", "Rechnung", "Quittung"]
    assert len(expansion.parse_keywords(", ".join(f"word{i}" for i in range(30)))) == 12
    assert expansion.parse_hypothetical("a, b\n\nThe answer.<|END_TOKEN|>") == "The answer."
    assert expansion.expand("big question", None) == ([["big", "question"]], "", "no_endpoint")
    assert expansion.expand("invoice", expansion.dictionary_expander({"invoice": ["bill"]}))[0] == [["invoice"], ["bill"]]


def test_config():
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {}) == {"a": {"b": 3, "c": 2}}
    assert [config.coerce(x) for x in ("yes", "0", "7", "1.5", "x")] == [True, False, 7, 1.5, "x"]
    assert config.nested_set({"a": {"b": 1}}, "a.c", 2) == {"a": {"b": 1, "c": 2}}
    assert config.redacted({"api_token": "x", "n": {"password": "y", "k": 1}}) == {"api_token": "***", "n": {"password": "***", "k": 1}}


def test_strip_of_long_runs(spark):
    run = " \t\n" * 30_000
    assert one(spark, text.strip(F.lit(run + "a" + run + "b" + run))) == "a" + run + "b"
    assert one(spark, text.strip(F.lit(run))) == "" and one(spark, text.strip(F.lit(None).cast("string"))) is None
