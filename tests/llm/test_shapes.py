import pytest

from leafmill.llm import shapes as sh

SPAM = {
    "words": "wedding dresses " * 40,
    "bars": " | ".join(["led lamps", "yoga mats", "cheap flights", "led lamps"] * 12),
    "tags": "Tags: " + ", ".join(["vacuum bags 24h", "best mattress pro", "running socks neu", "phone cases red"] * 8),
    "hash": " ".join(["#LedLampen", "#YogaMatten", "#TierFutter"] * 15),
    "links": "\n".join(f"* https://shop{i}.example/yoga-mats" for i in range(20)),
    "markdown links": "\n".join(f"[Yogamatten](http://shop{i}.test/?p={i})" for i in range(20)),
    "anchors": "<br>".join(f'<a href="http://shop{i}.test/x">matelas promo</a>' for i in range(20)),
    "labels": "\n".join(f"Fotokisten {s} https://x.example/p{i}" for i, s in enumerate(["|", "->", "::", "·"] * 5)),
    "breadcrumbs": "\n".join(f"Index > LED Lampen > Torilor{i} ({i})" for i in range(20)),
    "names": "\n".join(f"Kredit ohne Auskunft Stadt{chr(97 + i)}" for i in range(20)),
    "sentences of keywords": " ".join(f"Kids bikes {w} pet food offers Stad{chr(97 + i)}." for i, w in enumerate(["in", "top", "with", "and"] * 5)),
}
GOOD = {
    "prose": "The committee forwarded the old diaries on the way home, and nobody noticed. We filed the recipe cards before the deadline. " * 5,
    "german": "Etwa 13 Seiten wurden im zweiten Stock verschoben. Niemand weiß, warum das Kochbuch im Keller gelandet ist. " * 5,
    "paths": "\n".join(f"/a/b{i}/File_{i}-x.tar.gz" for i in range(30)),
    "log": "\n".join(f"11:44:{i:02} WARN unit[{i}]: nothing was found under the stairs" for i in range(30)),
    "table": "| Pos | Artikel | Menge |\n|---|---|---|\n" + "\n".join(f"| {i} | Stuhl {i} | {i * 3} |" for i in range(20)),
    "checklist": "\n".join(f"- [ ] Call the museum about box {i}" for i in range(20)),
    "chat": "\n".join(f"[08:{i:02}] Anna: Is it true that the box is empty? <!-- key_id: AB{i} -->" for i in range(20)),
    "sources": "\n".join(f"[{i}] Kelber, The {a} under the {b} is empty and nobody knows why. (19{i}0). https://x.example/a{i}" for i, (a, b) in enumerate([("box", "stairs"), ("diary", "bridge"), ("folder", "counter"), ("scan", "window")])),
    "described links": "\n".join(f"- https://x.example/a{i}: The committee has forwarded the diaries, so we should wait for the copy." for i in range(9)),
    "code": "```\n" + "\n".join(f"value{i} = other{i}(3{i})" for i in range(30)) + "\n```",
    "marked up": "No <b>ferryman</b> entered <b>the</b> guild of Karessom - p. 12 - in 1495, without <b>the</b> consent of [3] Dreaschgaro the founder. " * 4,
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    share, few = sh.spam_share(SPAM[name])
    assert share > sh.MOST and few >= sh.DOMINANT


@pytest.mark.parametrize("name", GOOD)
def test_no_spam(name):
    assert sh.spam_share(GOOD[name])[0] <= 0.4


def test_half_and_half():
    half = SPAM["words"]
    assert sh.spam_share(half + "\n" + GOOD["prose"][: len(half) // 3])[0] > sh.MOST
    assert sh.spam_share(half + "\n" + GOOD["prose"] * 3)[0] < sh.MOST


def test_shapes_do_not_depend_on_words():
    assert sh.reduce_unit("/a/b/c.txt", set()) == sh.reduce_unit("/x/yy/z.pdf", set())
    assert sh.reduce_unit("Call Anna now.", set()) == sh.reduce_unit("Ask Berta soon.", set())


def test_table_and_edges(spark):
    rows = [(1, SPAM["words"], "s"), (1, SPAM["words"], "s"), (2, GOOD["prose"], "s"), (3, None, "s"), (4, "", "s"), (5, " \n ", "s"), (6, SPAM["bars"] * 300, "s"), (7, "-", "s")]
    df = spark.createDataFrame(rows, "k long, t string, share string")
    assert sorted(r.k for r in sh.spam_pages(df, "k", "t").collect()) == [1, 1, 6]
    assert sh.spam_pages(df.limit(0), "k", "t").count() == 0


@pytest.mark.parametrize("n", [4, 12, 60, 900])
def test_separators_count_at_any_length(n):
    line = " \t".join(f"{a} {b}" for a, b in zip(["led lamps", "yoga mats", "cheap flights", "phone cases"] * n, ["neu", "top", "pro", "red"] * n))
    assert sh.reduce_unit(line, set()).kind == "phrases"


def test_many_keywords_that_are_all_repeated():
    words = [f"{a}{b}{c}" for a in ("lam", "mat", "flug", "kred", "haus") for b in ("pen", "ten", "gut", "ito", "rat") for c in ("neu", "top", "pro", "fix", "max")]
    assert sh.spam_share("\n".join(words * 4))[0] > sh.MOST
    # Running text has rare words at any length.
    assert sh.spam_share(GOOD["prose"] + "\n".join(words))[0] < sh.MOST


def test_long_tags_are_no_words():
    tag = '<a data-x="' + "yoga " * 200 + '" href="https://x.example/a">'
    assert sh.read_unit(tag + "Matten</a>").words == ["matten"]
