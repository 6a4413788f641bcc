"""Properties that hold for any text."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import chunking, leakage, lexicon, mailtext, names

TEXT = st.text(alphabet=st.sampled_from(list("abc .!?\n äé🎈-:>|")), max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(20, 60), st.integers(1, 15), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, reach, overlap):
    text = text + "x" * (limit + 1)
    _, number, begin, end = chunking._pieces([1], [text], limit, reach, overlap)
    assert begin[0] == 0 and end[-1] == len(text) and number.tolist() == list(range(len(begin)))
    assert (end - begin <= limit).all() and (begin[1:] == end[:-1] - overlap).all() and (end[:-1] - begin[:-1] > limit - reach).all()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), max_size=4), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_lexicon_knows_its_words_only(tmp_path_factory, entries, others):
    path = tmp_path_factory.mktemp("l") / "l.bin"
    path.write_bytes(lexicon.build(entries.items()))
    built = lexicon.Lexicon(str(path))
    asked = [*entries, *others]
    for word, rank in zip(asked, built.find(asked).tolist()):
        assert (rank >= 0) == (word in entries) and (rank < 0 or built.outputs(rank) == entries[word])


@settings(max_examples=150, deadline=None)
@given(TEXT, st.none() | TEXT)
def test_authored_lines_are_lines_with_text(body, parent):
    lines = body.split("\n")
    got = mailtext.authored_lines(body, ["Anna Kelber"], parent)
    assert got == sorted(set(got)) and all(lines[i].strip() for i in got)
    assert not any(lines[i].lstrip().startswith(">") for i in got)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_profiles_do_not_depend_on_case_and_blanks(name):
    plain = names.profile(name)
    assert names.profile(f"  {name} ")["tokens"] == plain["tokens"] and plain["tokens"] == sorted(set(plain["tokens"]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25))
def test_a_text_tiles_itself_whole(ids):
    tiles = leakage.tile(ids, ids)
    assert len(ids) < leakage.SHORTEST or np.sum([n for *_, n in tiles]) == len(ids)
