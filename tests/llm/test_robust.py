"""Very long and odd texts: no exception, and no pattern that takes more than linear time."""

import random
import time

import pytest

from leafmill.llm import chunking, leakage, mailtext, names, shapes

N = 60_000
LONG = ["a", "a.", "a-", "- ", "<", "> ", "|", "\t", ";", " ", "a@", "x ", "a/", "&", "(", "1.", "\n", "\r\n", ". ", "é́", "[x] ", "**a**:", "a,", "schrieb ", "am 1.1.2020 ", "www.", "-\n"]
ODD = ["> ", "|", "\n", "\r\n", "Am 1.1.2020 schrieb A:", "Von: a@b", "--", "LG", "a", "Ä", "<b>", "http://x.y/z", " ", "\t", ";", ":", ",", ".", "(", "]", "🎈", "​", "\x00", "'", "PS: "]
OWN = leakage.words("In 1360 the twice-mended bell of Perutis cracked, yet the annals of Rilutgaro mention only goat leather.")
ITEM = leakage.Item(OWN, [1.0] * len(OWN))


def everything(text):
    mailtext.authored_lines(text, ["x y", "a@b"], text[:1000])
    shapes.spam_share(text)
    leakage.covered(ITEM, leakage.words(text))
    names.profile(text[:20_000])
    chunking._pieces([1], [text + "x" * 3000], 2000, 500, 200)


@pytest.mark.parametrize("part", LONG)
def test_long_texts(part):
    began = time.process_time()
    everything(part * N + ":")
    assert time.process_time() - began < 20


def test_odd_texts():
    rng = random.Random(1)
    for _ in range(400):
        everything("".join(rng.choice(ODD) for _ in range(rng.randrange(60))))
