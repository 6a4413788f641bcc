"""A minimal acyclic transducer from words to token ids, in one memory-mapped file.

Words are added in sorted order and finished states are merged with equal ones
at once (incremental minimisation), so common suffixes are stored once.  Every
transition carries how many words sort before those it leads to; the sum along
a word's path is its rank, which points into the flat table of ids.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_HEADER = 8


def build(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file's content for (word, ids) pairs; words must be distinct."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    # A finished state is a number; finals[n], arcs[n] = [(label, state), ...], below[n] = words from it.
    finals: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []
    below: list[int] = []

    def finish(final: bool, out: list[tuple[int, int]]) -> int:
        key = (final, tuple(out))
        known = register.get(key)
        if known is None:
            known = register[key] = len(finals)
            finals.append(final)
            arcs.append(key[1])
            below.append(int(final) + sum(below[t] for _, t in out))
        return known

    # The open path: per depth [final, arcs so far, label that leads on].
    path: list[list] = [[False, [], -1]]
    before = b""
    for word, _ in entries:
        same = 0
        for a, b in zip(before, word):
            if a != b:
                break
            same += 1
        while len(path) - 1 > same:
            final, out, _label = path.pop()
            path[-1][1].append((path[-1][2], finish(final, out)))
        for label in word[same:]:
            path[-1][2] = label
            path.append([False, [], -1])
        path[-1][0] = True
        before = word
    while len(path) > 1:
        final, out, _label = path.pop()
        path[-1][1].append((path[-1][2], finish(final, out)))
    root = finish(path[0][0], path[0][1])

    keys, targets, skips = [], [], []
    for state, out in enumerate(arcs):
        skipped = int(finals[state])
        for label, target in out:
            keys.append(state << 8 | label)
            targets.append(target)
            skips.append(skipped)
            skipped += below[target]
    lengths = [len(ids) for _, ids in entries]
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) if lengths else np.zeros(1)
    flat = np.array([i for _, ids in entries for i in ids], dtype=np.int32)
    header = np.array([len(keys), len(finals), len(entries), len(flat), root, 0, 0, 0], dtype=np.int64)
    parts = [header, np.array(keys, np.int64), offsets.astype(np.int64), np.array(targets, np.int32), np.array(skips, np.int32), flat, np.array(finals, np.uint8)]
    return b"".join(x.tobytes() for x in parts)


class Lexicon:
    """Read access to a built file; the arrays are views of the mapped file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        arcs, states, words, ids, self.root = (int(x) for x in raw[: 8 * _HEADER].view(np.int64)[:5])
        at = 8 * _HEADER
        views = []
        for count, kind in ((arcs, np.int64), (words + 1, np.int64), (arcs, np.int32), (arcs, np.int32), (ids, np.int32), (states, np.uint8)):
            size = count * np.dtype(kind).itemsize
            views.append(raw[at : at + size].view(kind))
            at += size
        self.keys, self.offsets, self.targets, self.skips, self.ids, self.finals = views

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is not in the lexicon; all words step together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state = np.full(len(words), self.root, np.int64)
        rank = np.zeros(len(words), np.int64)
        active = np.flatnonzero(sizes > 0)
        step = 0
        while len(active) and len(self.keys):
            key = state[active] << 8 | text[begin[active] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[active[~hit]] = -1
            active, arc = active[hit], arc[hit]
            state[active] = self.targets[arc]
            rank[active] += self.skips[arc]
            step += 1
            active = active[sizes[active] > step]
        if not len(self.keys):
            return np.full(len(words), -1, np.int64)
        known = (state >= 0) & (self.finals[np.maximum(state, 0)] == 1)
        return np.where(known, rank, -1)

    def outputs(self, rank: int) -> list[int]:
        """The ids of the word of that rank."""
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()
