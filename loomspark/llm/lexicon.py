"""A lexicon of frequent words as a minimal acyclic transducer, laid out flat so that it can be mapped into memory.

Words are added in byte order; states with equal ways out are one state, so common endings are shared. Each edge knows
how many words come before those through it, which numbers the words without storing them; a word's number leads to its
ids in one flat list.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable

import numpy as np

_MAGIC = b"LOOMLEX1"
_HEAD = struct.Struct("<8s5q")


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a lexicon of (word, ids) pairs; of repeated words the last holds."""
    pairs = sorted(dict(entries).items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # [final, [(label, target)]] of the states on the last word
    last = b""
    for word, _ in pairs:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            done = settle(path.pop())
            path[-1][1].append((last[depth - 1], done))
        for _ in range(same, len(word)):
            path.append([False, []])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        done = settle(path.pop())
        path[-1][1].append((last[depth - 1], done))
    root = settle(path.pop())

    words = [0] * len(states)  # words from each state on; targets are always settled before
    starts, labels, targets, skips = [0], bytearray(), [], []
    for i, (final, edges) in enumerate(states):
        n = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(n)
            n += words[target]
        words[i] = n
        starts.append(len(targets))
    outs = [0]
    ids: list[int] = []
    for _, made in pairs:
        ids += made
        outs.append(len(ids))
    finals = bytes(int(f) for f, _ in states)
    head = _HEAD.pack(_MAGIC, len(states), len(targets), len(pairs), len(ids), root)
    parts = [head, np.asarray(starts, "<i4").tobytes(), np.asarray(targets, "<i4").tobytes(), np.asarray(skips, "<i4").tobytes(), np.asarray(outs, "<i4").tobytes(), np.asarray(ids, "<i4").tobytes(), finals, bytes(labels)]
    return b"".join(parts)


class Lexicon:
    """Looks words up in a mapped lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n_states, n_edges, self.size, n_ids, self.root = _HEAD.unpack_from(self.map, 0)
        if magic != _MAGIC:
            raise ValueError("not a lexicon")
        at = _HEAD.size
        views = []
        for n in (n_states + 1, n_edges, n_edges, self.size + 1, n_ids):
            views.append(memoryview(self.map)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.starts, self.targets, self.skips, self.outs, self.ids = views
        self.finals_at, self.labels_at = at, at + n_states

    def get(self, word: bytes) -> list[int] | None:
        """Ids of a word, or None if the lexicon doesn't hold it."""
        find, starts, at = self.map.find, self.starts, self.labels_at
        state, number = self.root, 0
        for i in range(len(word)):
            edge = find(word[i : i + 1], at + starts[state], at + starts[state + 1]) - at
            if edge < 0:
                return None
            number += self.skips[edge]
            state = self.targets[edge]
        if not self.map[self.finals_at + state]:
            return None
        return self.ids[self.outs[number] : self.outs[number + 1]].tolist()
