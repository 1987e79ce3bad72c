"""Byte-level BPE: vocabulary, pretokens, exact merges, and a counting automaton with token-pair compatibility checks.

A vocabulary is read once on the driver from a rank file (a parameter), compiled, and sent to the executors as one
broadcast value; its size is bounded by the file (some MB), not by the data.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

#: The public pattern that splits text before the merges of the vocabularies here. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the rank files; every function takes another one.
TOKENIZER_DIR = "/opt/tokenizers"

_FINE = regex.compile(PATTERN)
#: A text is first cut into an optional space with the signs after it, and runs of white space. Each such cut is a cut of
#: PATTERN too: no alternative of it goes from a sign into white space, and white space is treated alike by both.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_COARSE = regex.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Chunks and words that a worker remembers, and the longest that it does.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 48

try:  # the standard library's engine is the faster one for this simple pattern
    import re

    _COARSE = re.compile(_COARSE.pattern)
except re.error:  # pragma: no cover
    pass

coarse = _COARSE.findall
fine = _FINE.findall


class Vocabulary:
    """Ranks of one byte-level BPE and the pair of tokens that each of them was merged from."""

    def __init__(self, name: str, tokens: list[bytes], left: np.ndarray, right: np.ndarray):
        self.name, self.tokens, self.left, self.right = name, tokens, left, right

    @classmethod
    def load(cls, name: str, folder: str = TOKENIZER_DIR) -> Vocabulary:
        """Reads ``<folder>/<name>.tiktoken``: a base64 token and its rank on each line, ranks from 0 up."""
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
        tokens = [t for _, t in pairs]
        if [r for r, _ in pairs] != list(range(len(pairs))):
            raise ValueError(f"{name}: ranks have gaps")
        return cls(name, tokens, *_splits(tokens))

    def __reduce__(self):
        return Vocabulary, (self.name, self.tokens, self.left, self.right)

    @property
    def ranks(self) -> dict[bytes, int]:
        made = self.__dict__.get("_ranks")
        if made is None:
            made = self.__dict__["_ranks"] = {t: i for i, t in enumerate(self.tokens)}
        return made

    def merge(self, word: bytes) -> list[int]:
        """Exact ids of one pretoken: the lowest-ranked neighbouring pair is merged first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        return _merge_short(word, ranks) if len(word) < 48 else _merge_long(word, ranks)


def _splits(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each token the two that the merges before its own make of its bytes; itself twice for a single byte."""
    ranks = {t: i for i, t in enumerate(tokens)}
    left = np.arange(len(tokens), dtype=np.int32)
    right = np.arange(len(tokens), dtype=np.int32)
    ls, rs = left.tolist(), right.tolist()
    joined: dict[tuple[int, int], int] = {}
    for i, t in enumerate(tokens):
        for k in range(1, len(t)):
            a, b = ranks.get(t[:k]), ranks.get(t[k:])
            if a is not None and b is not None and a < i and b < i and compatible(a, b, joined, ls, rs):
                ls[i], rs[i] = a, b
                joined[a, b] = i
                break
    left[:], right[:] = ls, rs
    return left, right


def compatible(a: int, b: int, joined: dict[tuple[int, int], int], left: list[int], right: list[int]) -> bool:
    """Whether tokens a and b can stand side by side in an encoding.

    They can't if, while both were still being built, some pair across their border had a lower rank than the merges
    that came after. Walks down the two inner edges, undoing the later merge first.
    """
    limit = 1 << 60
    while True:
        if joined.get((a, b), limit) < limit:
            return False
        if a > b:
            limit, inner = a, right[a]
            if inner == a:
                limit, inner = b + 1, left[b]
                if inner == b:
                    return True
                b = inner
            else:
                a = inner
        else:
            limit, inner = b + 1, left[b]
            if inner == b:
                limit, inner = a, right[a]
                if inner == a:
                    return True
                a = inner
            else:
                b = inner


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = 1 << 60, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], best)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts, in n log n."""
    n = len(word)
    end = list(range(1, n + 1))
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop or end[i] >= stop:
            continue
        j = nxt[i]
        alive[j] = 0
        end[i], nxt[i] = stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            r = ranks.get(word[i : end[nxt[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prv[i]) >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class CountingAutomaton:
    """Counts the tokens of exact encodings in linear time, without making their ids.

    An Aho-Corasick automaton over the vocabulary reports, at each byte, the tokens that end there, longest first. The
    encoding of each prefix of a word ends in exactly one token: the one that is compatible with the last token of the
    encoding of what stands before it. So one last token and one count a byte are all that is kept.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.left, self.right = vocabulary.left.tolist(), vocabulary.right.tolist()
        self.joined = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i}
        self.whole = vocabulary.ranks
        self.matcher = None
        self.known: dict[tuple[int, int], bool] = {}

    def _match(self):
        if self.matcher is None:
            self.matcher = ahocorasick.Automaton()
            for i, t in enumerate(self.vocabulary.tokens):
                self.matcher.add_word(t.decode("latin-1"), (i, len(t)))
            self.matcher.make_automaton()
        return self.matcher

    def count(self, word: bytes) -> int:
        """Tokens of one pretoken."""
        if not word:
            return 0
        if word in self.whole:
            return 1
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        known, joined, left, right = self.known, self.joined, self.left, self.right
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for end, (token, size) in self._match().iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            before = end - size
            if before:
                key = (last[before], token)
                ok = known.get(key)
                if ok is None:
                    ok = known[key] = compatible(*key, joined, left, right)
                if not ok:
                    continue
            last[end], count[end] = token, count[before] + 1
        return count[n]


class ChunkCounts(dict):
    """Tokens by chunk, counted when a chunk is first seen; holds no more than ``CACHE_ENTRIES``."""

    def __init__(self, automaton: CountingAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, chunk: str) -> int:
        count = self.automaton.count
        n = sum(count(w.encode("utf-8", "surrogatepass")) for w in fine(chunk))
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n

    def of(self, text: str | None) -> int:
        """Tokens of a text; 0 for null or empty."""
        return sum(map(self.__getitem__, coarse(text))) if text else 0


@lru_cache(maxsize=8)
def vocabulary(name: str, folder: str = TOKENIZER_DIR) -> Vocabulary:
    """The compiled vocabulary, once for each driver."""
    return Vocabulary.load(name, folder)


_LOCAL: dict = {}


def local(kind: str, vocabulary: Vocabulary, make):
    """One object of a kind and vocabulary for each worker process, kept between its tasks."""
    key = (kind, vocabulary.name, len(vocabulary.tokens))
    if key not in _LOCAL:
        _LOCAL[key] = make(vocabulary)
    return _LOCAL[key]
