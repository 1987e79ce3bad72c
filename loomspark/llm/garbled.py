"""Text that was read in another encoding than it was written in: finding the records and restoring them.

Each record has a latent chain: none, or the pair (read as, written in), perhaps applied twice. The evidence of one record
may be weak, a single word; so chains are estimated by expectation-maximisation over all records. A character model of
the corpus says how likely a stretch is as it stands and as each chain would have it; sources (the first segment of the
path) and the record's flag share what has been seen in other records; and the posterior decides which records are
affected and which chain repairs them.

All passes run over all rows. What goes to the driver is the character model, whose size is a parameter, once for each of
a fixed number of groups of sources, and the chain weights over all sources; the weights by source stay in the cluster.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.bpe import _LOCAL
from loomspark.session import cut_lineage, spread

#: Buckets of the character pairs; the model has so many counts whatever the corpus.
PAIR_BUCKETS = 1 << 20
#: Most rounds of expectation and maximisation over the chain weights, rounds of the character model, and the change of
#: a weight below which the rounds end.
ROUNDS, MODEL_ROUNDS, SETTLED = 6, 2, 1e-5
#: Mean log probability of sound text; least log odds of a stretch that starts a search in its neighbours, of one whose
#: bytes decode as UTF-8, and most that one stretch gives; log odds against any one chain to start from, and most that they grow to in the rounds.
SOUND, LEAST_SEED, LEAST_PROOF, MOST_GAIN, SWITCH, MOST_AGAINST = -5.2, 4.0, 2.0, 16.0, 4.5, 6.0
#: Posterior from which a record counts as affected.
DECIDED = 0.7
#: Mean count of the pairs of a stretch that counts as common.
OFTEN = 5.0
#: Records that a source's weights are shrunk towards all sources by.
SHRINK = 20.0
#: Groups that sources are hashed into; a stretch that stands mostly in its own group is also judged by the counts of the rest.
GROUPS = 8

#: Encodings that text is read in or written in by mistake.
SINGLE_READERS = ("cp1252", "latin_1", "cp437", "cp850", "cp866", "cp1251", "koi8_r", "mac_roman", "iso8859_7", "cp1253", "cp1250", "iso8859_2", "iso8859_5", "mac_cyrillic", "cp1254", "iso8859_15", "cp1255", "cp1256")
DOUBLE_READERS = ("gbk", "cp932", "cp949", "big5", "euc_jp")
WIDE_READERS = ("utf_16_le", "utf_16_be")
CYRILLIC, WESTERN = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5"), ("cp1252", "cp850", "cp437", "mac_roman")
READERS_OF = {
    **{w: ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", *CYRILLIC, *DOUBLE_READERS) for w in CYRILLIC},
    **{w: ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp866", "cp1251", "koi8_r", "iso8859_7", "cp1253", "cp1250", "iso8859_2", "iso8859_5", *DOUBLE_READERS) for w in WESTERN},
    **{w: ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", *DOUBLE_READERS) for w in DOUBLE_READERS},
    "iso8859_7": ("cp1252", "latin_1", "cp437", "cp850", "cp1251"),
    "cp1250": ("cp1252", "latin_1", "cp437", "cp850", "cp1251", "iso8859_2"),
    "iso8859_2": ("cp1252", "latin_1", "cp437", "cp850", "cp1251", "cp1250"),
    "cp852": ("cp1252", "latin_1", "cp437", "cp850", "cp1250", "iso8859_2"),
}
#: Pairs that agree on nearly all letters, so that one read as the other is no damage to speak of.
ALIKE = {frozenset(p) for p in (("latin_1", "iso8859_15"), ("iso8859_7", "cp1253"))}
LOST = "lost"

#: Letters of two alphabets in one word, or a lone ideograph in a Latin one: no text of either.
_MIXED = re.compile(r"[A-Za-z\xc0-\u024f][\u0370-\u052f\u0590-\u06ff]|[\u0370-\u052f\u0590-\u06ff][A-Za-z\xc0-\u024f]|[A-Za-z][\u2e80-\ud7af\uff66-\uff9d][a-z]|^[A-Za-z.\-]*[\u2e80-\ud7af\uff66-\uff9d][a-z]*$")
_LATIN = re.compile(r"[\x20-\x7e\xa0-\u024f\u2010-\u2026]*")
_C1 = re.compile("[\x80-\x9f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_TYPED = "‘’‚“”„–—…•"
_SPACES = re.compile(r"[^ \t\r\n\f\v]+")
_UTF7 = re.compile(r"\+[A-Za-z0-9+/]{2,}-")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,5}|#x[0-9A-Fa-f]{2,4});")
_WORTH = re.compile(r"[^\x00-\x7f]|&[A-Za-z#]|\+A|\?")
_QUOTED = re.compile(r"^[(\[]?[\"'`„“”‚‘’«»「『]+[^\"`„“”«»「『」』]*[\"'`“”’‘»«」』]+[)\].,;:!?…。，、]*$")
_LOST_LETTER = re.compile(r"[^\W\d_]\?[^\W\d_]")
_CODE = re.compile(r"[/=&:\\(){}\[\]<>|$*+^_]|\.\w")
_TREE = re.compile(r"^[ \t?]*\?{2,}[ \t]+[\w.]+", re.M)


def _encoder(name: str):
    """Strict encoding; a byte that the code page leaves undefined stands for the control sign of that number."""
    if name in DOUBLE_READERS or name in WIDE_READERS:
        return lambda s: s.encode(name)
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(ord(c), b)
    return lambda s: codecs.charmap_encode(s, "strict", table)[0]


_ENCODERS = {r: _encoder(r) for r in (*SINGLE_READERS, *DOUBLE_READERS, *WIDE_READERS)}
#: Bytes as written in UTF-8 hold their own proof, as few other byte strings decode in it; others are tried on odd text only.
CHAINS_UTF8 = tuple((r, "utf_8") for r in _ENCODERS)
CHAINS_OTHER = tuple((r, w) for w, rs in READERS_OF.items() for r in rs if r != w and frozenset((r, w)) not in ALIKE)
CHAINS = (*CHAINS_UTF8, *CHAINS_OTHER, ("ascii", "utf_7"))
_BY_READER = {r: [(k, w) for k, (q, w) in enumerate(CHAINS[:-1]) if q == r] for r in _ENCODERS}
_N8, _UTF7_CHAIN = len(CHAINS_UTF8), len(CHAINS) - 1
_WIDE = {k for k, (r, _) in enumerate(CHAINS_UTF8) if r in WIDE_READERS}


def _utf8_runs(reader: str) -> re.Pattern:
    """Signs whose bytes, in a reader of one byte a sign, are characters of UTF-8 outside ASCII."""
    signs = [[] for _ in range(256)]
    for c in map(chr, (*range(0x80, 0x2600), *range(0xF8FF, 0xF900), *range(0xFB00, 0xFB07))):
        try:
            signs[_ENCODERS[reader](c)[0]].append(re.escape(c))
        except UnicodeError:
            continue
    of = lambda a, b: "[" + "".join(x for y in signs[a : b + 1] for x in y) + "]"
    more = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})+")


#: Least bytes that two bytes a sign must have hidden to be told from ideographs.
WIDE_BYTES = 8
#: Log odds that each such sign gives, whatever the counts say, as such text is common where it occurs at all; least mean
#: log probability of what it was.
WIDE_GAIN, SOUND_ASCII = 1.1, -4.2
#: By chain. Signs of two ASCII bytes, in a row that ideographs hardly ever form.
_UTF8_RUNS = {k: _utf8_runs(r) for k, r in enumerate(SINGLE_READERS)}
_UTF8_RUNS |= {k: re.compile("[" + "".join(f"{chr(h << 8 | 0x20)}-{chr(h << 8 | 0x7E)}{chr(h << 8 | 10)}" for h in (10, *range(0x20, 0x7F))) + "]{6,}") for k in _WIDE}
#: Runs of one script; signs that belong to none stand with the Latin ones, as wrong readings hold them.
_SCRIPT = re.compile(r"[\u0370-\u03ff]+|[\u0400-\u052f]+|[\u0530-\u08ff]+|[\u0900-\u1dff]+|[\u2e80-\ud7af\uf900-\ufaff\ufe30-\uffef]+|[\U00020000-\U0003ffff]+|[\x80-\u036f\u1e00-\u2e7f\ud7b0-\uf8ff\ufb00-\ufe2f\ufff0-\U0001ffff]+")


def _compat(c: str) -> bool:
    """Whether a letter is a ligature or other presentation form, which nobody types."""
    return c > "\x7f" and c.isalpha() and unicodedata.decomposition(c).startswith("<compat>")


def undo(text: str, chain: tuple[str, str]) -> str | None:
    """The text as it was written, if every sign of it can have come about by the chain."""
    reader, writer = chain
    try:
        made = _ENCODERS[reader](text).decode(writer)
    except (UnicodeError, ValueError):
        return None
    return made if made != text else None


class CharModel:
    """Log probabilities of each character after the one before, from hashed pair counts and single counts."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray):
        self.pairs, self.singles = pairs.astype(np.float64), singles.astype(np.float64)
        self.total = max(1.0, float(self.singles.sum()))
        self.share = (self.singles + 0.02) / (self.total + 0.02 * len(singles))

    @staticmethod
    def points(text: str) -> np.ndarray:
        """Code points, with digits alike and the rest of the planes folded into the first."""
        p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        p = np.where((p >= 48) & (p <= 57), 48, p)
        return np.where(p > 0xFFFF, 0xE000 + (p & 0x3FF), p).astype(np.int64)

    @staticmethod
    def bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair's count."""
        return ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B + (a >> 5))) % 1_048_573 % PAIR_BUCKETS

    def each(self, points: np.ndarray) -> np.ndarray:
        """Of every character but the first."""
        a, b = points[:-1], points[1:]
        return np.log((self.pairs[self.bucket(a, b)] + 3.0 * self.share[b]) / (self.singles[a] + 3.0))

    def score(self, text: str) -> tuple[float, float]:
        """Sum over a stretch between blanks, and the mean over the places where a sign outside ASCII stands."""
        p = self.points(f" {text} ")
        each = self.each(p)
        touched = (p[1:] > 127) | (p[:-1] > 127)
        return float(each.sum()), float(each[touched].mean()) if touched.any() else float(each.mean())


def _is_lost(text: str, truncated: bool | None) -> int:
    """Replacement characters that stand for something lost, not shown as an example or left by a cut at the end."""
    n = 0
    for m in re.finditer("�+", text):
        if m.end() == len(text) and len(m.group()) == 1 and truncated:
            continue
        after, before = text[m.end() : m.end() + 12], text[max(0, m.start() - 2) : m.start()]
        if len(m.group()) <= 3 and (re.match(r"[\"'”’)»]?\s*[(\[]?\s*(U\+|0x)?FFFD", after) or (before[-1:] in "\"'`“„«(" and before and after[:1] in "\"'`”“»)" and after)):
            continue
        n += len(m.group())
    return n


class Finder:
    """Tries chains on the stretches of a text, and adds up what neighbours say; remembers stretches it has seen.

    A source that is garbled throughout makes its signs common, so that they pass for sound. ``parts`` are the counts by
    group of sources: stretches that would be rare without their own group are judged by the counts of the others too.
    """

    def __init__(self, model: CharModel, parts: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.model, self.parts = model, parts or {}
        self.seen: dict[str, dict[int, tuple[float, str]]] = {}
        self.runs: dict[str, dict[int, tuple[float, str]]] = {}
        self.proofs: dict[tuple[str, int | None], bool] = {}
        self.elsewhere: dict[tuple[str, int], dict[int, tuple[float, str]]] = {}
        self.said: dict[tuple[str, int | None], tuple[dict[int, float], dict[int, float], frozenset[int]]] = {}
        self.rests: dict[int, Finder] = {}

    def _rest(self, group: int) -> Finder:
        """By the counts of all groups but one."""
        if group not in self.rests:
            pairs, singles = self.parts[group]
            self.rests[group] = Finder(CharModel(np.maximum(self.model.pairs - pairs, 0), np.maximum(self.model.singles - singles, 0)))
        return self.rests[group]

    def _own(self, word: str, group: int) -> bool:
        """Whether the signs of a stretch stand in this order mostly in its own group."""
        p = self.model.points(f" {word} ")
        at = self.model.bucket(p[:-1], p[1:])[(p[1:] > 127) | (p[:-1] > 127)]
        if not len(at):
            return False
        every = self.model.pairs[at]
        return bool(np.log((np.maximum(every - self.parts[group][0][at], 0) + 0.1) / (every + 0.1)).mean() < np.log(0.5))

    def _common(self, word: str) -> bool:
        """Whether a stretch is of signs that were seen in this order, and are usual in it."""
        p = self.model.points(f" {word} ")
        touched = (p[1:] > 127) | (p[:-1] > 127)
        if not touched.any():
            touched[:] = True
        return bool(self.model.each(p)[touched].mean() > -3.5 and np.log(self.model.pairs[self.model.bucket(p[:-1], p[1:])[touched]] + 0.1).mean() > np.log(OFTEN))

    def word_of(self, word: str, group: int | None) -> dict[int, tuple[float, str]]:
        """``word``, with what the counts of the other groups say of a stretch that stands mostly in its own, where those of
        all give no clear evidence."""
        got = self.word(word)
        if group not in self.parts or word.isascii():
            return got
        key = (word, group)
        merged = self.elsewhere.get(key)
        if merged is None:
            merged = got
            if max((g for g, _ in got.values()), default=0.0) < LEAST_SEED and self._own(word, group):
                rest = self._rest(group)
                more = {k: x for k, x in rest.word(word).items() if x[0] > max(0.0, got.get(k, (0.0,))[0]) and rest._common(x[1])}
                merged = got | more
            if len(word) <= 64:
                if len(self.elsewhere) > 100_000:
                    self.elsewhere.clear()
                self.elsewhere[key] = merged
        return merged

    def _scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``CharModel.score`` of many stretches at once."""
        p = self.model.points(" " + " ".join(words) + " ")
        each = self.model.each(p)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = ends - [len(w) + 1 for w in words]
        touched = (p[1:] > 127) | (p[:-1] > 127)
        sums = np.add.reduceat(each, starts)
        n = np.add.reduceat(touched.astype(np.float64), starts)
        return sums, np.where(n > 0, np.add.reduceat(each * touched, starts) / np.maximum(n, 1), sums / (ends - starts))

    def _calm(self, word: str) -> bool:
        """Whether a stretch is of common signs in common order; then only chains that prove themselves are tried."""
        p = self.model.points(f" {word} ")
        foreign = p[p > 127]
        touched = (p[1:] > 127) | (p[:-1] > 127)
        if not len(foreign) or self.model.each(p)[touched].mean() <= -3.5:
            return False
        seen = self.model.pairs[self.model.bucket(p[:-1], p[1:])[touched]]
        return bool(np.log((seen + 0.1) / self.model.total).mean() > -10.0)

    def _try(self, word: str, depth: int = 0) -> dict[int, tuple[float, str]]:
        """Log odds of every chain that can have led to a stretch, and what it was."""
        made: dict[int, str] = {}
        calm = self._calm(word)
        for reader, chains in _BY_READER.items():
            try:
                raw = _ENCODERS[reader](word)
            except (UnicodeError, ValueError):
                continue
            for k, writer in chains:
                if calm and k >= _N8:
                    continue
                try:
                    text = raw.decode(writer)
                except (UnicodeError, ValueError):
                    continue
                if text != word and not (k >= _N8 and any(c < " " or "\x7f" <= c < "\xa0" for c in text)):
                    if k in _WIDE and (len(raw) < WIDE_BYTES or any(c < " " and c not in "\t\n\r" for c in text)):
                        continue
                    made[k] = text
        if not made:
            return {}
        texts = list(dict.fromkeys(made.values()))
        sums, means = self._scores([word, *texts])
        value = {t: (float(s - sums[0]), float(m)) for t, s, m in zip(texts, sums[1:], means[1:])}
        foreign = sum(c > "\x7f" for c in word)
        controls = 5.0 if _C1.search(word) else 0.0
        out = {}
        for k, text in made.items():
            gain, mean = value[text]
            if k < _N8:
                if depth == 0 and not text.isascii():
                    deeper = [(g, t) for j, (g, t) in self._try(text, 1).items() if j < _N8 and g > 0]
                    if deeper:
                        more, text = max(deeper)
                        gain, mean = gain + more, 0.0
                if k in _WIDE and mean > SOUND_ASCII:  # of three ideographs at most one is of two ASCII bytes, in a row each speaks
                    gain = max(gain, foreign * WIDE_GAIN)
                elif mean <= SOUND:  # a rare word of a Latin alphabet may still be what it was
                    gain = min(gain, 4.5 if CHAINS[k][0] in SINGLE_READERS and _LATIN.fullmatch(text) else 0.0)
            else:
                letters = sum(c.isalpha() for c in text if c > "\x7f")
                if gain > 0 and not letters and len(text) == len(word) and all(c in _TYPED for c in text if c > "\x7f") and self._common(text):
                    pass  # marks that are usual in this place
                elif gain > 0 and (mean <= SOUND or _MIXED.search(text) or any(map(_compat, text)) or (foreign > 1 and letters < 2) or 3 * letters < 2 * sum(c > "\x7f" for c in text) or (foreign == 1 and len(word) < 3)):
                    gain = 0.0
                elif controls:
                    gain += controls
            if controls and CHAINS[k] == ("latin_1", "cp1252") and not _C1.search(text):
                gain = max(gain, controls + SWITCH)
            out[k] = (max(-MOST_GAIN, min(gain, MOST_GAIN, 8.0 + 3.0 * foreign)), text)
        return out

    def _better(self, word: str, whole: str) -> bool:
        """Whether a stretch is likelier with a part of it undone, among the signs that stay."""
        sums, _ = self._scores([word, whole])
        return bool(sums[1] - sums[0] >= LEAST_PROOF) and not _MIXED.search(whole)

    def _run(self, run: str) -> dict[int, tuple[float, str]]:
        """``_try`` of a part of a stretch, remembered."""
        got = self.runs.get(run)
        if got is None:
            got = self._try(run)
            if len(run) <= 64:
                if len(self.runs) > 100_000:
                    self.runs.clear()
                self.runs[run] = got
        return got

    def word(self, word: str) -> dict[int, tuple[float, str]]:
        """``_try`` of a stretch as it stands, of its entities, its UTF-7 escapes, or of the runs outside ASCII in it."""
        got = self.seen.get(word)
        if got is not None:
            return got
        got = self._try(word) if not word.isascii() else {}
        if _ENTITY.search(word):
            plain = html.unescape(word)
            if not plain.isascii():
                got |= {k: x for k, x in self._try(plain).items() if k < _N8 and x[0] > 0}
        if not got and _UTF7.search(word):
            try:
                plain = _UTF7.sub(lambda m: m.group().encode().decode("utf-7"), word)
            except UnicodeError:
                plain = word
            if plain != word and not plain.isascii() and all(c.isalpha() or c in "–—’“”" for c in plain if c > "\x7f") and self._scores([plain])[1][0] > SOUND:
                got = {_UTF7_CHAIN: (6.0, plain)}
        if not word.isascii() and max((g for g, _ in got.values()), default=0.0) < LEAST_SEED:
            for k, utf8 in _UTF8_RUNS.items():
                gains: list[float] = []

                def undone(m: re.Match) -> str:
                    g, text = self._run(m.group()).get(k, (0.0, ""))
                    gains.append(g)
                    return text if g >= LEAST_PROOF else m.group()

                whole = utf8.sub(undone, word)
                if whole != word and (k in _WIDE or self._better(word, whole)) and (g := min(MOST_GAIN, sum(x for x in gains if x >= LEAST_PROOF))) > got.get(k, (0.0,))[0]:
                    got[k] = (g, whole)
            runs = set(_RUN.findall(word))
            calm = self._calm(word)
            for run in runs.union(*(_SCRIPT.findall(x) for x in runs)):
                if run != word and len(run) > 1:
                    for k, (g, text) in self._run(run).items():
                        whole = word.replace(run, text)
                        if (calm or run not in runs) and g >= LEAST_PROOF and not self._better(word, whole):
                            continue
                        if g >= (LEAST_PROOF if k < _N8 else 2 * LEAST_SEED) and g > got.get(k, (0.0,))[0] and (k < _N8 or not _MIXED.search(whole)):
                            got[k] = (g, whole)
        if len(word) <= 64:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def proven(self, word: str, group: int | None = None) -> bool:
        """Whether the bytes of a stretch decode as UTF-8 to something likelier; without the other chains."""
        got = self.proofs.get((word, group))
        if got is None:
            made = []
            for reader in _ENCODERS:
                try:
                    made.append(_ENCODERS[reader](word).decode("utf-8"))
                except (UnicodeError, ValueError):
                    continue
            got = False
            if any(m != word for m in made) or any(x.search(word) for x in _UTF8_RUNS.values()):
                got = any(g >= LEAST_PROOF for k, (g, _) in self.word_of(word, group).items() if k < _N8)
            if len(word) <= 64:
                if len(self.proofs) > 100_000:
                    self.proofs.clear()
                self.proofs[word, group] = got
        return got

    def _said(self, word: str, group: int | None) -> tuple[dict[int, float], dict[int, float], frozenset[int]]:
        """Log odds of the chains of a stretch where it comes first and where it comes again, and the chains it speaks
        for clearly; nothing of what stands in quotes."""
        got = self.said.get((word, group))
        if got is None:
            odds = {} if _QUOTED.match(word) else {k: g for k, (g, _) in self.word_of(word, group).items()}
            clear = frozenset(k for k, g in odds.items() if g >= (LEAST_PROOF if k < _N8 or k == _UTF7_CHAIN else LEAST_SEED))
            got = odds, {k: g if g >= LEAST_SEED else min(g, 0.0) for k, g in odds.items()}, clear
            if len(word) <= 64:
                if len(self.said) > 100_000:
                    self.said.clear()
                self.said[word, group] = got
        return got

    def text(self, text: str, truncated: bool | None, group: int | None = None) -> dict[int, float]:
        """Log odds of each chain over a whole text; -1 stands for signs that are lost.

        A chain that one stretch speaks for clearly is taken up, with all that others say, however weak; without that, rows
        that are alike would take each other for garbled. Its odds are those of its best unbroken run of stretches, in
        which those that it would spoil count against it; that its bytes decode as UTF-8 counts too; stretches given as
        examples, in quotes, count nothing, and those said before only what they say clearly.
        """
        sums: dict[int, float] = {}
        if n := _is_lost(text, truncated):
            sums[-1] = 8.0 + min(n, 50) * 0.1
        if "?" in text:
            n = 0
            if _LOST_LETTER.search(text):
                n = sum(1 for w in _SPACES.findall(text) if "?" in w and _LOST_LETTER.search(w) and not _CODE.search(w) and not _QUOTED.match(w))
            n += 2 * len(_TREE.findall(text)) if "??" in text else 0
            if n:
                sums[-1] = sums.get(-1, 0.0) + 2.5 * n
        if not _WORTH.search(text):
            return sums
        row, seeds, before = [], set(), set()
        for line in text.split("\n"):
            if not line.isascii() or "&" in line or "+A" in line:
                for word in _SPACES.findall(line):
                    if word.isascii() and "&" not in word and "+A" not in word:
                        continue
                    got, again, clear = self._said(word, group)
                    row.append(again if word in before else got)  # says nothing new where it says little
                    before.add(word)
                    seeds |= clear
        for k in seeds:
            proof = k < _N8 or k == _UTF7_CHAIN
            best = run = 0.0
            for got in row:
                run += got.get(k, 0.0 if proof else -0.5)
                if run < 0.0:
                    run = 0.0
                elif run > best:
                    best = run
            if best > 0:
                sums[k] = best + (3.0 if proof else 0.0)
        return sums

    def _repaired(self, word: str, chain: int, group: int | None) -> str | None:
        """What a stretch was, if it speaks for the record's chain, or clearly for one of its own."""
        if word.isascii() and "&" not in word and "+A" not in word or _QUOTED.match(word):
            return None
        got = self.word_of(word, group)
        if chain in got and got[chain][0] > 0:
            return got[chain][1]
        best = max(((g, t) for k, (g, t) in got.items() if g >= (LEAST_PROOF if k < _N8 or k == _UTF7_CHAIN else 2 * LEAST_SEED)), default=None)
        return best[1] if best else None

    def repair(self, text: str, chain: int, group: int | None = None) -> str:
        """The text with every stretch undone that speaks for a chain, and with those next to it that the same chain of
        the record can undo and that don't speak against it, like single letters."""
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if line.isascii() and "&" not in line and "+A" not in line:
                continue
            spans = [m for m in _SPACES.finditer(line) if not m.group().isascii() or "&" in m.group() or "+A" in m.group()]
            made = [self._repaired(m.group(), chain, group) for m in spans]
            if _N8 <= chain < _UTF7_CHAIN:
                for j in (*range(len(spans)), *reversed(range(len(spans)))):
                    word = spans[j].group()
                    if made[j] is None and not _QUOTED.match(word) and any(made[n] is not None for n in (j - 1, j + 1) if 0 <= n < len(made)):
                        got = self.word_of(word, group).get(chain)
                        if got is None or got[0] > -2.0:
                            made[j] = undo(word, CHAINS[chain])
            for m, now in reversed(list(zip(spans, made))):
                if now is not None:
                    line = line[: m.start()] + now + line[m.end() :]
            lines[i] = line
        return "\n".join(lines)


def chain_name(k: int) -> str:
    """A chain by its number."""
    return LOST if k < 0 else f"{CHAINS[k][1]} read as {CHAINS[k][0]}"


# -- the character model -----------------------------------------------------------------------------------------------

_COUNTS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("slot", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch], finder_of=None) -> Iterator[pa.RecordBatch]:
    counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    finder = finder_of() if finder_of else None
    held: dict[int, list[str]] = {}
    chars: dict[int, int] = {}

    def add(part: int) -> None:
        p = CharModel.points(" " + "\n ".join(held.pop(part)) + " ")
        pairs, singles = counts.setdefault(part, (np.zeros(PAIR_BUCKETS, np.int64), np.zeros(1 << 16, np.int64)))
        pairs += np.bincount(CharModel.bucket(p[:-1], p[1:]), minlength=PAIR_BUCKETS)
        singles += np.bincount(p, minlength=1 << 16)
        chars[part] = 0

    for batch in batches:
        for text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            lines = [x for x in text.split("\n") if x and "�" not in x] if "�" in text or not text.isascii() else [text]
            if finder is not None and not text.isascii():
                lines = [x if x.isascii() else " ".join(w for w in _SPACES.findall(x) if w.isascii() or not finder.proven(w, part)) for x in lines]
            held.setdefault(part, []).extend(lines)
            chars[part] = chars.get(part, 0) + len(text)
            if chars[part] > 1_000_000:
                add(part)
    for part in list(held):
        add(part)
    for part, both in counts.items():
        for kind, n in enumerate(both):
            at = np.flatnonzero(n)
            for i in range(0, len(at), 100_000):
                s = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), kind, np.int32)), pa.array(np.full(len(s), part, np.int32)), pa.array(s.astype(np.int32)), pa.array(n[s])], schema=_COUNTS)


#: Counts that are not nought, by group: slots and numbers of the pairs and of the singles.
Counts = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _char_counts(texts: DataFrame, finder_of=None) -> Counts:
    """From ``content, part``."""
    got = texts.mapInArrow(lambda it: _count(it, finder_of), "kind int, part int, slot int, n bigint").groupBy("kind", "part", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, part, slot, n = (got.column(c).to_numpy() for c in ("kind", "part", "slot", "n"))
    of = lambda k, g: (slot[(kind == k) & (part == g)], n[(kind == k) & (part == g)].astype(np.float32))
    return {int(g): (*of(0, g), *of(1, g)) for g in np.unique(part)}


def _finder(counts: Counts) -> Finder:
    parts = {}
    total_pairs, total_singles = np.zeros(PAIR_BUCKETS), np.zeros(1 << 16)
    for group, (pair, n_pair, single, n_single) in counts.items():
        pairs, singles = np.zeros(PAIR_BUCKETS, np.float32), np.zeros(1 << 16, np.float32)
        pairs[pair], singles[single] = n_pair, n_single
        total_pairs += pairs
        total_singles += singles
        parts[group] = (pairs, singles)
    return Finder(CharModel(total_pairs, total_singles), parts if len(parts) > 1 else None)


def _finder_of(spark: SparkSession, counts: Counts):
    shared = spark.sparkContext.broadcast(counts)
    key = ("finder", id(shared), np.random.default_rng().integers(1 << 62))

    def get() -> Finder:
        if key not in _LOCAL:
            for k in [k for k in _LOCAL if k[0] == "finder"]:
                del _LOCAL[k]
            _LOCAL[key] = _finder(shared.value)
        return _LOCAL[key]

    return get


# -- expectation-maximisation ------------------------------------------------------------------------------------------


def source_of(path):
    """The first segment of a path; ``none`` if there is none."""
    first = F.regexp_extract(F.coalesce(path, F.lit("")), r"^[\s./\\]*([^/\\]+)", 1)
    return F.when(first == "", F.lit("none")).otherwise(first)


def part_of(path):
    """The group that the source of a path falls into."""
    return F.pmod(F.xxhash64(source_of(path)), F.lit(GROUPS)).cast("int")


def _evidence(files: DataFrame, finder_of) -> DataFrame:
    """``row, file_id, source, flag, chains``: log odds of each chain of each record that has any."""

    @F.arrow_udf("array<struct<k:int,gain:double>>")
    def gains(content: pa.Array, truncated: pa.Array, part: pa.Array) -> pa.Array:
        finder = finder_of()
        return pa.array(
            [[{"k": k, "gain": float(g)} for k, g in finder.text(t, cut, g0).items()] if t else [] for t, cut, g0 in zip(content.to_pylist(), truncated.to_pylist(), part.to_pylist())],
            pa.list_(pa.struct([("k", pa.int32()), ("gain", pa.float64())])),
        )

    return files.select(F.monotonically_increasing_id().alias("row"), "file_id", F.xxhash64("content").alias("text_hash"), source_of(F.col("path")).alias("source"), F.coalesce("lossy_conversion", F.lit(False)).alias("flag"), gains("content", "truncated", "part").alias("chains"))


def _estimate(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Posteriors of all records with evidence: ``row, file_id, text_hash, k, share``, a row for each chain of a record.

    Expectation: a record's share of chain k is its odds against no chain and the other chains, from its own evidence,
    the weight of k in its source and what its flag says. Maximisation: weights are the mean shares, by source shrunk
    towards all sources; the flag's odds are those seen in affected and other records.
    """
    totals = found.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).collect()
    n_all = sum(r.n for r in totals) or 1
    n_flag = sum(r.n for r in totals if r.flag)
    first, least = float(np.exp(-SWITCH)), float(np.exp(-MOST_AGAINST))
    sizes = found.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("s_rows"))
    seen = found.filter(F.size("chains") > 0).select("row", "file_id", "text_hash", "source", "flag", F.inline("chains"))
    seen = cut_lineage(seen.join(sizes, "source"))
    weights: dict[int, float] = {}
    flag_odds, by_source, out = (0.0, 0.0), None, None
    for _ in range(rounds):
        known = F.element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]), F.col("k")) if weights else F.lit(None).cast("double")
        start = F.greatest(F.coalesce(known, F.lit(least)), F.lit(least)) if weights else F.lit(first)
        scored = seen if by_source is None else seen.join(by_source, ["source", "k"], "left")
        in_source = F.lit(0.0) if by_source is None else F.coalesce("s_weight", F.lit(0.0))
        prior = F.greatest((in_source + SHRINK * start) / (F.col("s_rows") + SHRINK), F.lit(least))
        flag = F.when(F.col("flag"), F.lit(flag_odds[0])).otherwise(F.lit(flag_odds[1]))
        odds = F.exp(F.least(F.col("gain") + F.log(prior) + flag, F.lit(60.0)))
        scored = scored.select("row", "file_id", "text_hash", "source", "s_rows", "flag", "k", "gain", odds.alias("odds"))
        each = scored.groupBy("row").agg(F.sum("odds").alias("all_odds"))
        out = cut_lineage(scored.join(each, "row").select("row", "file_id", "text_hash", "source", "flag", "k", (F.col("odds") / (1 + F.col("all_odds"))).alias("share")))
        sums = out.groupBy("k").agg(F.sum("share").alias("w"), F.sum(F.when(F.col("flag"), F.col("share")).otherwise(0.0)).alias("f")).collect()
        moved = max((abs(r.w / n_all - weights.get(r.k, 0.0)) for r in sums), default=0.0)
        weights = {r.k: r.w / n_all for r in sums}
        hit, hit_flag = sum(r.w for r in sums), sum(r.f for r in sums)
        in_hit = (hit_flag + 1) / (hit + 2)
        in_rest = (max(n_flag - hit_flag, 0.0) + 1) / (max(n_all - hit, 1.0) + 2)
        flag_odds = (max(0.0, min(2.0, float(np.log(in_hit / in_rest)))), 0.0)
        by_source = out.groupBy("source", "k").agg(F.sum("share").alias("s_weight"))
        if moved < SETTLED:
            break
    return out


def _judged(files: DataFrame, model_rounds: int):
    """``file_id, chain, posterior, k`` of the affected rows, and the finder by whose model they were found."""
    spark = files.sparkSession
    told = spread(files.filter("content <> ''").select("file_id", "path", "content", "truncated", "lossy_conversion").withColumn("part", part_of(F.col("path"))))
    texts = told.select("content", "part")
    counts = _char_counts(texts)
    for _ in range(model_rounds - 1):
        counts = _char_counts(texts, _finder_of(spark, counts))
    finder_of = _finder_of(spark, counts)
    found = cut_lineage(_evidence(told, finder_of))
    shares = _estimate(found)
    best = shares.groupBy("row", "file_id", "text_hash").agg(F.sum("share").alias("posterior"), F.max_by("k", "share").alias("k"))
    names = F.create_map(*[F.lit(x) for k in range(-1, len(CHAINS)) for x in (k, chain_name(k))])
    return best.filter(F.col("posterior") > DECIDED).select("file_id", names[F.col("k")].alias("chain"), "posterior", "k", "text_hash"), finder_of


def garbled(files: DataFrame, model_rounds: int = MODEL_ROUNDS) -> DataFrame:
    """``file_id, chain, posterior`` of the rows of ``files`` that were read in a wrong encoding, one row each.

    Needs ``file_id, path, content, truncated, lossy_conversion``; other columns are ignored. A null flag counts as not
    set, a null or empty content is no case, rows with equal file_id or content are judged each. An empty table gives
    none. Contents are read whole.
    """
    return _judged(files, model_rounds)[0].select("file_id", "chain", "posterior")


def restore(files: DataFrame, model_rounds: int = MODEL_ROUNDS) -> DataFrame:
    """``file_id, chain, posterior, restored``: the affected rows with their text as far as it can still be known.

    Lost signs stay as they are. Of rows that share a file_id each is restored by its own chain."""
    told = files.filter("content <> ''").select("file_id", "content", part_of(F.col("path")).alias("part"), F.xxhash64("content").alias("text_hash"))
    judged, finder_of = _judged(files, model_rounds)
    best = F.struct("posterior", "chain", "k")
    found = judged.groupBy("file_id", "text_hash").agg(F.max(best).alias("best")).select("file_id", "text_hash", "best.*")  # equal rows have one answer

    @F.arrow_udf("string")
    def repaired(content: pa.Array, k: pa.Array, part: pa.Array) -> pa.Array:
        finder = finder_of()
        return pa.array([finder.repair(t, c, g) for t, c, g in zip(content.to_pylist(), k.to_pylist(), part.to_pylist())], pa.string())

    return found.join(told, ["file_id", "text_hash"]).select("file_id", "chain", "posterior", repaired("content", "k", "part").alias("restored"))


