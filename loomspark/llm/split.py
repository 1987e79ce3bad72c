"""Splitting oversized items at natural boundaries, by recursive bisection.

A stretch that is too long is cut at the strongest boundary in the middle half around its midpoint, and its halves are
cut again until each is within the limit less the overlap; then every piece but the first gets the end of the one before
in front. Sizes are heuristic tokens or UTF-8 bytes, read off running sums, so each test of a stretch takes constant time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.heuristic import classes_of, heuristic_tokens, rate

#: Ends of blank lines, lines, sentences, and clauses or words; the strongest first. Where none is near, any character.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t\r]*\n\s*",
        r"\n",
        r"(?<=[.!?…])[\"'”’)\]]*\s+|[。！？]+[」』”]*",
        r"[,;:]\s+|[，、；：]|\s+",
    )
)
_PIECE = pa.struct([("piece", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("overlap_chars", pa.int64()), ("size", pa.int64()), ("content", pa.string())])
_PIECE_SQL = "array<struct<piece:int,start_char:bigint,end_char:bigint,overlap_chars:bigint,size:bigint,content:string>>"


class Measure:
    """Sizes of the stretches of a text."""

    def __init__(self, text: str, unit: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.unit = unit
        zero = np.zeros(1, np.int64)
        if unit == "bytes":
            self.sums = [np.concatenate((zero, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)))]
            self.weight = self.sums[0]
        else:
            self.sums = [np.concatenate((zero, np.cumsum(m, dtype=np.int64))) for m in classes_of(points)]
            a, s, c, o = self.sums
            self.weight = 3 * a + 6 * s + 8 * c + 6 * o

    def size(self, i: int, j: int) -> int:
        """Of text[i:j]."""
        d = [int(s[j] - s[i]) for s in self.sums]
        return d[0] if self.unit == "bytes" else rate(*d)


def _joined(text: str, i: int) -> bool:
    """Whether a cut before text[i] would part what is one sign: combining marks, joiners, CR and LF."""
    c = text[i]
    return bool(unicodedata.combining(c)) or c in "‍︎️" or text[i - 1] == "‍" or (c == "\n" and text[i - 1] == "\r") or "\U0001f3fb" <= c <= "\U0001f3ff"


def _cut(text: str, i: int, j: int, weight: np.ndarray, levels: list[list[int]]) -> int:
    """Where to cut text[i:j], strictly between its ends."""
    low, high = int(weight[i]), int(weight[j])
    a, m, b = np.searchsorted(weight, (low + (high - low) / 4, (low + high) / 2, high - (high - low) / 4)).tolist()
    m = min(max(m, i + 1), j - 1)
    a, b = min(max(a, i + 1), m), max(min(b, j - 1), m)
    for marks in levels:
        x = bisect_left(marks, m)
        near = [p for p in marks[max(0, x - 1) : x + 1] if a <= p <= b]
        if near:
            return min(near, key=lambda p: (abs(int(weight[p]) - int(weight[m])), p))
    for p in range(m, a - 1, -1):
        if not _joined(text, p):
            return p
    for p in range(m + 1, j):
        if not _joined(text, p):
            return p
    return m


def split_text(text: str | None, limit: int | None, overlap: int | None, unit: str) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap, size) of each piece; ``text[start - overlap:end]`` is the piece, ``text[start:end]`` its own
    part, and the own parts make up the text. No pieces for null, for no limit and for a text within it.

    An overlap of the limit or more would leave no room for anything new and counts as half the limit; null or negative
    is none. A single sign larger than the limit stays whole.
    """
    if text is None or limit is None or not text:
        return []
    measure = Measure(text, unit)
    n = len(text)
    if measure.size(0, n) <= limit:
        return []
    overlap = max(0, overlap or 0)
    if overlap >= limit:
        overlap = max(0, limit) // 2
    room = limit - overlap
    levels = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    cuts, todo = [], [(0, n)]
    while todo:
        i, j = todo.pop()
        if j - i <= 1 or measure.size(i, j) <= room:
            cuts.append((i, j))
            continue
        k = _cut(text, i, j, measure.weight, levels)
        if not i < k < j:
            cuts.append((i, j))
            continue
        todo.append((k, j))
        todo.append((i, k))
    out, before = [], 0
    for i, j in cuts:
        start = i
        if overlap and i:
            lo, hi = before, i  # the longest end of the piece before that is no larger than the overlap
            while lo < hi:
                mid = (lo + hi) // 2
                if measure.size(mid, i) <= overlap:
                    hi = mid
                else:
                    lo = mid + 1
            start = lo
            while start < i and start > 0 and _joined(text, start):
                start += 1
        out.append((i, j, i - start, measure.size(start, j)))
        before = start
    return out


def split_column(unit: str, with_content: bool = True):
    """A function of (content, limit, overlap) columns that gives the array of pieces; without content only their places."""

    @F.arrow_udf(_PIECE_SQL)
    def split(content: pa.Array, limit: pa.Array, overlap: pa.Array) -> pa.Array:
        offsets, rows = [0], ([], [], [], [], [], [])
        for text, most, over in zip(content.to_pylist(), limit.to_pylist(), overlap.to_pylist()):
            for k, (i, j, o, size) in enumerate(split_text(text, most, over, unit)):
                for to, v in zip(rows, (k, i, j, o, size, text[i - o : j] if with_content else None)):
                    to.append(v)
            offsets.append(len(rows[0]))
        made = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _PIECE)], fields=list(_PIECE))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)

    return split


def anchor_pairs(anchors: DataFrame, packs: DataFrame) -> DataFrame:
    """``item_id, limit_id, max_size, overlap``: anchors above the limit of a pack whose list holds their id.

    Sizes are taken once for each anchor and only they go through the join, not the contents. A pack that names an id
    twice counts once; each row of anchors with the id is judged by itself.
    """
    sized = anchors.filter("content is not null and id is not null").select("anchor_key", "id", heuristic_tokens(F.col("content")).alias("size"))
    asked = packs.filter("max_tokens is not null").select("pack_id", "max_tokens", "overlap_tokens", F.explode(F.array_distinct("anchors")).alias("asked_id"))
    return sized.join(asked, (F.col("id") == F.col("asked_id")) & (F.col("size") > F.col("max_tokens"))).select(
        F.col("anchor_key").alias("item_id"), F.col("pack_id").alias("limit_id"), F.col("max_tokens").alias("max_size"), F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("overlap")
    ).distinct()


def _in_anchors(anchors: DataFrame, packs: DataFrame, with_content: bool) -> tuple[DataFrame, DataFrame]:
    """The pairs, and the pieces of each anchor under each limit and overlap it is asked for, however many packs ask."""
    pairs = anchor_pairs(anchors, packs)
    ways = pairs.select("item_id", "max_size", "overlap").distinct()
    texts = anchors.filter("content is not null").select(F.col("anchor_key").alias("t_key"), "content")
    cut = ways.join(texts, F.col("item_id") == F.col("t_key")).select("item_id", "max_size", "overlap", split_column("tokens", with_content)("content", "max_size", "overlap").alias("pieces"))
    return pairs, cut


def _in_files(files: DataFrame, configs: DataFrame, with_content: bool) -> DataFrame:
    """Files above the limit of their configuration, with their pieces."""
    limits = configs.filter("truncate_size is not null").select(F.col("config_id").alias("limit_id"), F.col("truncate_size").alias("max_size"), F.greatest(F.coalesce("overlap_bytes", F.lit(0)), F.lit(0)).cast("bigint").alias("overlap"))
    large = files.filter("content is not null and config_id is not null").select(F.col("file_id").alias("item_id"), "config_id", "content")
    large = large.join(limits, (F.col("config_id") == F.col("limit_id")) & (F.octet_length("content") > F.col("max_size")))
    return large.select("item_id", F.col("limit_id").cast("bigint").alias("limit_id"), "max_size", "overlap", split_column("bytes", with_content)("content", "max_size", "overlap").alias("pieces"))


def split_pieces(anchors: DataFrame, packs: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """All pieces: ``item_kind, item_id, limit_id, piece, start_char, end_char, overlap_chars, size, content``.

    ``start_char`` and ``end_char`` (from 0, end not included) are the piece's own part; ``content`` has the overlap in
    front. Null contents and limits have no pieces, nor have items within their limit; empty tables give no rows.
    """
    pairs, cut = _in_anchors(anchors, packs, True)
    pieces = cut.select("item_id", "max_size", "overlap", F.inline("pieces"))
    of_anchors = pairs.join(pieces, ["item_id", "max_size", "overlap"])
    of_files = _in_files(files, configs, True).select("item_id", "limit_id", F.inline("pieces"))
    columns = ["item_kind", "item_id", "limit_id", "piece", "start_char", "end_char", "overlap_chars", "size", "content"]
    return of_anchors.withColumn("item_kind", F.lit("anchor")).select(*columns).unionByName(of_files.withColumn("item_kind", F.lit("file")).select(*columns))


def oversized(anchors: DataFrame, packs: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """``item_kind, item_id, limit_id, pieces INT, largest``: what had to be split, and the largest piece it fell into."""
    pairs, cut = _in_anchors(anchors, packs, False)
    told = [F.size("pieces").alias("pieces"), F.array_max(F.transform("pieces", lambda p: p["size"])).alias("largest")]
    of_anchors = pairs.join(cut.filter(F.size("pieces") > 0).select("item_id", "max_size", "overlap", *told), ["item_id", "max_size", "overlap"])
    of_files = _in_files(files, configs, False).filter(F.size("pieces") > 0).select("item_id", "limit_id", *told)
    columns = ["item_kind", "item_id", "limit_id", "pieces", "largest"]
    return of_anchors.withColumn("item_kind", F.lit("anchor")).select(*columns).unionByName(of_files.withColumn("item_kind", F.lit("file")).select(*columns))
