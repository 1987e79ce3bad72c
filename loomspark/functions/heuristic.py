"""The heuristic token count: four classes of code points, each with its own rate.

``ceil(ascii/4) + ceil(signs/2) + ceil(2*cjk/3) + ceil(other/2)``; 0 for null or empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 31 signs, and the ranges counted as CJK.
SIGNS = "()[]{}<>=+-*/%&|^!~?:;,.@#$\\\"'`"
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF), (0xFF00, 0xFFEF))

_SIGN_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in SIGNS) + "]"
_CJK_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
_IS_SIGN = np.zeros(256, dtype=bool)
_IS_SIGN[[ord(c) for c in SIGNS]] = True


def _up(n: Column, d: int) -> Column:
    return F.floor((n + (d - 1)) / d).cast("bigint")


def cjk_chars(text: Column) -> Column:
    """Code points in the CJK ranges."""
    return F.regexp_count(text, F.lit(_CJK_CLASS))


def heuristic_tokens(text: Column) -> Column:
    """The count as a native expression."""
    ascii_, signs, cjk = F.regexp_count(text, F.lit(r"[\x00-\x7F]")), F.regexp_count(text, F.lit(_SIGN_CLASS)), cjk_chars(text)
    other = F.length(text) - ascii_ - cjk
    return F.coalesce(_up(ascii_ - signs, 4) + _up(signs, 2) + _up(2 * cjk, 3) + _up(other, 2), F.lit(0).cast("bigint"))


def classes_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Masks of ASCII without signs, signs, CJK and the rest, of an array of code points."""
    is_ascii = points < 128
    sign = is_ascii & _IS_SIGN[np.where(is_ascii, points, 0)]
    cjk = np.zeros(len(points), dtype=bool)
    if not is_ascii.all():
        for a, b in CJK_RANGES:
            cjk |= (points >= a) & (points <= b)
    return is_ascii & ~sign, sign, cjk, ~(is_ascii | cjk)


def rate(plain, sign, cjk, other):
    """The count from the numbers in the classes; of numbers or arrays."""
    return -(-plain // 4) - (-sign // 2) - (-2 * cjk // 3) - (-other // 2)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the offsets of its rows; nulls have no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def count_array(texts: pa.Array) -> np.ndarray:
    """The count of every row of an Arrow string array, over its bytes at once, without decoding it."""
    if not len(texts):
        return np.zeros(0, np.int64)
    raw, offsets = _buffers(texts)
    if not len(raw):
        return np.zeros(len(texts), np.int64)

    def per_row(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])

    sign, low = per_row(_IS_SIGN[raw]), per_row(raw < 0x80)
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return rate(low - sign, sign, 0 * sign, 0 * sign)
    starts = np.searchsorted(lead, offsets)
    three = lead[(raw[lead] >= 0xE0) & (raw[lead] < 0xF0)]
    point = ((raw[three].astype(np.int32) & 15) << 12) | ((raw[three + 1].astype(np.int32) & 63) << 6) | (raw[three + 2] & 63)
    hit = np.zeros(len(point), dtype=bool)
    for a, b in CJK_RANGES:
        hit |= (point >= a) & (point <= b)
    at = three[hit]
    cjk = np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])
    return rate(low - sign, sign, cjk, np.diff(starts) - cjk)
