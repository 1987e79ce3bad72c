"""Structural search, approximate: patterns over tokens, ``$A`` for one token or bracketed group, ``$$$`` for any."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.deps import language_of

_TOKEN = re.compile(r"\$\$\$\w*|\$[A-Z_]+|[A-Za-z_]\w*|\d[\w.]*|```|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|->|=>|::|==|!=|<=|>=|&&|\|\||\S")
_OPEN, _CLOSE = "([{", ")]}"


def tokens(code: str) -> list[tuple[str, int, int]]:
    """(token, start, end) of a piece of code."""
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(code)]


def _group_end(toks: list[tuple[str, int, int]], i: int) -> int:
    depth = 0
    for j in range(i, len(toks)):
        t = toks[j][0]
        depth += t in _OPEN
        depth -= t in _CLOSE
        if depth <= 0:
            return j + 1
    return len(toks)


def find_matches(code: str, pattern: str) -> list[tuple[int, int]]:
    """(start, end) of the places where the pattern's tokens occur in order; matches don't overlap and may be of any length."""
    toks, pat = tokens(code), [t for t, _, _ in tokens(pattern)]
    if not pat:
        return []

    def at(i: int, k: int) -> int:
        while k < len(pat):
            p = pat[k]
            if p.startswith("$$$"):
                if k + 1 == len(pat):
                    return i
                j = i
                while j < len(toks):
                    if (end := at(j, k + 1)) >= 0:
                        return end
                    if toks[j][0] in _CLOSE:
                        return -1
                    j = _group_end(toks, j)
                return -1
            if i >= len(toks):
                return -1
            if re.fullmatch(r"\$[A-Z_]+", p):
                if toks[i][0] in _CLOSE:
                    return -1
                i = _group_end(toks, i)
            elif toks[i][0] == p:
                i += 1
            else:
                return -1
            k += 1
        return i

    out, i = [], 0
    while i < len(toks):
        end = at(i, 0)
        if end > i:
            out.append((toks[i][1], toks[end - 1][2]))
            i = end
        else:
            i += 1
    return out


def ast_match(files: DataFrame, pattern: str, language: str | None = None) -> DataFrame:
    """``path, start_line, end_line, excerpt`` of the places in code files that have the pattern's structure."""
    df = files.withColumn("language", language_of(F.col("path"))).filter("language is not null and content is not null")
    df = df.filter(F.col("language") == language) if language else df
    anchor = max((t for t, _, _ in tokens(pattern) if not t.startswith("$")), key=len, default="")
    df = df.filter(F.contains("content", F.lit(anchor))) if anchor else df

    @F.arrow_udf("array<struct<start_line:bigint,end_line:bigint,excerpt:string>>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            out.append([{"start_line": t.count("\n", 0, a) + 1, "end_line": t.count("\n", 0, b) + 1, "excerpt": t[a:b]} for a, b in find_matches(t, pattern)])
        return pa.array(out, pa.list_(pa.struct([("start_line", pa.int64()), ("end_line", pa.int64()), ("excerpt", pa.string())])))

    return df.select("path", F.inline(run("content")))
