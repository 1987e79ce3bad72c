"""Path patterns compiled on the driver to native predicates that the scan can take."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_glob(path: Column, pattern: str) -> Column:
    """``*.x`` is an ending, ``d/*`` a beginning; another pattern with ``*`` asks for all its literal parts in any order;
    one without asks for equality or containment."""
    if pattern.startswith("*."):
        return F.endswith(path, F.lit(pattern[1:]))
    if pattern.endswith("/*"):
        return F.startswith(path, F.lit(pattern[:-1]))
    if "*" in pattern:
        parts = [p for p in pattern.split("*") if p]
        return reduce(lambda a, b: a & b, (F.contains(path, F.lit(p)) for p in parts), F.lit(True))
    return F.contains(path, F.lit(pattern))


def any_glob(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; false without patterns."""
    return reduce(lambda a, b: a | b, (path_glob(path, p) for p in patterns), F.lit(False))


def search_glob(path: Column, pattern: str) -> Column:
    """The other dialect, of line search: ``**`` crosses folders, ``*`` doesn't; without a slash it is about the name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return path.rlike(("^" if "/" in pattern.strip("/") else "(^|/)") + out + "$")
