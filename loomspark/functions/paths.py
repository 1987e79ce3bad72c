"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may surround a path.
_EDGE = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def lexical_path(path: Column) -> Column:
    """The place a spelling leads to: forward slashes, no surrounding blanks, no empty, ``.`` or ``..`` segments.

    A ``..`` removes the segment before it; where there is none it is dropped, as above a root there is nothing.
    Null for null and for a path of which nothing is left. The segment fold runs only for spellings that need it.
    """
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), _EDGE, "")
    parts = F.filter(F.split(plain, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    clean = F.when(plain.rlike(r"(^|/)\.\.(/|$)"), F.array_join(folded, "/")).when(plain.rlike(r"(^|/)\.?(/|$)"), F.array_join(parts, "/")).otherwise(plain)
    return F.when(clean != "", clean)


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, if a dot stands after its first character; else empty."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)
