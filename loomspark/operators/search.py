"""Line search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.globs import search_glob
from loomspark.operators.corpus import lines


def match(
    files: DataFrame,
    pattern: str,
    scopes: list[str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    ignore_case: bool = False,
    word: bool = False,
    max_count: int | None = None,
    context: int = 0,
) -> DataFrame:
    """``path, line_no, excerpt`` of every line that matches; with ``context`` also ``before`` and ``after``, arrays.

    Classes are Unicode's. A file whose content cannot match is dropped before it is cut into lines. ``max_count`` is per
    file. The excerpt has no white space at its end.
    """
    p = f"(?<!\\w)(?:{pattern})(?!\\w)" if word else pattern
    p = f"(?U{'i' if ignore_case else ''})" + p
    df = files
    if scopes:
        df = df.filter(reduce(lambda a, b: a | b, (F.startswith("path", F.lit(s.rstrip("/") + "/")) | (F.col("path") == s) for s in scopes)))
    if include:
        df = df.filter(reduce(lambda a, b: a | b, (search_glob(F.col("path"), g) for g in include)))
    if exclude:
        df = df.filter(~reduce(lambda a, b: a | b, (search_glob(F.col("path"), g) for g in exclude)))
    rows = lines(df.select("path", "content"))
    if context:
        w = Window.partitionBy("path").orderBy("line_no")
        rows = rows.withColumn("before", F.collect_list("text").over(w.rowsBetween(-context, -1))).withColumn("after", F.collect_list("text").over(w.rowsBetween(1, context)))
    hits = rows.filter(F.col("text").rlike(p))
    if max_count is not None:
        hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).filter(F.col("_n") <= max_count)
    extra = ["before", "after"] if context else []
    return hits.select("path", "line_no", F.regexp_replace("text", r"(?U)\s+$", "").alias("excerpt"), *extra)


def count_matches(files: DataFrame, pattern: str, **options) -> DataFrame:
    """One row ``count``."""
    return match(files, pattern, **options).agg(F.count(F.lit(1)).alias("count"))
