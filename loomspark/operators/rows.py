"""What the commands report, as rows of the one result type: dependencies, cycles, findings, marks set and refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import lines_of
from loomspark.operators.results import to_results

#: Most names that the data of one row lists; a file with more has several rows.
NAMES_A_ROW = 1000


def _error(code, message):
    return F.array(F.struct(code.cast("string").alias("code"), message.cast("string").alias("message")))


def dependency_rows(graph: DataFrame, languages: DataFrame, path: str | None = None, reverse: bool = False, names: int = NAMES_A_ROW) -> DataFrame:
    """A row for each file and direction, ``data`` = ``{"depends_on" or "depended_by": [...], "language": ..., "part": k}``.

    ``graph``: distinct ``src, dst``; ``languages``: ``path, language`` of the files that were analysed, which alone have
    rows. Without ``path`` both directions of all files, with it one direction of that file; an unknown file has no row, a
    file without dependencies an empty list. Lists are sorted; those of more than about ``names`` entries are dealt to
    several rows by the hash of the entry, so that a file on which everything depends is no single value.
    """
    known = languages.filter("path is not null").groupBy("path").agg(F.min("language").alias("language"))
    out = graph.select(F.col("src").alias("path"), F.lit("depends_on").alias("way"), F.col("dst").alias("name"))
    back = graph.select(F.col("dst").alias("path"), F.lit("depended_by").alias("way"), F.col("src").alias("name"))
    told = out.unionByName(back)
    asked = known.select("path", "language", F.explode(F.array(F.lit("depends_on"), F.lit("depended_by"))).alias("way"))
    if path is not None:
        wanted = (F.col("path") == path) & (F.col("way") == ("depended_by" if reverse else "depends_on"))
        told, asked = told.filter(wanted), asked.filter(wanted)
    sizes = told.groupBy("path", "way").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / names)
    dealt = told.join(sizes, ["path", "way"]).withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int"))
    lists = dealt.groupBy("path", "way", "part").agg(F.array_sort(F.collect_list("name")).alias("names"))
    rows = asked.join(lists, ["path", "way"], "left").withColumn("part", F.coalesce("part", F.lit(0))).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    on, by = (F.when(F.col("way") == w, F.col("names")).alias(w) for w in ("depends_on", "depended_by"))
    return to_results(rows, "flow", "ast_grep", data=F.to_json(F.struct(on, by, "language", "part")))


def cycle_rows(cycles: DataFrame, names: int = NAMES_A_ROW) -> DataFrame:
    """A ``CIRCULAR_DEPENDENCY`` row for each cycle of ``path, cycle``; cycles of more than ``names`` files are counted,
    and their files left to the table they come from."""
    sizes = cycles.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))
    small = cycles.join(sizes.filter(F.col("n") <= names), "cycle").groupBy("cycle").agg(F.array_sort(F.collect_list("path")).alias("names"))
    rows = sizes.join(small, "cycle", "left").withColumn("path", F.col("cycle"))
    said = F.concat(F.lit("Circular dependency detected: "), F.coalesce(F.array_join("names", " -> "), F.concat(F.col("n").cast("string"), F.lit(" files"))))
    out = to_results(rows.withColumn("said", said), "error", "ast_grep", excerpt="said", data=F.to_json(F.struct(F.col("names").alias("cycle"), F.col("n").alias("cycle_length"))))
    return out.withColumn("errors", _error(F.lit("CIRCULAR_DEPENDENCY"), F.col("excerpt"))).withColumn("excerpt", F.lit(None).cast("string"))


def tree_rows(graph: DataFrame, path: str | None) -> DataFrame:
    """What one file imports, a row each; without a file one row with the error ``TREE_REQUIRES_FILE``."""
    if path is None:
        one = graph.sparkSession.range(1).select(F.lit(None).cast("string").alias("path"))
        return to_results(one, "error", "ast_grep").withColumn("errors", _error(F.lit("TREE_REQUIRES_FILE"), F.lit("Tree format requires a specific file")))
    return to_results(graph.filter(F.col("src") == path).select(F.col("src").alias("path"), "dst").distinct(), "flow", "ast_grep", excerpt="dst")


def lint_rows(found: DataFrame) -> DataFrame:
    """Findings ``code, severity, path, line_no, id, n`` as rows: errors with high, warnings with medium confidence."""
    n, block = F.col("n").cast("string"), F.coalesce("id", F.lit("?"))
    said = (
        F.when(F.col("code") == "EMPTY_ANCHOR", F.concat(F.lit("Anchor '"), block, F.lit("' is empty")))
        .when(F.col("code") == "LARGE_ANCHOR", F.concat(F.lit("Anchor '"), block, F.lit("' has "), n, F.lit(" lines")))
        .when(F.col("code") == "DUPLICATE_ID", F.concat(F.lit("Anchor id '"), block, F.lit("' is used "), n, F.lit(" times")))
        .otherwise(F.concat(F.col("code"), F.lit(" '"), block, F.lit("'")))
    )
    rows = found.withColumn("said", said)
    out = to_results(rows.withColumn("hash", F.col("code")), "error", "anchor", start="line_no", excerpt="said", data=F.col("severity"))
    sure = F.when(F.col("data") == "error", "high").otherwise("medium")
    return out.withColumn("confidence", sure).withColumn("errors", _error(F.col("meta.hash"), F.col("excerpt"))).withColumn("data", F.lit(None).cast("string")).withColumn("meta", F.col("meta").withField("hash", F.lit(None).cast("string")))


def mark_rows(files: DataFrame, specs: DataFrame) -> DataFrame:
    """A row for each spec: the lines from its start to its end plus the two markers, or with low confidence why it failed.

    A spec fails whose start is below 1 or more than one line past the end of its file, whose end is before its start, or
    whose file isn't there. As marks are set from the bottom up, no other spec of the file changes that. Rows that repeat
    a spec come out each.
    """
    sized = files.groupBy(F.col("path").alias("_path")).agg(F.max(F.size(lines_of(F.col("content")))).alias("_n"))
    rows = specs.join(sized, F.col("path") == F.col("_path"), "left")
    start, end = F.col("start_line"), F.col("end_line")
    why = (
        F.when(F.col("_n").isNull(), F.lit("File not found"))
        .when(start < 1, F.lit("Start line must be at least 1"))
        .when(end < start, F.lit("Start line must not be after end line"))
        .when(start > F.col("_n") + 1, F.concat(F.lit("Start line "), start.cast("string"), F.lit(" is past the end of the file")))
    )
    told = rows.withColumn("_why", why).withColumn("_said", F.coalesce("_why", F.concat(F.lit("Anchor '"), "id", F.lit("' marked successfully"))))
    told = told.withColumn("_from", F.when(F.col("_why").isNull(), start)).withColumn("_to", F.when(F.col("_why").isNull(), end + 2))
    out = to_results(told, "anchor", "anchor", start="_from", end="_to", excerpt="_said")
    failed = F.col("range").isNull()
    return out.withColumn("kind", F.when(failed, "error").otherwise("anchor")).withColumn("confidence", F.when(failed, "low").otherwise("high"))


def unmark_rows(done: DataFrame) -> DataFrame:
    """``unmark``'s rows: with both markers gone a success, else an error of low confidence."""
    said = F.when(F.col("removed") == 2, F.concat(F.lit("Anchor '"), "id", F.lit("' removed"))).otherwise(F.concat(F.lit("Anchor '"), "id", F.lit("' not found")))
    out = to_results(done.withColumn("_said", said).withColumn("hash", F.col("removed")), "anchor", "anchor", excerpt="_said")
    failed = F.col("meta.hash") != "2"
    return out.withColumn("kind", F.when(failed, "error").otherwise("anchor")).withColumn("confidence", F.when(failed, "low").otherwise("high")).withColumn("meta", F.col("meta").withField("hash", F.lit(None).cast("string")))


def anchor_rows(blocks: DataFrame) -> DataFrame:
    """Blocks as rows: their lines, content and, as data, id, tags and version."""
    return to_results(blocks, "anchor", "anchor", start="start_line", end="end_line", excerpt="content", data=F.to_json(F.struct("id", "tags", "version")))
