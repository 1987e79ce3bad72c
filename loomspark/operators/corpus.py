"""The corpus: files and their lines, path filters, line extraction, bounded reads, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.globs import any_glob
from loomspark.functions.text import lines_of, utf8_cut

#: Defaults of bounded reads.
MAX_FILE_SIZE, TRUNCATE_SIZE, SNIFF_BYTES, EXTRACT_BYTES = 64 << 20, 64 << 10, 8192, 65_536


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last by ``order``. Only the kept row's columns leave the sort."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def document_files(documents: DataFrame) -> DataFrame:
    """``path, content, mtime_ms`` of the latest row of each path of a documents table."""
    named = documents.filter("path is not null and text is not null").select("path", F.col("text").alias("content"), "mtime_ms", "doc_id")
    return latest(named, "path", "mtime_ms", "doc_id").drop("doc_id")


def scan(
    files: DataFrame,
    scope: str | None = None,
    kind: str | None = None,
    max_depth: int | None = None,
    hidden: bool = False,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """The entries of a files table (``path, is_dir, depth, size, mtime_ms``) by place, kind, depth and patterns.

    Folders have no size and no time. The scanned folder itself is left out. A null depth passes no depth limit.
    """
    df = files.filter("path is not null and (depth is null or depth > 0)")
    if scope:
        df = df.filter(F.startswith("path", F.lit(scope.rstrip("/") + "/")))
    if kind:
        df = df.filter(F.col("is_dir") == (kind == "dir"))
    if max_depth is not None:
        df = df.filter(F.col("depth") <= max_depth)
    if not hidden:
        df = df.filter(~F.col("path").rlike(r"(^|/)\."))
    if include:
        df = df.filter(any_glob(F.col("path"), include))
    if exclude:
        df = df.filter(~any_glob(F.col("path"), exclude))
    only = lambda c: F.when(~F.col("is_dir"), F.col(c)).alias(c)
    return df.select("path", "is_dir", "depth", only("size"), only("mtime_ms"))


def find(files: DataFrame, pattern: str, scope: str | None = None) -> DataFrame:
    """Files whose path holds the pattern, whatever the case."""
    return scan(files, scope, "file").filter(F.contains(F.lower("path"), F.lit(pattern.lower())))


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """``path, line_no BIGINT, text`` of every line, with the other columns but the content kept."""
    rest = [c for c in files.columns if c not in (content, "line_no", "text")]
    return files.filter(F.col(content).isNotNull()).select(*rest, F.posexplode(lines_of(F.col(content))).alias("_at", "text")).select(*rest, (F.col("_at") + 1).cast("bigint").alias("line_no"), "text")


def extract(files: DataFrame, start: int, end: int, max_bytes: int = EXTRACT_BYTES, content: str = "content") -> DataFrame:
    """``path, range_start, range_end, excerpt, truncated``: lines start to end of each file, up to ``max_bytes`` bytes.

    The first line that would pass the limit, counting a line end after each, is cut and ends the excerpt; it follows
    without a line end in between, and blank lines before the first other line vanish. Files with fewer than ``start``
    lines have no row.
    """
    if not 1 <= start <= end:
        raise ValueError(f"no such range of lines: {start}:{end}")
    part = F.slice(F.col("_lines"), start, end - start + 1)
    # One fold over the lines asked for: text so far, its bytes, whether the limit was hit, and the last line used.
    zero = F.struct(F.lit("").alias("t"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("cut"), F.lit(start - 1).cast("bigint").alias("last"))

    def step(acc, x):
        size = F.octet_length(x)
        over = acc["n"] + size + 1 > max_bytes
        glued = F.when(acc["t"] == "", x).otherwise(F.concat(acc["t"], F.lit("\n"), x))
        grown = acc["n"] + size + F.when(acc["t"] == "", 0).otherwise(1)
        stop = F.struct(F.concat(acc["t"], utf8_cut(x, F.greatest(F.lit(max_bytes) - acc["n"], F.lit(0)))).alias("t"), acc["n"].cast("bigint").alias("n"), F.lit(True).alias("cut"), (acc["last"] + 1).alias("last"))
        go = F.struct(glued.alias("t"), grown.cast("bigint").alias("n"), F.lit(False).alias("cut"), (acc["last"] + 1).alias("last"))
        return F.when(acc["cut"], acc).when(over, stop).otherwise(go)

    df = files.filter(F.col(content).isNotNull()).select("path", lines_of(F.col(content)).alias("_lines")).filter(F.size("_lines") >= start)
    folded = df.select("path", F.aggregate(part, zero, step).alias("x"))
    return folded.select("path", F.lit(start).cast("bigint").alias("range_start"), F.col("x.last").alias("range_end"), F.col("x.t").alias("excerpt"), F.col("x.cut").alias("truncated"))


def line_range(text: str) -> tuple[int, int]:
    """The lines that ``start:end`` names, counted from 1; an error if it isn't of that form or runs backwards."""
    parts = text.split(":")
    if len(parts) != 2:
        raise ValueError(f"expected 'start:end', got {text!r}")
    if not all(p.isascii() and p.isdigit() for p in parts):
        raise ValueError(f"lines are numbers, got {text!r}")
    start, end = map(int, parts)
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    if start == 0:
        raise ValueError("lines are counted from 1")
    return start, end


def bounded_read(
    files: DataFrame, raw: str = "raw", size_strategy: str = "truncate", encoding_strategy: str = "lossy", max_size: int = MAX_FILE_SIZE, truncate_size: int = TRUNCATE_SIZE, disk_size: str | None = None
) -> DataFrame:
    """Adds ``content, truncated, lossy, skipped, skip_reason, warnings`` to files with a binary column.

    Size: ``skip`` leaves out files above ``max_size``; ``truncate`` cuts at a character within ``truncate_size`` bytes;
    ``full`` reads up to ``max_size`` and leaves out larger ones. Bytes with a NUL near the start are binary and left out
    unless the encoding strategy is ``lossy`` or ``binary``; invalid UTF-8 is left out under ``skip``, else replaced.
    A null column is a file that can't be read: skipped. ``disk_size`` names a column with the size on disk, of which
    the bytes may be the beginning only; a file that isn't to be cut but didn't come whole is skipped and says so.
    """
    b = F.col(raw)
    size = F.greatest(F.octet_length(b), F.coalesce(F.col(disk_size), F.lit(0))) if disk_size else F.octet_length(b)
    is_binary = F.position(F.lit(b"\x00"), F.substring(b, 1, SNIFF_BYTES)) > 0
    too_large = size > max_size if size_strategy in ("skip", "full") else F.lit(False)
    cut = (size > truncate_size) if size_strategy == "truncate" else F.lit(False)
    whole = b.cast("string")
    valid = F.is_valid_utf8(whole)
    text = F.make_valid_utf8(whole)
    text = F.when(cut, utf8_cut(text, truncate_size)).otherwise(text)
    reason = F.when(b.isNull(), F.lit("unreadable")).when(too_large, F.lit("too large"))
    if size_strategy != "truncate":
        reason = reason.when(F.octet_length(b) < size, F.lit("not read whole"))
    if encoding_strategy == "skip":
        reason = reason.when(is_binary, F.lit("binary")).when(~valid, F.lit("invalid encoding"))
    marks = F.filter(F.array(F.when(cut, F.lit("FILE_TRUNCATED")), F.when(~valid, F.lit("LOSSY_CONVERSION"))), lambda x: x.isNotNull())
    out = files.withColumn("skip_reason", reason).withColumn("skipped", F.col("skip_reason").isNotNull())
    keep = ~F.col("skipped")
    return (
        out.withColumn("content", F.when(keep, text))
        .withColumn("truncated", keep & F.coalesce(cut, F.lit(False)))
        .withColumn("lossy", keep & ~F.coalesce(valid, F.lit(True)))
        .withColumn("warnings", F.when(keep, marks).otherwise(F.array().cast("array<string>")))
    )


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back; later queries then start from columns on disk."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def fingerprint(files: DataFrame) -> DataFrame:
    """One row ``files, bytes, mark`` that changes with any path, size or time: what makes a snapshot valid."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("path", "size", "mtime_ms")).alias("mark"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot as it was written."""
    return spark.read.parquet(path)
