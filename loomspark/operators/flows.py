"""Statistics, outlines, packing to a budget, and gathering of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.heuristic import cjk_chars, heuristic_tokens
from loomspark.functions.paths import extension
from loomspark.operators import anchors as A
from loomspark.operators.search import match

#: Files that statistics and outlines are about, and constants of packing.
TEXT_EXTENSIONS = ("md", "txt", "rst", "adoc", "org", "tex", "html", "xml")
ITEM_TOKENS, LEAST_CUT, BYTES_PER_TOKEN, CUT_MARK = 15, 100, 4, "...[truncated]"


def file_stats(files: DataFrame, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """Counts of every text file: ``path, chars, chars_no_space, words, cjk_chars, line_count, tokens``."""
    c = F.col("content")
    return files.filter(extension(F.col("path")).isin(*extensions) & c.isNotNull()).select(
        "path",
        F.length(c).cast("bigint").alias("chars"),
        T.chars_no_space(c).alias("chars_no_space"),
        T.english_words(c).alias("words"),
        cjk_chars(c).cast("bigint").alias("cjk_chars"),
        T.line_count(c).alias("line_count"),
        heuristic_tokens(c).alias("tokens"),
    )


def project_stats(stats: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row of totals over files and their blocks."""
    per_file = anchors.groupBy("path").agg(F.count(F.lit(1)).alias("anchors"))
    joined = stats.join(per_file, "path", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chars", "chars_no_space", "words", "cjk_chars", "line_count", "tokens", "anchors"))
    )


def top_files(stats: DataFrame, most: int = 10) -> DataFrame:
    """The largest files by characters."""
    return stats.orderBy(F.desc("chars"), "path").limit(most)


def anchors_by_tag(anchors: DataFrame) -> DataFrame:
    """``tag, n``; a tag that a block has twice counts twice."""
    return anchors.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def outline(anchors: DataFrame, tag: str | None = None, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """``id, path, tags, start_line, end_line, chars, words, cjk_chars, tokens, preview, level`` of every block.

    The level is the number of blocks of other ids of the file that enclose it, or the dots in its id if they are more.
    Enclosing blocks are counted over one array of the file's ranges.
    """
    df = anchors.filter(extension(F.col("path")).isin(*extensions))
    df = df.filter(F.array_contains("tags", tag)) if tag is not None else df
    c = F.coalesce("content", F.lit(""))
    spans = df.groupBy(F.col("path").alias("_p")).agg(F.collect_list(F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("id").alias("i"))).alias("_spans"))
    df = df.join(spans, F.col("path") == F.col("_p"))
    around = F.size(F.filter("_spans", lambda o: (o["s"] < F.col("start_line")) & (o["e"] > F.col("end_line")) & (o["i"] != F.col("id"))))
    return df.select(
        "id", "path", "tags", "start_line", "end_line",
        F.length(c).cast("bigint").alias("chars"), T.english_words(c).alias("words"), cjk_chars(c).cast("bigint").alias("cjk_chars"), heuristic_tokens(c).alias("tokens"),
        T.preview(c).alias("preview"), F.greatest(around, T.dots(F.col("id"))).cast("int").alias("level"),
    )


def outline_by_tag(items: DataFrame) -> DataFrame:
    """``tag, id, place``: ids of each tag in order of path and start."""
    w = Window.partitionBy("tag").orderBy("path", "start_line", "end_line", "id")
    return items.select(F.explode("tags").alias("tag"), "id", "path", "start_line", "end_line").withColumn("place", F.row_number().over(w)).select("tag", "id", "place")


def request_items(packs: DataFrame, anchors: DataFrame, files: DataFrame) -> DataFrame:
    """``pack_id, ord, kind, path, excerpt, confidence`` of every request: its blocks in order, then its files.

    The last block of an id holds; an unknown id gives nothing, an unknown file a row that says so.
    """
    last = anchors.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("path", "content"), F.struct("path", "end_line", "start_line")).alias("x"))
    want = packs.select("pack_id", F.posexplode("anchors").alias("ord", "_want"))
    blocks = want.join(last, F.col("_want") == F.col("_id")).select("pack_id", "ord", F.lit("anchor").alias("kind"), F.col("x.path").alias("path"), F.col("x.content").alias("excerpt"), F.lit("high").alias("confidence"))
    asked = packs.select("pack_id", F.posexplode("files").alias("_o", "_want"), F.coalesce(F.size("anchors"), F.lit(0)).alias("_n"))
    there = files.select(F.col("path").alias("_path"), "content")
    whole = asked.join(there, F.col("_want") == F.col("_path"), "left").select(
        "pack_id", (F.col("_o") + F.greatest(F.col("_n"), F.lit(0))).alias("ord"), F.when(F.col("_path").isNull(), "error").otherwise("file").alias("kind"), F.col("_want").alias("path"),
        F.when(F.col("_path").isNull(), "Error: File not found").otherwise(F.col("content")).alias("excerpt"), F.when(F.col("_path").isNull(), "low").otherwise("high").alias("confidence"),
    )
    return blocks.unionByName(whole)


def pack(items: DataFrame, budgets: DataFrame, by_confidence: bool = True) -> DataFrame:
    """``pack_id, place, kind, path, tokens, cut, excerpt``: the items of each request that its budget holds.

    Items are taken by confidence (or as asked for) until the first that doesn't fit; of that one, as many bytes are
    taken as the rest of the budget stands for, if they are more than ``LEAST_CUT``. A null budget holds everything.
    Requests are windows of their own, so they spread over the cluster.
    """
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2) if by_confidence else F.lit(0)
    tokens = heuristic_tokens(F.coalesce("path", F.lit(""))) + heuristic_tokens(F.coalesce("excerpt", F.lit(""))) + F.lit(ITEM_TOKENS)
    w = Window.partitionBy("pack_id").orderBy("rank", "ord")
    df = items.withColumn("rank", rank).withColumn("tokens", tokens).join(budgets.select(F.col("pack_id").alias("_b"), "max_tokens"), F.col("pack_id") == F.col("_b"), "left")
    df = df.withColumn("cum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    rest = (F.col("max_tokens") - (F.col("cum") - F.col("tokens"))) * BYTES_PER_TOKEN
    whole = F.col("max_tokens").isNull() | (F.col("cum") <= F.col("max_tokens"))
    first_over = ~whole & (F.col("cum") - F.col("tokens") <= F.col("max_tokens")) & (rest > LEAST_CUT) & F.col("excerpt").isNotNull()
    kept = df.filter(whole | first_over).withColumn("cut", ~whole & (F.octet_length("excerpt") > rest))
    return kept.select("pack_id", "place", "kind", "path", "tokens", "cut", F.when(F.col("cut"), F.concat(T.utf8_cut(F.col("excerpt"), rest), F.lit(CUT_MARK))).otherwise(F.col("excerpt")).alias("excerpt"))


def pack_stats(packed: DataFrame, items: DataFrame) -> DataFrame:
    """``pack_id, total_items, total_bytes, estimated_tokens, truncated, dropped`` of every request."""
    asked = items.groupBy("pack_id").agg(F.count(F.lit(1)).alias("asked"))
    size = F.octet_length(F.coalesce("excerpt", F.lit("")))
    tokens = heuristic_tokens(F.coalesce("path", F.lit(""))) + heuristic_tokens(F.coalesce("excerpt", F.lit(""))) + F.lit(ITEM_TOKENS)
    got = packed.groupBy("pack_id").agg(F.count(F.lit(1)).alias("total_items"), F.sum(size).cast("bigint").alias("total_bytes"), F.sum(tokens).alias("estimated_tokens"), F.max("cut").alias("cut"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return asked.join(got, "pack_id", "left").select("pack_id", zero("total_items"), zero("total_bytes"), zero("estimated_tokens"), (F.coalesce("cut", F.lit(False)) | (F.coalesce("total_items", F.lit(0)) < F.col("asked"))).alias("truncated"), (F.col("asked") - F.coalesce("total_items", F.lit(0))).alias("dropped"))


def writing(files: DataFrame, anchors: DataFrame, anchor_id: str, max_items: int = 10, words: list[str] | None = None) -> DataFrame:
    """``stage, path, line_no, excerpt, confidence``: evidence for writing about a block.

    First the block; then up to half of ``max_items`` (one at least) blocks that share a tag, one for each new path; then
    as many lines, one for each path still new, that hold one of its keywords.
    """
    target = A.get(anchors, anchor_id).select("path", "start_line", "content", "tags")
    one = target.collect()  # at most one row
    half = max(1, max_items // 2)
    first = target.select(F.lit(1).alias("stage"), "path", F.col("start_line").alias("line_no"), F.col("content").alias("excerpt"), F.lit("high").alias("confidence"))
    if not one:
        return first
    near = anchors.filter((F.col("id") != anchor_id) & F.arrays_overlap("tags", F.array(*map(F.lit, one[0].tags)).cast("array<string>")) & (F.col("path") != one[0].path))
    w = Window.partitionBy("path").orderBy("end_line", "start_line", "id")
    near = near.withColumn("_n", F.row_number().over(w)).filter("_n = 1").orderBy("path").limit(half)
    second = near.select(F.lit(2).alias("stage"), "path", F.col("start_line").alias("line_no"), F.col("content").alias("excerpt"), F.lit("medium").alias("confidence"))
    if words is None:
        words = target.select(T.keywords(F.coalesce("content", F.lit(""))).alias("k")).first().k
    out = first.unionByName(second)
    if not words:
        return out
    seen = [r.path for r in second.select("path").collect()] + [one[0].path]  # at most max_items paths
    hits = match(files.filter(~F.col("path").isin(*seen)), "|".join(words), max_count=1).orderBy("path").limit(half)
    return out.unionByName(hits.select(F.lit(3).alias("stage"), "path", "line_no", "excerpt", F.lit("low").alias("confidence")))
