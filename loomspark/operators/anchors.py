"""Marker-delimited blocks: parsing, listing, neighbours, lint, marking and unmarking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.hashing import xxh3_hex
from loomspark.functions.paths import extension
from loomspark.functions.text import lines_of
from loomspark.operators.corpus import lines

#: The marker grammar, the files that may hold markers, and the size from which a block is large.
BEGIN = r"<!--\s*Q:begin\s+id=(\S+)(\s+tags=(\S+))?(\s+v=(\d+))?\s*-->"
END = r"<!--\s*Q:end\s+id=(\S+)\s*-->"
EXTENSIONS = tuple("md txt rs py js ts jsx tsx html css json yaml yml toml xml sh bash zsh c cpp h hpp java go rb php swift".split())
IMPACT_EXTENSIONS = tuple("md txt rs py ts tsx js jsx go java c cpp h hpp html css scss yaml yml toml json".split())
LARGE_LINES = 500


def candidates(files: DataFrame) -> DataFrame:
    """Files whose extension, whatever its case, may hold markers."""
    return files.filter(F.lower(extension(F.col("path"))).isin(*EXTENSIONS))


def markers(files: DataFrame) -> DataFrame:
    """``path, line_no, seq, kind, id, tags, version``: the first begin and the first end marker of each line."""
    held = lines(files.filter(F.contains("content", F.lit("Q:"))).select("path", "content")).filter(F.contains("text", F.lit("Q:")))
    tags = F.regexp_extract("text", BEGIN, 3)
    begin = F.struct(
        F.lit(0).alias("seq"),
        F.lit("B").alias("kind"),
        F.regexp_extract("text", BEGIN, 1).alias("id"),
        F.when(tags != "", F.transform(F.split(tags, ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.regexp_extract("text", BEGIN, 5).try_cast("int"), F.lit(1)).alias("version"),
    )
    end = F.struct(F.lit(1).alias("seq"), F.lit("E").alias("kind"), F.regexp_extract("text", END, 1).alias("id"), F.array().cast("array<string>").alias("tags"), F.lit(1).alias("version"))
    return held.select("path", "line_no", F.inline(F.array(begin, end))).filter("id <> ''")


def paired(marks: DataFrame) -> DataFrame:
    """Adds ``state`` (anchor, unpaired_begin, unpaired_end) and ``end_no`` to markers.

    An end closes the last open begin of its id, across nesting. With s the running balance of begins and ends of an id
    and m its running minimum, at most 0, an end that makes a new minimum has no begin; the others pair up within levels
    of s - m. One exchange on (path, id) serves all windows.
    """
    w = Window.partitionBy("path", "id").orderBy("line_no", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "B", 1).otherwise(-1)
    df = marks.withColumn("_s", F.sum(step).over(upto))
    df = df.withColumn("_m", F.least(F.lit(0), F.min("_s").over(upto))).withColumn("_pm", F.least(F.lit(0), F.coalesce(F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    df = df.withColumn("_lost", (F.col("kind") == "E") & (F.col("_s") < F.col("_pm")))
    df = df.withColumn("_lvl", F.when(F.col("_lost"), F.lit(-1)).otherwise(F.col("_s") - F.col("_m") + F.when(F.col("kind") == "B", 0).otherwise(1)))
    v = Window.partitionBy("path", "id", "_lvl").orderBy("line_no", "seq")
    df = df.withColumn("_next", F.lead("kind").over(v)).withColumn("_end", F.lead("line_no").over(v))
    state = F.when(F.col("_lost"), "unpaired_end").when((F.col("kind") == "B") & (F.col("_next") == "E"), "anchor").when(F.col("kind") == "B", "unpaired_begin")
    return df.withColumn("state", state).filter("state is not null").select("path", "line_no", "kind", "id", "tags", "version", "state", F.when(F.col("state") == "anchor", F.col("_end")).alias("end_no"))


def parse(files: DataFrame, with_hash: bool = False) -> DataFrame:
    """``id, tags, version, path, start_line, end_line, content`` (and ``hash``) of every block.

    The range is that of the markers; the content the lines strictly between, null if there are none. Markers of inner
    blocks stay in the content of outer ones.
    """
    blocks = paired(markers(files)).filter("state = 'anchor'").select("path", "id", "tags", "version", F.col("line_no").alias("start_line"), F.col("end_no").alias("end_line"))
    texts = files.filter(F.contains("content", F.lit("Q:begin"))).select(F.col("path").alias("_path"), lines_of(F.col("content")).alias("_lines"))
    size = (F.col("end_line") - F.col("start_line") - 1).cast("int")
    body = F.when(size > 0, F.array_join(F.slice("_lines", (F.col("start_line") + 1).cast("int"), F.greatest(size, F.lit(0))), "\n"))
    out = blocks.join(texts, F.col("path") == F.col("_path")).select("id", "tags", "version", "path", "start_line", "end_line", body.alias("content"))
    return out.withColumn("hash", xxh3_hex()("content")) if with_hash else out


def listed(anchors: DataFrame, tag: str | None = None, brief: bool = False) -> DataFrame:
    """Blocks in order of path and start, with one tag, without content if brief."""
    df = anchors.filter(F.array_contains("tags", tag)) if tag is not None else anchors
    df = df.drop("content", "hash") if brief else df
    return df.orderBy("path", "start_line", "end_line", "id")


def get(anchors: DataFrame, anchor_id: str, last: bool = True) -> DataFrame:
    """The last (or the first) block of an id in order of path and end: at most one row."""
    order = [F.desc("path"), F.desc("end_line"), F.desc("start_line")] if last else [F.asc("path"), F.asc("start_line"), F.asc("end_line")]
    return anchors.filter(F.col("id") == anchor_id).orderBy(*order).limit(1)


def overlap(tags: Column, target: Column) -> Column:
    """How many of the tags, repeated ones each, are among the target's."""
    return F.size(F.filter(tags, lambda t: F.array_contains(target, t)))


def neighbors(anchors: DataFrame, anchor_id: str, most: int) -> DataFrame:
    """Blocks of other ids that share tags with a block, most shared first: ``id, path, start_line, end_line, shared``."""
    target = get(anchors, anchor_id).select(F.col("tags").alias("_tags"))
    shared = F.coalesce(overlap(F.col("tags"), F.col("_tags")), F.lit(0))
    near = anchors.filter(F.col("id") != anchor_id).join(F.broadcast(target), F.arrays_overlap("tags", "_tags")).select("id", "path", "start_line", "end_line", shared.alias("shared"))
    return near.filter("shared > 0").orderBy(F.desc("shared"), "path", "end_line", "start_line", "id").limit(most)


def lint(files: DataFrame, large: int = LARGE_LINES) -> DataFrame:
    """``code, severity, path, line_no, id, n``: unpaired, empty, large and repeated blocks.

    Markers are paired once; every pair gives the findings that hold for it, and how often ids occur is counted before it
    is looked up.
    """
    pairs = paired(markers(files))
    blocks = F.col("state") == "anchor"
    several = pairs.filter(blocks).groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    size = F.col("end_no") - F.col("line_no") - 1
    found = lambda when, code, severity, n: F.when(when, F.struct(code.alias("code"), F.lit(severity).alias("severity"), n.cast("bigint").alias("n")))
    each = F.array(
        found(~blocks, F.upper("state"), "error", F.lit(1)),
        found(blocks & (size <= 0), F.lit("EMPTY_ANCHOR"), "warning", F.lit(0)),
        found(blocks & (size > large), F.lit("LARGE_ANCHOR"), "warning", size),
        found(blocks & F.col("_times").isNotNull(), F.lit("DUPLICATE_ID"), "error", F.col("_times")),
    )
    rows = pairs.join(several, F.col("id") == F.col("_id"), "left").select("path", "line_no", "id", F.inline(F.array_compact(each)))
    return rows.select("code", "severity", "path", "line_no", "id", "n")


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, version`` of blocks whose content changed between two snapshots and whose version didn't."""
    a = before.groupBy("id", "version").agg(F.array_sort(F.collect_set(F.coalesce("content", F.lit("")))).alias("x"))
    b = after.groupBy("id", "version").agg(F.array_sort(F.collect_set(F.coalesce("content", F.lit("")))).alias("y"))
    return a.join(b, ["id", "version"]).filter("x <> y").select("id", "version")


def mark(files: DataFrame, specs: DataFrame) -> DataFrame:
    """``path, new_content, marks, failed``: files with markers set around line ranges.

    ``specs``: ``path, start_line, end_line, id, tags, version``. Ranges of a file are applied from the bottom up, each
    on the text as it then is; an end past the last line counts as the last, a start past it appends an empty block, and
    a start further out fails. A final line end stays. Files without specs don't come out; specs without a file neither.
    """
    told = F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("id").alias("i"), F.coalesce("tags", F.array().cast("array<string>")).alias("t"), F.coalesce("version", F.lit(1)).alias("v"))
    asked = specs.groupBy(F.col("path").alias("_path")).agg(F.reverse(F.array_sort(F.collect_list(told))).alias("_specs"))
    df = files.join(asked, F.col("path") == F.col("_path")).withColumn("_lines", lines_of(F.col("content")))
    zero = F.struct(F.col("_lines").alias("x"), F.lit(0).alias("ok"), F.lit(0).alias("bad"))

    def put(acc, m):
        n = F.size(acc["x"])
        tags = F.when(F.size(m["t"]) > 0, F.concat(F.lit(" tags="), F.array_join(m["t"], ","))).otherwise(F.lit(""))
        begin = F.concat(F.lit("<!--Q:begin id="), m["i"], tags, F.lit(" v="), m["v"].cast("string"), F.lit("-->"))
        end = F.concat(F.lit("<!--Q:end id="), m["i"], F.lit("-->"))
        s = m["s"].cast("int")
        e = F.least(m["e"].cast("int"), n)
        inner = F.slice(acc["x"], s, F.greatest(e - s + 1, F.lit(0)))
        rest = F.slice(acc["x"], F.greatest(e, s - 1) + 1, n)
        made = F.concat(F.slice(acc["x"], 1, s - 1), F.array(begin), inner, F.array(end), rest)
        fine = (s >= 1) & (s <= n + 1) & (m["e"] >= m["s"])
        return F.when(fine, F.struct(made.alias("x"), (acc["ok"] + 1).alias("ok"), acc["bad"].alias("bad"))).otherwise(F.struct(acc["x"].alias("x"), acc["ok"].alias("ok"), (acc["bad"] + 1).alias("bad")))

    done = df.select("path", F.endswith("content", F.lit("\n")).alias("_nl"), F.aggregate("_specs", zero, put).alias("r"))
    return done.select("path", F.concat(F.array_join("r.x", "\n"), F.when(F.col("_nl"), "\n").otherwise("")).alias("new_content"), F.col("r.ok").alias("marks"), F.col("r.bad").alias("failed"))


def unmark(files: DataFrame, asked: DataFrame) -> DataFrame:
    """``path, id, new_content, removed``: files without the first begin and the first end marker line of an id.

    ``asked``: ``path, id``, one row a file. A marker counts at the start of its line, after blanks. ``removed`` is 0 to 2.
    """
    q = lambda c: F.regexp_replace(c, r"([\\.\[\](){}*+?^$|\-])", r"\\$1")
    df = files.join(asked.select(F.col("path").alias("_path"), F.col("id")), F.col("path") == F.col("_path")).withColumn("_lines", lines_of(F.col("content")))
    at = lambda what: F.concat(F.lit(rf"^\s*<!--\s*Q:{what}\s+id="), q("id"), F.lit(r"[\s-]"))
    first = lambda what: F.array_position(F.transform("_lines", lambda x: F.regexp_like(x, at(what))), True)
    df = df.withColumn("_b", first("begin")).withColumn("_e", first("end"))
    kept = F.filter("_lines", lambda x, i: (i + 1 != F.col("_b")) & (i + 1 != F.col("_e")))
    text = F.concat(F.array_join(kept, "\n"), F.when(F.endswith("content", F.lit("\n")) & (F.size(kept) > 0), "\n").otherwise(""))
    return df.select("path", "id", text.alias("new_content"), ((F.col("_b") > 0).cast("int") + (F.col("_e") > 0).cast("int")).alias("removed"))




def lint_reads(read: DataFrame) -> DataFrame:
    """What a bounded read warned of, as findings: ``code, severity, path, line_no, id, n``."""
    rows = read.select("path", F.explode(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.when(F.col("skipped"), F.array(F.lit("FILE_SKIPPED"))).otherwise(F.array().cast("array<string>")))).alias("code"))
    return rows.select("code", F.lit("warning").alias("severity"), "path", F.lit(1).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("id"), F.lit(1).cast("bigint").alias("n"))
