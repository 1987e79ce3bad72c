"""The one row type that commands give, its order, and how it is written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import cut_lineage

RESULTS = (
    "kind string, path string, range struct<unit:string,start:bigint,end:bigint>, excerpt string, data string, confidence string, source_mode string,"
    " meta struct<mtime_ms:bigint,size:bigint,hash:string,truncated:boolean>, errors array<struct<code:string,message:string>>"
)
#: Order of the groups in Markdown.
GROUPS = (("error", "Errors"), ("file", "Files"), ("match", "Matches"), ("extract", "Extracts"), ("anchor", "Anchors"), ("flow", "Flow Results"))


def to_results(df: DataFrame, kind: str, source_mode: str, confidence: str = "high", start: str | None = None, end: str | None = None, excerpt: str | None = None, data: Column | None = None) -> DataFrame:
    """Rows of any operator as result rows."""
    has = lambda c: F.col(c) if c and c in df.columns else F.lit(None)
    span = F.when(has(start).isNotNull(), F.struct(F.lit("line").alias("unit"), has(start).cast("bigint").alias("start"), F.coalesce(has(end), has(start)).cast("bigint").alias("end"))) if start else F.lit(None)
    meta = F.struct(has("mtime_ms").cast("bigint").alias("mtime_ms"), has("size").cast("bigint").alias("size"), has("hash").cast("string").alias("hash"), F.coalesce(has("truncated").cast("boolean"), F.lit(False)).alias("truncated"))
    return df.select(
        F.lit(kind).alias("kind"), has("path").cast("string").alias("path"), span.cast("struct<unit:string,start:bigint,end:bigint>").alias("range"), has(excerpt).cast("string").alias("excerpt"),
        (data if data is not None else F.lit(None)).cast("string").alias("data"), F.lit(confidence).alias("confidence"), F.lit(source_mode).alias("source_mode"), meta.alias("meta"),
        F.lit(None).cast("array<struct<code:string,message:string>>").alias("errors"),
    )


def in_order(results: DataFrame) -> DataFrame:
    """By path and start; rows without a path last, without a range last within a path."""
    return results.orderBy(F.col("path").asc_nulls_last(), F.col("range.start").asc_nulls_last(), "kind", "excerpt")


def jsonl(results: DataFrame) -> DataFrame:
    """``line``: one JSON object a row, without nulls."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("line"))


def markdown(results: DataFrame) -> DataFrame:
    """``group_no, place, line``: headings and items as lines in order; join them to get the document."""
    no = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, (k, _) in enumerate(GROUPS)), F.lit(len(GROUPS)))
    w = Window.partitionBy("group_no").orderBy(F.col("path").asc_nulls_last(), F.col("range.start").asc_nulls_last(), "excerpt")
    where = F.when(F.col("range").isNotNull(), F.concat_ws("", F.lit(":"), F.col("range.start").cast("string"), F.lit("-"), F.col("range.end").cast("string"))).otherwise(F.lit(""))
    items = results.withColumn("group_no", no).select("group_no", F.row_number().over(w).alias("place"), F.concat(F.lit("- "), F.coalesce("path", F.lit("?")), where).alias("line"))
    titles = F.element_at(F.array(*(F.lit(f"## {t}") for _, t in GROUPS), F.lit("## Other")), F.col("group_no") + 1)
    heads = items.select("group_no").distinct().select("group_no", F.lit(0).alias("place"), titles.alias("line"))
    return heads.unionByName(items)


def raw(results: DataFrame) -> DataFrame:
    """One row ``text``: excerpts in order, parted by a rule. For results that a driver may hold."""
    return results.filter("excerpt is not null").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("path", F.lit("~")).alias("p"), F.coalesce(F.col("range.start"), F.lit(0)).alias("s"), F.col("excerpt").alias("e")))), lambda x: x["e"]), "\n---\n").alias("text"))


def json_array(results: DataFrame) -> DataFrame:
    """One row ``text``: all rows in order as one JSON array. For results that a driver may hold."""
    key = F.struct(F.coalesce("path", F.lit("\U0010ffff")).alias("p"), F.coalesce(F.col("range.start"), F.lit((1 << 63) - 1)).alias("s"), F.to_json(F.struct(*results.columns)).alias("j"))
    return results.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["j"]), ","), F.lit("]")).alias("text"))


def written(results: DataFrame, form: str = "jsonl") -> DataFrame:
    """The rows in a format: ``jsonl``, ``json``, ``md`` or ``raw``; another name is an error."""
    forms = {"jsonl": jsonl, "json": json_array, "md": markdown, "markdown": markdown, "raw": raw}
    if form.lower() not in forms:
        raise ValueError(f"unknown format {form!r}; known are {', '.join(sorted(forms))}")
    return forms[form.lower()](results)


def dot(graph: DataFrame) -> DataFrame:
    """``place, line``: the graph in DOT, one line a node or edge, nodes by their names."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    node = graph.select(F.col("src").alias("n")).union(graph.select(F.col("dst").alias("n"))).distinct()
    nodes = node.select(F.lit(1).alias("part"), F.concat(F.lit("  "), q(F.col("n")), F.lit(" [label="), q(F.substring_index("n", "/", -1)), F.lit("];")).alias("line"))
    edges = graph.distinct().select(F.lit(2).alias("part"), F.concat(F.lit("  "), q(F.col("src")), F.lit(" -> "), q(F.col("dst")), F.lit(";")).alias("line"))
    frame = graph.sparkSession.createDataFrame([(0, "digraph dependencies {"), (3, "}")], "part int, line string")
    return frame.unionByName(nodes).unionByName(edges)


def mermaid(graph: DataFrame) -> DataFrame:
    """``src_id, dst_id, line``: edges with ids N0, N1, ... in order of the node names.

    Numbers come from ranges of sorted names and the sizes of the ranges before, so no task sees all nodes.
    """
    node = graph.select(F.col("src").alias("n")).union(graph.select(F.col("dst").alias("n"))).distinct()
    spark = graph.sparkSession
    ranged = node.repartitionByRange("n").sortWithinPartitions("n").withColumn("_p", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = sorted((r._p, r.k) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("k")).collect())  # one row a partition
    before, start = 0, []
    for p, k in sizes:
        start.append((p, before))
        before += k
    offsets = spark.createDataFrame(start or [(0, 0)], "_p int, _start long")
    w = Window.partitionBy("_p").orderBy("n")
    ids = ranged.join(F.broadcast(offsets), "_p").select("n", (F.col("_start") + F.row_number().over(w) - 1).alias("id"))
    a, b = ids.select(F.col("n").alias("src"), F.col("id").alias("src_id")), ids.select(F.col("n").alias("dst"), F.col("id").alias("dst_id"))
    return graph.distinct().join(a, "src").join(b, "dst").select("src_id", "dst_id", F.concat(F.lit("  N"), F.col("src_id").cast("string"), F.lit(" --> N"), F.col("dst_id").cast("string")).alias("line"))


def tree(graph: DataFrame) -> DataFrame:
    """``src, place, line``: what each file imports, with branches."""
    w = Window.partitionBy("src").orderBy("dst")
    return graph.distinct().select("src", F.row_number().over(w).alias("place"), F.concat(F.when(F.lead("dst").over(w).isNull(), "└── ").otherwise("├── "), F.col("dst")).alias("line"))


def deps_table(imports: DataFrame, graph: DataFrame, width: int = 40) -> DataFrame:
    """``src, n, deps``: imports of each file counted, and the names of what they resolve to, cut to ``width`` characters."""
    n = imports.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    names = graph.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("dst", "/", -1))), ", ").alias("deps"))
    deps = F.coalesce("deps", F.lit(""))
    return n.join(names, "src", "left").select("src", "n", F.when(F.length(deps) > width, F.concat(F.substring(deps, 1, width - 3), F.lit("..."))).otherwise(deps).alias("deps"))


def outline_markdown(items: DataFrame) -> DataFrame:
    """``path, place, line``: a heading for each file and its blocks below, indented by level."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line", "id")
    span = F.concat(F.lit(" (L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    rows = items.select("path", F.row_number().over(w).alias("place"), F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), "id", span, F.coalesce(F.concat(F.lit(": "), "preview"), F.lit(""))).alias("line"))
    heads = items.select("path").distinct().select("path", F.lit(0).alias("place"), F.concat(F.lit("## "), "path").alias("line"))
    return heads.unionByName(rows)


def outline_tree(items: DataFrame) -> DataFrame:
    """``path, place, line``: blocks of each file with branches, the last one closing."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line", "id")
    glyph = F.when(F.lead("id").over(w).isNull(), "└── ").otherwise("├── ")
    return items.select("path", F.row_number().over(w).alias("place"), F.concat(glyph, F.repeat(F.lit("  "), F.col("level")), F.col("id")).alias("line"))


def summary_rows(one: DataFrame) -> DataFrame:
    """``name, value`` of a row of totals, one row a column."""
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in one.columns))
    return one.select(F.inline(each))


def impact_results(impact: DataFrame) -> DataFrame:
    """Affected files as result rows: changed ones with high, direct with medium, others with low confidence."""
    rows = to_results(impact, "flow", "mixed", data=F.to_json(F.struct(F.col("kind").alias("impact_type"), "steps")))
    sure = F.when(F.get_json_object("data", "$.impact_type") == "changed", "high").when(F.get_json_object("data", "$.impact_type") == "direct_impact", "medium").otherwise("low")
    return rows.withColumn("confidence", sure)
