"""Imports, their resolution, the graph they form, and what a change in it affects."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.paths import extension, lexical_path
from loomspark.operators.anchors import IMPACT_EXTENSIONS
from loomspark.operators.corpus import lines
from loomspark.session import cut_lineage

#: Languages by extension, and what a JavaScript or TypeScript module name may stand for, in order.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python"}
SCRIPT_ENDINGS = {"typescript": ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx"), "javascript": ("", ".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx")}


def language_of(path):
    """The language an extension stands for; null for others."""
    return reduce(lambda acc, x: acc.when(extension(path) == x[0], x[1]), list(LANGUAGES.items())[1:], F.when(extension(path) == "rs", "rust"))


def module_of(text, language):
    """The module that a line of code imports, or null. Line-based: no syntax tree."""
    t = F.trim(text)
    some = lambda c: F.when(c != "", c)
    rust = F.coalesce(some(F.regexp_extract(t, r"^(?:pub )?use (?:\s*(?:crate|self|super)::)?\s*([^:]*?)(?:::.*)?;$", 1)), some(F.trim(F.regexp_extract(t, r"^(?:pub )?mod (.*);$", 1))))
    quoted = [r"from '([^']*)'", r'from "([^"]*)"', r"require\('(.*?)'\)", r'require\("(.*?)"\)']
    script = F.when(F.contains(t, F.lit("import ")) | F.contains(t, F.lit("require(")), F.coalesce(*(some(F.regexp_extract(t, q, 1)) for q in quoted)))
    python = F.coalesce(some(F.regexp_extract(t, r"^import\s+([^\s.]+)", 1)), some(F.regexp_extract(t, r"^from\s+(\S+)", 1)))
    return F.when(language == "rust", rust).when(language.isin("typescript", "javascript"), script).when(language == "python", python)


def parse_imports(files: DataFrame) -> DataFrame:
    """``src, language, line, import_text, module`` from the lines of code files (``path, content``)."""
    code = files.withColumn("language", language_of(F.col("path"))).filter("language is not null").select("path", "language", "content")
    rows = lines(code).withColumn("module", module_of(F.col("text"), F.col("language"))).filter("module is not null")
    return rows.select(F.col("path").alias("src"), "language", F.col("line_no").alias("line"), F.trim("text").alias("import_text"), "module")


def _up(path, n):
    """The folder n steps above a folder."""
    return F.array_join(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - n, F.lit(0))), "/")


def resolve(imports: DataFrame, files: DataFrame, root_segments: int = 0) -> DataFrame:
    """Adds ``resolved_path``: the first candidate place of each module that is a file, or null.

    Candidates are exploded with their rank and looked up by equality; only distinct (folder, module, language) triples
    go through that, so that a module imported a million times costs one lookup for each folder. Roots are the first
    ``root_segments`` segments of a path. Relative places are normalised.
    """
    src = F.col("src")
    folder = F.when(F.contains(src, F.lit("/")), F.regexp_replace(src, r"/[^/]*$", "")).otherwise(F.lit(""))
    root = F.array_join(F.slice(F.split(src, "/"), 1, root_segments), "/") if root_segments else F.lit("")
    df = imports.withColumn("_dir", folder).withColumn("_root", root)
    asked = df.select("_dir", "_root", "module", "language").distinct()
    at = lambda base, rest: F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))
    m, d, r = F.col("module"), F.col("_dir"), F.col("_root")
    rust = F.array(at(r, F.concat(F.lit("src/"), m, F.lit(".rs"))), at(r, F.concat(F.lit("src/"), m, F.lit("/mod.rs"))), at(d, F.concat(m, F.lit(".rs"))), at(d, F.concat(m, F.lit("/mod.rs"))))
    base = F.when(F.startswith(m, F.lit(".")), at(d, m)).when(F.startswith(m, F.lit("/")), at(r, F.regexp_replace(m, "^/+", "")))
    script = {k: F.transform(F.array(*map(F.lit, v)), lambda e: F.concat(base, e)) for k, v in SCRIPT_ENDINGS.items()}
    level = F.length(F.regexp_extract(m, r"^\.*", 0))
    rest = F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))
    near = F.when(level > 0, _up(d, level - 1)).otherwise(r)
    python = F.array(at(near, F.concat(rest, F.lit(".py"))), at(near, F.concat(rest, F.lit("/__init__.py"))), at(r, F.concat(rest, F.lit(".py"))), at(r, F.concat(rest, F.lit("/__init__.py"))))
    places = F.when(F.col("language") == "rust", rust).when(F.col("language") == "typescript", script["typescript"]).when(F.col("language") == "javascript", script["javascript"]).when(F.col("language") == "python", python)
    tried = asked.select("_dir", "_root", "module", "language", F.posexplode(places).alias("rank", "place")).withColumn("place", lexical_path(F.col("place")))
    there = files.select(F.col("path").alias("place")).distinct()
    first = tried.join(there, "place").groupBy("_dir", "_root", "module", "language").agg(F.min(F.struct("rank", "place")).alias("x")).select("_dir", "_root", "module", "language", F.col("x.place").alias("resolved_path"))
    keep = [c for c in imports.columns if c != "resolved_path"]
    return df.drop("resolved_path").join(first, ["_dir", "_root", "module", "language"], "left").select(*keep, "resolved_path")


def edges(imports: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of resolved imports, both as the places their spellings lead to."""
    found = imports.filter(F.trim("resolved_path") != "").select("src", "resolved_path").distinct()
    return found.select(lexical_path(F.col("src")).alias("src"), lexical_path(F.col("resolved_path")).alias("dst")).filter("src is not null and dst is not null").distinct()


def forward(graph: DataFrame, path: str | None = None) -> DataFrame:
    """``src, dst`` of one file or all."""
    return graph if path is None else graph.filter(F.col("src") == path)


def reverse(graph: DataFrame, path: str | None = None) -> DataFrame:
    """``path, used_by`` of one file or all files that are analysed themselves."""
    known = graph.select(F.col("src").alias("dst")).distinct()
    df = graph.join(known, "dst", "left_semi") if path is None else graph.filter(F.col("dst") == path)
    return df.select(F.col("dst").alias("path"), F.col("src").alias("used_by"))


def _rounds(most: int | None) -> Iterator[int]:
    """Rounds of a loop that ends by itself; an error if a given number doesn't do."""
    yield from count() if most is None else range(most)
    raise RuntimeError(f"not settled after {most} rounds")


def on_cycles(graph: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``path, cycle``: nodes of non-trivial components and of self-imports, named by the first path of the component.

    The graph is trimmed first: nodes without a way in or out can't be on a cycle and are peeled off, round by round.
    Of the rest, components come from forward and backward colouring: the least name that reaches a node, within nodes of
    that colour that reach the name back. Every round is an aggregation over edges; nothing goes to the driver but counts.
    """
    core = cut_lineage(graph.select("src", "dst").distinct())
    n = core.count()
    for _ in _rounds(max_rounds):
        core2 = core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        core2 = cut_lineage(core2.select("src", "dst"))
        m = core2.count()
        core = core2
        if m in (n, 0):
            break
        n = m
    out = None
    for _ in _rounds(max_rounds):
        if core.isEmpty():
            break
        color = _spread_min(core, "src", "dst", max_rounds)
        within = core.join(color.select(F.col("node").alias("src"), F.col("mark").alias("c1")), "src").join(color.select(F.col("node").alias("dst"), F.col("mark").alias("c2")), "dst").filter("c1 = c2").select("src", "dst", F.col("c1").alias("color"))
        within = cut_lineage(within)
        done = _reach_back(within, max_rounds)
        found = done.select(F.col("node").alias("path"), F.col("color").alias("cycle"))
        loops = within.filter("src = dst").select(F.col("src").alias("path"))
        several = found.groupBy("cycle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("cycle")
        part = found.join(several, "cycle", "left_semi").unionByName(found.join(loops, "path", "left_semi").join(several, "cycle", "left_anti"))
        part = cut_lineage(part.select("path", "cycle"))
        out = part if out is None else out.unionByName(part)
        gone = found.select("path")
        core = cut_lineage(within.select("src", "dst").join(gone.withColumnRenamed("path", "src"), "src", "left_anti").join(gone.withColumnRenamed("path", "dst"), "dst", "left_anti"))
    return out if out is not None else graph.select(F.col("src").alias("path"), F.col("src").alias("cycle")).limit(0)


def _spread_min(core: DataFrame, a: str, b: str, max_rounds: int | None) -> DataFrame:
    """``node, mark``: the least node from which each node is reached, itself included."""
    marks = core.select(F.col(a).alias("node")).union(core.select(F.col(b).alias("node"))).distinct().withColumn("mark", F.col("node"))
    marks = cut_lineage(marks)
    for _ in _rounds(max_rounds):
        sent = core.join(marks.withColumnRenamed("node", a), a).groupBy(F.col(b).alias("node")).agg(F.min("mark").alias("seen"))
        new = cut_lineage(marks.join(sent, "node", "left").select("node", F.least("mark", "seen").alias("mark"), (F.col("seen") < F.col("mark")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        marks = new.select("node", "mark")
        if not moved:
            break
    return marks


def _reach_back(within: DataFrame, max_rounds: int | None) -> DataFrame:
    """``node, color`` of the nodes that reach the node their colour is named by, over edges of one colour."""
    reached = cut_lineage(within.select(F.col("color").alias("node"), "color").distinct())
    edge = within.select(F.col("src").alias("from"), F.col("dst").alias("node"), "color")
    front = reached
    for _ in _rounds(max_rounds):
        new = edge.join(front, ["node", "color"]).select(F.col("from").alias("node"), "color").distinct().join(reached, ["node", "color"], "left_anti")
        new = cut_lineage(new)
        if new.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(new))
        front = new
    return reached


def impacts(graph: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """``path, kind, steps``: changed files, what imports them (direct), and what imports that, up to ``max_depth`` steps
    further (transitive). Each file once, with its least distance."""
    start = changed.select("path").filter("path is not null").distinct()
    seen = cut_lineage(start.withColumn("steps", F.lit(0)))
    front = seen
    back = cut_lineage(graph.select(F.col("dst").alias("path"), "src").distinct())  # read once, whatever it comes from
    for k in range(1, max_depth + 2):
        new = front.join(back, "path").select(F.col("src").alias("path")).distinct().join(seen, "path", "left_anti").withColumn("steps", F.lit(k))
        new = cut_lineage(new)
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        front = new
    kind = F.when(F.col("steps") == 0, "changed").when(F.col("steps") == 1, "direct_impact").otherwise("transitive_impact")
    return seen.select("path", kind.alias("kind"), "steps")


def affected_anchors(impact: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct ids of the blocks in affected files whose extension may hold any."""
    return anchors.filter(extension(F.col("path")).isin(*IMPACT_EXTENSIONS)).join(impact.select("path").distinct(), "path", "left_semi").select("id").distinct()
