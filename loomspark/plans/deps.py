"""Queries over imports and the graph they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.paths import lexical_path
from loomspark.operators import deps as D
from loomspark.operators import results
from loomspark.operators import rows as R
from loomspark.operators.syntax import ast_match
from loomspark.operators.anchors import parse
from loomspark.plans.anchors import marked
from loomspark.plans.corpus import files_of
from loomspark.plans.sql import EDGES, EXT, place
from loomspark.sources.tables import table


def graph_of(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of all resolved imports."""
    return D.edges(table(spark, folder, "imports"))


def changed_of(spark: SparkSession, folder: str) -> DataFrame:
    """Files that staged runs name as changed."""
    runs = table(spark, folder, "impact_runs").filter("source = 'staged'")
    return runs.select(F.explode("changed_files").alias("p")).distinct().select(lexical_path(F.col("p")).alias("path"))


def imports_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The module of every recorded line of code."""
    t = table(spark, folder, "imports")
    return t.select("import_id", D.module_of(F.col("import_text"), F.lower("language")).alias("parsed"))


def imports_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Imports found in the lines of code files."""
    return D.parse_imports(files_of(spark, folder).select("path", "content"))


def imports_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Where every import leads among all files that imports know of, the first segment being the root."""
    t = table(spark, folder, "imports").select("import_id", lexical_path(F.col("src")).alias("src"), F.lower("language").alias("language"), "module").filter("src is not null and module is not null")
    there = graph_of(spark, folder)
    there = there.select(F.col("src").alias("path")).union(there.select(F.col("dst").alias("path")))
    return D.resolve(t, there, root_segments=1).select("import_id", "resolved_path")


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Files by language."""
    return files_of(spark, folder).select(D.language_of(F.col("path")).alias("language")).filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def deps_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Files on cycles."""
    return D.on_cycles(graph_of(spark, folder))


def impact(spark: SparkSession, folder: str) -> DataFrame:
    """Changed, direct and transitive files of the staged runs."""
    return D.impacts(graph_of(spark, folder), changed_of(spark, folder))


def impact_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks, set in all files read, that stand in affected files."""
    files = files_of(spark, folder).filter("content is not null").select("path", "content")
    blocks = parse(marked(files).select("path", F.col("new_content").alias("content")))
    return D.affected_anchors(impact(spark, folder), blocks)


def impact_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many files are affected in which way."""
    return impact(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("steps").cast("int").alias("furthest"))


def deps_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The names that the dependency rows of all files list, in both directions."""
    known = table(spark, folder, "imports").select(lexical_path(F.col("src")).alias("path"), F.lower("language").alias("language"))
    rows = R.dependency_rows(graph_of(spark, folder), known)
    data = F.from_json("data", "depends_on array<string>, depended_by array<string>, language string")
    each = rows.select("path", data.alias("d"))
    return each.select("path", F.when(F.col("d.depends_on").isNotNull(), "depends_on").otherwise("depended_by").alias("way"), "d.language", F.explode_outer(F.coalesce("d.depends_on", "d.depended_by")).alias("name"))


def deps_cycle_rows(spark: SparkSession, folder: str) -> DataFrame:
    """An error row for each cycle."""
    rows = R.cycle_rows(deps_cycles(spark, folder))
    return rows.select("kind", "path", "confidence", F.col("errors")[0]["code"].alias("code"), F.col("errors")[0]["message"].alias("message"), "data")


def ast_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of one form in code files."""
    return ast_match(files_of(spark, folder).select("path", "content"), "require($A)")


_MODULE = """CASE WHEN lower(language) = 'rust' THEN coalesce(nullif(regexp_extract(t, '^(?:pub )?use (?:\\s*(?:crate|self|super)::)?\\s*([^:]*?)(?:::.*)?;$', 1), ''), nullif(trim(regexp_extract(t, '^(?:pub )?mod (.*);$', 1)), ''))
WHEN lower(language) IN ('typescript', 'javascript') THEN CASE WHEN t LIKE '%import %' OR t LIKE '%require(%' THEN coalesce(nullif(regexp_extract(t, 'from ''([^'']*)''', 1), ''), nullif(regexp_extract(t, 'from "([^"]*)"', 1), ''), nullif(regexp_extract(t, 'require\\(''(.*?)''\\)', 1), ''), nullif(regexp_extract(t, 'require\\("(.*?)"\\)', 1), '')) END
WHEN lower(language) = 'python' THEN coalesce(nullif(regexp_extract(t, '^import\\s+([^\\s.]+)', 1), ''), nullif(regexp_extract(t, '^from\\s+(\\S+)', 1), '')) END"""
_LANG = f"CASE {EXT} WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'py' THEN 'python' END"
_LATEST = "f AS (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY read_at DESC NULLS LAST, file_id DESC) = 1)"
_CHANGED = f"c AS (SELECT DISTINCT {place('p')} AS path FROM (SELECT unnest(changed_files) AS p FROM impact_runs WHERE source = 'staged'))"
_IMPACT = f"""WITH RECURSIVE {EDGES}, {_CHANGED}, r AS (SELECT path, 0 AS steps FROM c WHERE path IS NOT NULL UNION SELECT g.src, r.steps + 1 FROM r JOIN g ON g.dst = r.path WHERE r.steps < 4),
i AS (SELECT path, min(steps) AS steps FROM r GROUP BY 1), k AS (SELECT path, CASE steps WHEN 0 THEN 'changed' WHEN 1 THEN 'direct_impact' ELSE 'transitive_impact' END AS kind, CAST(steps AS INT) AS steps FROM i)"""


def _candidates() -> str:
    at = lambda base, rest: f"CASE WHEN {base} = '' THEN {rest} ELSE {base} || '/' || {rest} END"
    base = f"CASE WHEN starts_with(module, '.') THEN {at('dir', 'module')} WHEN starts_with(module, '/') THEN {at('root', chr(39).join(['regexp_replace(module, ', '^/+', ', ', '', ')']))} END"
    script = {k: "[" + ", ".join(f"b || '{e}'" for e in v) + "]" for k, v in D.SCRIPT_ENDINGS.items()}
    rust = "[" + ", ".join((at("root", "'src/' || module || '.rs'"), at("root", "'src/' || module || '/mod.rs'"), at("dir", "module || '.rs'"), at("dir", "module || '/mod.rs'"))) + "]"
    python = "[" + ", ".join((at("near", "rest || '.py'"), at("near", "rest || '/__init__.py'"), at("root", "rest || '.py'"), at("root", "rest || '/__init__.py'"))) + "]"
    return f"""WITH {EDGES}, there AS (SELECT src AS path FROM g UNION SELECT dst FROM g),
t AS (SELECT import_id, {place('src')} AS src, lower(language) AS language, module FROM imports WHERE module IS NOT NULL),
u AS (SELECT *, CASE WHEN src LIKE '%/%' THEN regexp_replace(src, '/[^/]*$', '') ELSE '' END AS dir, string_split(src, '/')[1] AS root FROM t WHERE src IS NOT NULL),
v AS (SELECT *, {base} AS b, length(regexp_extract(module, '^\\.*')) AS lvl, replace(regexp_replace(module, '^\\.+', ''), '.', '/') AS rest FROM u),
w AS (SELECT *, CASE WHEN lvl > 0 THEN array_to_string(string_split(dir, '/')[1:greatest(len(string_split(dir, '/')) - (lvl - 1), 0)], '/') ELSE root END AS near FROM v),
x AS (SELECT import_id, CASE language WHEN 'rust' THEN {rust} WHEN 'typescript' THEN {script['typescript']} WHEN 'javascript' THEN {script['javascript']} WHEN 'python' THEN {python} END AS places FROM w),
y AS (SELECT import_id, unnest(range(1, len(places) + 1)) AS rank, unnest(places) AS p FROM x),
z AS (SELECT import_id, arg_min(path, rank) AS resolved_path FROM (SELECT import_id, rank, {place('p')} AS path FROM y WHERE p IS NOT NULL) JOIN there USING (path) GROUP BY 1)
SELECT u.import_id, resolved_path FROM u LEFT JOIN z USING (import_id)"""


QUERIES = {
    "imports_parse": imports_parse,
    "imports_from_files": imports_from_files,
    "imports_resolve": imports_resolve,
    "languages": languages,
    "deps_forward": graph_of,
    "deps_reverse": lambda spark, folder: D.reverse(graph_of(spark, folder)),
    "deps_cycles": deps_cycles,
    "deps_rows": deps_rows,
    "deps_cycle_rows": deps_cycle_rows,
    "deps_dot": lambda spark, folder: results.dot(graph_of(spark, folder)),
    "deps_mermaid": lambda spark, folder: results.mermaid(graph_of(spark, folder)),
    "deps_tree": lambda spark, folder: results.tree(graph_of(spark, folder)),
    "deps_table": lambda spark, folder: results.deps_table(table(spark, folder, "imports").select(lexical_path(F.col("src")).alias("src")), graph_of(spark, folder)),
    "impact": impact,
    "impact_anchors": impact_anchors,
    "impact_summary": impact_summary,
    "ast_calls": ast_calls,
}
SQL = {
    "imports_parse": f"SELECT import_id, {_MODULE} AS parsed FROM (SELECT *, trim(import_text) AS t FROM imports)",
    "imports_from_files": f"""WITH {_LATEST}, x AS (SELECT path AS src, {_LANG} AS language, string_split(content, chr(10)) AS p FROM f WHERE content IS NOT NULL),
y AS (SELECT src, language, unnest(range(1, len(p) + 1)) AS line, trim(unnest(p)) AS t FROM x WHERE language IS NOT NULL)
SELECT src, language, line, t AS import_text, {_MODULE} AS module FROM y WHERE {_MODULE} IS NOT NULL""",
    "imports_resolve": _candidates(),
    "languages": f"WITH {_LATEST} SELECT {_LANG} AS language, count(*) AS n FROM f WHERE {_LANG} IS NOT NULL GROUP BY 1",
    "deps_forward": f"WITH {EDGES} SELECT src, dst FROM g",
    "deps_reverse": f"WITH {EDGES} SELECT dst AS path, src AS used_by FROM g WHERE dst IN (SELECT src FROM g)",
    "deps_cycles": f"""WITH RECURSIVE {EDGES}, r AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM r JOIN g ON g.src = r.dst), own AS (SELECT src FROM r WHERE src = dst)
SELECT r.src AS path, min(r.dst) AS cycle FROM r JOIN own ON own.src = r.src JOIN r b ON b.src = r.dst AND b.dst = r.src GROUP BY 1""",
    "deps_rows": f"""WITH {EDGES}, k AS (SELECT {place('src')} AS path, min(lower(language)) AS language FROM imports GROUP BY 1), w AS (SELECT unnest(['depends_on', 'depended_by']) AS way),
t AS (SELECT src AS path, 'depends_on' AS way, dst AS name FROM g UNION ALL SELECT dst, 'depended_by', src FROM g)
SELECT k.path, w.way, k.language, t.name FROM k CROSS JOIN w LEFT JOIN t ON t.path = k.path AND t.way = w.way WHERE k.path IS NOT NULL""",
    "deps_cycle_rows": f"""WITH RECURSIVE {EDGES}, r AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM r JOIN g ON g.src = r.dst), own AS (SELECT src FROM r WHERE src = dst),
c AS (SELECT r.src AS path, min(r.dst) AS cycle FROM r JOIN own ON own.src = r.src JOIN r b ON b.src = r.dst AND b.dst = r.src GROUP BY 1), l AS (SELECT cycle, list_sort(list(path)) AS names, count(*) AS n FROM c GROUP BY 1)
SELECT 'error' AS kind, cycle AS path, 'high' AS confidence, 'CIRCULAR_DEPENDENCY' AS code, 'Circular dependency detected: ' || array_to_string(names, ' -> ') AS message, CAST(to_json({{'cycle': names, 'cycle_length': n}}) AS VARCHAR) AS data FROM l""",
    "deps_dot": f"""WITH {EDGES}, n AS (SELECT src AS n FROM g UNION SELECT dst FROM g)
SELECT 0 AS part, 'digraph dependencies {{' AS line UNION ALL SELECT 3, '}}' UNION ALL SELECT 1, '  "' || n || '" [label="' || regexp_extract(n, '[^/]*$') || '"];' FROM n UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '";' FROM g""",
    "deps_mermaid": f"""WITH {EDGES}, n AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS id FROM (SELECT src AS n FROM g UNION SELECT dst FROM g))
SELECT a.id AS src_id, b.id AS dst_id, '  N' || a.id || ' --> N' || b.id AS line FROM g JOIN n a ON a.n = src JOIN n b ON b.n = dst""",
    "deps_tree": f"WITH {EDGES} SELECT src, CAST(row_number() OVER w AS INT) AS place, CASE WHEN lead(dst) OVER w IS NULL THEN '└── ' ELSE '├── ' END || dst AS line FROM g WINDOW w AS (PARTITION BY src ORDER BY dst)",
    "deps_table": f"""WITH {EDGES}, n AS (SELECT {place('src')} AS src, count(*) AS n FROM imports GROUP BY 1), x AS (SELECT src, array_to_string(list_sort(list(DISTINCT regexp_extract(dst, '[^/]*$'))), ', ') AS deps FROM g GROUP BY 1)
SELECT n.src, n, CASE WHEN length(deps) > 40 THEN left(deps, 37) || '...' ELSE coalesce(deps, '') END AS deps FROM n LEFT JOIN x ON x.src = n.src""",
    "impact": _IMPACT + " SELECT * FROM k",
    "impact_anchors": _IMPACT
    + f""", {_LATEST.replace("f AS", "ff AS", 1)}, b AS (SELECT path FROM ff WHERE content IS NOT NULL AND path IN (SELECT path FROM k) AND {EXT} IN ({", ".join(repr(e) for e in D.IMPACT_EXTENSIONS)}))
SELECT DISTINCT 'outer.' || regexp_extract(path, '[^/]*$') AS id FROM b UNION SELECT DISTINCT 'inner' FROM ff WHERE content <> '' AND path IN (SELECT path FROM b)""",
    "ast_calls": f"""WITH {_LATEST}, x AS (SELECT path, string_split(content, chr(10)) AS p FROM f WHERE content IS NOT NULL AND {_LANG} IS NOT NULL),
y AS (SELECT path, unnest(range(1, len(p) + 1)) AS n, unnest(p) AS t FROM x)
SELECT path, n AS start_line, n AS end_line, unnest(regexp_extract_all(t, 'require\\(''[^'']*''\\)')) AS excerpt FROM y""",
    "impact_summary": _IMPACT + " SELECT kind, count(*) AS n, max(steps) AS furthest FROM k GROUP BY 1",
}
