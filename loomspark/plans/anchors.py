"""Queries over blocks parsed from documents, and over the given tables of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.paths import base_name
from loomspark.operators import anchors as A
from loomspark.operators import rows as R
from loomspark.plans.corpus import docs_of
from loomspark.plans.sql import BLOCKS, DOCS, EXT, MARKED, MARKS, TAGS, parts
from loomspark.sources.tables import table


def specs_of(files: DataFrame) -> DataFrame:
    """Two blocks for each file, lines 1 to 3, and line 2 inside of them; a third is out of range and fails."""
    spec = lambda a, b, i, t, v: F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), i.alias("id"), t.cast("array<string>").alias("tags"), F.lit(v).alias("version"))
    return files.select(
        "path",
        F.inline(F.array(
            spec(1, 3, F.concat(F.lit("outer."), base_name(F.col("path"))), F.array(F.lit("scan"), F.substring_index("path", "/", 1)), 3),
            spec(2, 2, F.lit("inner"), F.array(), 2),
            spec(500_000, 500_001, F.lit("far"), F.array(), 1),
        )),
    )


def marked(files: DataFrame) -> DataFrame:
    """Files with these blocks set."""
    return A.mark(files, specs_of(files))


def marked_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with such blocks."""
    return marked(docs_of(spark, folder)).select("path", F.col("new_content").alias("content"))


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all these documents."""
    return A.parse(marked_docs(spark, folder))


def given(spark: SparkSession, folder: str) -> DataFrame:
    """The given blocks, one row for each delivery."""
    return table(spark, folder, "anchors").select("anchor_key", "id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "version", "path", "start_line", "end_line", "content")


def _first_id(spark: SparkSession, folder: str) -> str:
    return table(spark, folder, "anchors").agg(F.min("id")).first()[0] or ""


def anchors_list(spark: SparkSession, folder: str) -> DataFrame:
    """All blocks with content."""
    return A.listed(parsed(spark, folder)).withColumn("tags", F.array_join("tags", ","))


def anchors_tag(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with a tag."""
    return A.listed(parsed(spark, folder), tag="scan", brief=True).select("id", "path", "start_line", "end_line", "version")


def anchors_brief(spark: SparkSession, folder: str) -> DataFrame:
    """All blocks without content."""
    return A.listed(parsed(spark, folder), brief=True).withColumn("tags", F.array_join("tags", ","))


def anchors_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose extension may hold blocks."""
    return A.candidates(docs_of(spark, folder)).select("path")


def anchors_hash(spark: SparkSession, folder: str) -> DataFrame:
    """XXH3 of every block's content."""
    return A.parse(marked_docs(spark, folder), with_hash=True).select("id", "path", "start_line", "hash")


def anchors_get(spark: SparkSession, folder: str) -> DataFrame:
    """The last block of the first id."""
    return A.get(given(spark, folder), _first_id(spark, folder)).select("id", "path", "start_line", "end_line")


def anchors_get_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first block of the first id."""
    return A.get(given(spark, folder), _first_id(spark, folder), last=False).select("id", "path", "start_line", "end_line")


def anchors_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest blocks by shared tags."""
    return A.neighbors(given(spark, folder), _first_id(spark, folder), 20)


def lint_all(spark: SparkSession, folder: str) -> DataFrame:
    """All findings in documents."""
    return A.lint(marked_docs(spark, folder), large=2)


def _lint(*codes: str):
    return lambda spark, folder: lint_all(spark, folder).filter(F.col("code").isin(*codes))


def lint_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The findings as the command reports them."""
    return R.lint_rows(lint_all(spark, folder)).select("kind", "path", F.col("range.start").alias("line_no"), "excerpt", "confidence", F.col("errors")[0]["code"].alias("code"))


def mark_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What setting the marks reports of each."""
    docs = docs_of(spark, folder)
    return R.mark_rows(docs, specs_of(docs)).select("kind", "path", F.col("range.start").alias("first_line"), F.col("range.end").alias("last_line"), "excerpt", "confidence")


def anchors_mark(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with marks set."""
    return marked(docs_of(spark, folder)).select("path", "new_content", "marks", "failed")


def anchors_unmark(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that has blocks, without the markers of its first id."""
    docs = marked_docs(spark, folder)
    asked = A.markers(docs).groupBy("path").agg(F.min("id").alias("id"))
    return A.unmark(docs, asked)


def anchors_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Ids whose content differs between the first and the last delivery while the version doesn't."""
    t = table(spark, folder, "anchors").select("id", "version", "content", "anchor_key")
    first = t.groupBy("id").agg(F.min_by(F.struct("version", "content"), "anchor_key").alias("x")).select("id", "x.version", "x.content")
    last = t.groupBy("id").agg(F.max_by(F.struct("version", "content"), "anchor_key").alias("x")).select("id", "x.version", "x.content")
    return A.drifted(first, last)


_LINT = f"""{MARKS}, b AS (SELECT *, end_no - line_no - 1 AS size, count(*) OVER (PARTITION BY id) AS times FROM pr WHERE state = 'anchor'), found AS (
SELECT upper(state) AS code, 'error' AS severity, path, line_no, id, CAST(1 AS BIGINT) AS n FROM pr WHERE state <> 'anchor'
UNION ALL SELECT 'EMPTY_ANCHOR', 'warning', path, line_no, id, 0 FROM b WHERE size <= 0
UNION ALL SELECT 'LARGE_ANCHOR', 'warning', path, line_no, id, size FROM b WHERE size > 2
UNION ALL SELECT 'DUPLICATE_ID', 'error', path, line_no, id, times FROM b WHERE times > 1)"""
_BLOCK = "('Anchor ' || chr(39) || coalesce(id, '?') || chr(39))"
_GIVEN = "a AS (SELECT id, coalesce(tags, []) AS tags, version, path, start_line, end_line, content FROM anchors), one AS (SELECT min(id) AS id FROM anchors)"
_LAST = "SELECT a.* FROM a JOIN one USING (id) ORDER BY path DESC, end_line DESC, start_line DESC LIMIT 1"
_EXTS = ", ".join(f"'{e}'" for e in A.EXTENSIONS)

QUERIES = {
    "anchors_list": anchors_list,
    "anchors_tag": anchors_tag,
    "anchors_brief": anchors_brief,
    "anchors_candidates": anchors_candidates,
    "anchors_hash": anchors_hash,
    "anchors_get": anchors_get,
    "anchors_get_first": anchors_get_first,
    "anchors_neighbors": anchors_neighbors,
    "lint_all": lint_all,
    "lint_unpaired": _lint("UNPAIRED_BEGIN", "UNPAIRED_END"),
    "lint_empty_large": _lint("EMPTY_ANCHOR", "LARGE_ANCHOR"),
    "lint_duplicate": _lint("DUPLICATE_ID"),
    "lint_rows": lint_rows,
    "mark_rows": mark_rows,
    "anchors_mark": anchors_mark,
    "anchors_unmark": anchors_unmark,
    "anchors_drift": anchors_drift,
}
SQL = {
    "anchors_list": f"WITH {BLOCKS} SELECT id, array_to_string({TAGS}, ',') AS tags, version, path, start_line, end_line, content FROM a",
    "anchors_tag": f"WITH {BLOCKS} SELECT id, path, start_line, end_line, version FROM a WHERE list_contains({TAGS}, 'scan')",
    "anchors_brief": f"WITH {BLOCKS} SELECT id, array_to_string({TAGS}, ',') AS tags, version, path, start_line, end_line FROM a",
    "anchors_candidates": f"WITH {DOCS} SELECT path FROM d WHERE lower({EXT}) IN ({_EXTS})",
    "anchors_get": f"WITH {_GIVEN} SELECT id, path, start_line, end_line FROM ({_LAST})",
    "anchors_get_first": f"WITH {_GIVEN} SELECT a.id, path, start_line, end_line FROM a JOIN one USING (id) ORDER BY path, start_line, end_line LIMIT 1",
    "anchors_neighbors": f"""WITH {_GIVEN}, t AS ({_LAST})
SELECT a.id, a.path, a.start_line, a.end_line, CAST(len(list_filter(a.tags, lambda x: list_contains(t.tags, x))) AS INT) AS shared FROM a, t WHERE a.id <> t.id AND list_has_any(a.tags, t.tags)
ORDER BY shared DESC, a.path, a.end_line, a.start_line, a.id LIMIT 20""",
    "lint_all": f"WITH {_LINT} SELECT * FROM found",
    "lint_unpaired": f"WITH {_LINT} SELECT * FROM found WHERE code IN ('UNPAIRED_BEGIN', 'UNPAIRED_END')",
    "lint_empty_large": f"WITH {_LINT} SELECT * FROM found WHERE code IN ('EMPTY_ANCHOR', 'LARGE_ANCHOR')",
    "lint_duplicate": f"WITH {_LINT} SELECT * FROM found WHERE code = 'DUPLICATE_ID'",
    "lint_rows": f"""WITH {_LINT} SELECT 'error' AS kind, path, line_no, CASE code WHEN 'EMPTY_ANCHOR' THEN {_BLOCK} || ' is empty' WHEN 'LARGE_ANCHOR' THEN {_BLOCK} || ' has ' || n || ' lines'
WHEN 'DUPLICATE_ID' THEN replace({_BLOCK}, 'Anchor ', 'Anchor id ') || ' is used ' || n || ' times' ELSE replace({_BLOCK}, 'Anchor ', code || ' ') END AS excerpt, CASE severity WHEN 'error' THEN 'high' ELSE 'medium' END AS confidence, code FROM found""",
    "mark_rows": f"""WITH {DOCS}, s AS (SELECT unnest([1, 2, 500000]) AS s, unnest([3, 2, 500001]) AS e),
x AS (SELECT path, s, e, CASE s WHEN 1 THEN 'outer.' || regexp_extract(path, '[^/]*$') WHEN 2 THEN 'inner' ELSE 'far' END AS id, len({parts('content')}) AS n FROM d CROSS JOIN s),
y AS (SELECT *, s > n + 1 AS bad FROM x)
SELECT CASE WHEN bad THEN 'error' ELSE 'anchor' END AS kind, path, CASE WHEN NOT bad THEN CAST(s AS BIGINT) END AS first_line, CASE WHEN NOT bad THEN CAST(e + 2 AS BIGINT) END AS last_line,
CASE WHEN bad THEN 'Start line ' || s || ' is past the end of the file' ELSE 'Anchor ' || chr(39) || id || chr(39) || ' marked successfully' END AS excerpt, CASE WHEN bad THEN 'low' ELSE 'high' END AS confidence FROM y""",
    "anchors_mark": f"WITH {MARKED} SELECT path, content AS new_content, CASE WHEN n >= 1 THEN 2 ELSE 1 END AS marks, CASE WHEN n >= 1 THEN 1 ELSE 2 END AS failed FROM d",
    "anchors_unmark": f"""WITH {MARKS}, k AS (SELECT path, min(id) AS id FROM m WHERE id <> '' GROUP BY 1),
h AS (SELECT l.path, k.id, line_no, text, regexp_matches(text, '^\\s*<!--\\s*Q:begin\\s+id=' || regexp_escape(k.id) || '[\\s-]') AS b, regexp_matches(text, '^\\s*<!--\\s*Q:end\\s+id=' || regexp_escape(k.id) || '[\\s-]') AS e FROM l JOIN k USING (path)),
f AS (SELECT path, id, min(line_no) FILTER (WHERE b) AS fb, min(line_no) FILTER (WHERE e) AS fe FROM h GROUP BY 1, 2),
t AS (SELECT h.path, h.id, string_agg(text, chr(10) ORDER BY line_no) AS x FROM h JOIN f ON f.path = h.path WHERE line_no IS DISTINCT FROM fb AND line_no IS DISTINCT FROM fe GROUP BY 1, 2)
SELECT f.path, f.id, coalesce(x, '') || CASE WHEN x IS NOT NULL AND ends_with(content, chr(10)) THEN chr(10) ELSE '' END AS new_content, CAST(fb IS NOT NULL AS INT) + CAST(fe IS NOT NULL AS INT) AS removed
FROM f JOIN d USING (path) LEFT JOIN t USING (path)""",
    "anchors_drift": """WITH x AS (SELECT id, arg_min({'v': version, 'c': content}, anchor_key) AS a, arg_max({'v': version, 'c': content}, anchor_key) AS b FROM anchors GROUP BY id)
SELECT id, a.v AS version FROM x WHERE a.v = b.v AND coalesce(a.c, '') <> coalesce(b.c, '')""",
}
