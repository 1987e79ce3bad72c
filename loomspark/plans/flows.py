"""Queries of statistics, outlines, packing and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.heuristic import heuristic_tokens
from loomspark.functions.models import ALIASES, token_model
from loomspark.functions.paths import extension
from loomspark.operators import corpus, flows, results
from loomspark.plans.anchors import _first_id, given, marked_docs, parsed
from loomspark.plans.corpus import docs_of
from loomspark.plans.deps import _IMPACT, impact
from loomspark.plans.sql import BLOCKS, CJK_CLASS, DOCS, EXT, LINES, TAGS, heuristic, in_class, parts, utf8_cut
from loomspark.sources.tables import table


def file_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every text file."""
    return flows.file_stats(docs_of(spark, folder))


def project_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over documents with blocks."""
    return flows.project_stats(flows.file_stats(marked_docs(spark, folder)), parsed(spark, folder))


def top_files(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest files."""
    return flows.top_files(file_stats(spark, folder)).select("path", "chars", "tokens")


def stats_ext_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by extension."""
    stats = flows.file_stats(docs_of(spark, folder), ("md", "rst"))
    return stats.groupBy(extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def anchors_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks by tag."""
    return flows.anchors_by_tag(given(spark, folder))


def outline_items(spark: SparkSession, folder: str) -> DataFrame:
    """The outline of all documents."""
    return flows.outline(parsed(spark, folder)).withColumn("tags", F.array_join("tags", ","))


def outline_given(spark: SparkSession, folder: str) -> DataFrame:
    """The outline of the given blocks."""
    return flows.outline(given(spark, folder)).select("id", "path", "start_line", "end_line", "chars", "words", "cjk_chars", "tokens", "level")


def outline_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each tag in order."""
    return flows.outline_by_tag(flows.outline(parsed(spark, folder)))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return flows.request_items(table(spark, folder, "packs").select("pack_id", "anchors", "files"), given(spark, folder), docs_of(spark, folder))


def _pack(by_confidence: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return flows.pack(_items(spark, folder), table(spark, folder, "packs").select("pack_id", "max_tokens"), by_confidence)

    return run


def pack_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of every request."""
    return flows.pack_stats(_pack(True)(spark, folder), _items(spark, folder))


def outline_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """The outline of the given blocks as lines of Markdown."""
    return results.outline_markdown(flows.outline(_one_each(spark, folder)))


def outline_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a tree."""
    return results.outline_tree(flows.outline(_one_each(spark, folder)))


def _one_each(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of each given block."""
    return corpus.latest(given(spark, folder).withColumn("_k", F.struct("path", "start_line", "end_line", "id")).withColumn("_first", -F.col("anchor_key")), "_k", "_first").drop("_k", "_first")


def stats_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Totals as rows of name and value."""
    return results.summary_rows(project_stats(spark, folder))


def impact_results(spark: SparkSession, folder: str) -> DataFrame:
    """Affected files as result rows."""
    return results.impact_results(impact(spark, folder)).select("kind", "path", "data", "confidence", "source_mode")


def token_models(spark: SparkSession, folder: str) -> DataFrame:
    """Requests and their recorded tokens by the model their spelling means."""
    packs = table(spark, folder, "packs").select(token_model(F.col("token_model")).alias("model"), "estimated_tokens")
    return packs.groupBy("model").agg(F.count(F.lit(1)).alias("packs"), F.sum("estimated_tokens").alias("tokens"))


def stale_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded heuristic counts of documents that are missing or not what the text has now, with the right one."""
    stats = table(spark, folder, "file_stats").filter(token_model(F.col("token_model")) == "heuristic").select("stat_id", F.col("doc_id").alias("d"), F.col("tokens").alias("recorded"))
    now = table(spark, folder, "documents").select("doc_id", heuristic_tokens(F.col("text")).alias("tokens"))
    return stats.join(now, F.col("d") == F.col("doc_id")).filter(~F.col("recorded").eqNullSafe(F.col("tokens"))).select("stat_id", "doc_id", "recorded", "tokens")


def stale_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded outline counts that are missing or not those of any block of their id."""
    items = table(spark, folder, "outline_items").select("item_id", "id", F.col("tokens").alias("recorded"))
    now = table(spark, folder, "anchors").select(F.col("id").alias("a_id"), heuristic_tokens(F.col("content")).alias("tokens")).distinct()
    return items.join(now, (F.col("id") == F.col("a_id")) & (F.col("recorded") == F.col("tokens")), "left_anti")


def writing_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence for the first block."""
    return flows.writing(docs_of(spark, folder), given(spark, folder), _first_id(spark, folder), words=["cache", "plan"])


_EXTS = ", ".join(f"'{e}'" for e in flows.TEXT_EXTENSIONS)
_SPACE = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_STATS = f"""s AS (SELECT path, length(content) AS chars, length(regexp_replace(content, '[{_SPACE}]', '', 'g')) AS chars_no_space, len(regexp_extract_all(content, '[A-Za-z0-9]{{2,}}')) AS words, {in_class(CJK_CLASS, 'content')} AS cjk_chars,
CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CAST(ends_with(content, chr(10)) AS INT) END AS line_count, {heuristic('content')} AS tokens FROM d WHERE {EXT} IN ({_EXTS}))"""
_GIVEN = "a AS (SELECT id, coalesce(tags, []) AS tags, version, path, start_line, end_line, content FROM anchors)"
_OUTLINE = f"""o AS (SELECT *, coalesce(content, '') AS c FROM a WHERE {EXT} IN ({_EXTS})),
oo AS (SELECT o.*, list_filter(list_transform({parts('c')}, lambda x: regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '<!--'))[1] AS line,
  (SELECT count(*) FROM o b WHERE b.path = o.path AND b.start_line < o.start_line AND b.end_line > o.end_line AND b.id <> o.id) AS around FROM o)"""
_OUT = f"""length(c) AS chars, len(regexp_extract_all(c, '[A-Za-z0-9]{{2,}}')) AS words, {in_class(CJK_CLASS, 'c')} AS cjk_chars, {heuristic('c')} AS tokens, CAST(greatest(around, length(id) - length(replace(id, '.', ''))) AS INT) AS level"""
_ITEMS = f"""{DOCS}, {_GIVEN}, la AS (SELECT id, arg_max({{'p': path, 'c': content}}, {{'p': path, 'e': end_line, 's': start_line}}) AS x FROM a GROUP BY 1),
w AS (SELECT pack_id, unnest(range(0, len(anchors))) AS ord, unnest(anchors) AS want FROM packs),
v AS (SELECT pack_id, unnest(range(0, len(files))) + coalesce(len(anchors), 0) AS ord, unnest(files) AS want FROM packs),
items AS (SELECT pack_id, ord, 'anchor' AS kind, x.p AS path, x.c AS excerpt, 0 AS conf FROM w JOIN la ON la.id = want
  UNION ALL SELECT pack_id, ord, CASE WHEN d.path IS NULL THEN 'error' ELSE 'file' END, want, CASE WHEN d.path IS NULL THEN 'Error: File not found' ELSE content END, CASE WHEN d.path IS NULL THEN 2 ELSE 0 END FROM v LEFT JOIN d ON d.path = want)"""


def _packed(rank: str) -> str:
    return f"""WITH {_ITEMS}, t AS (SELECT items.*, max_tokens, {rank} AS rank, {heuristic("coalesce(path, '')")} + {heuristic("coalesce(excerpt, '')")} + 15 AS tokens FROM items JOIN packs USING (pack_id)),
c AS (SELECT *, sum(tokens) OVER z AS cum, row_number() OVER z AS place FROM t WINDOW z AS (PARTITION BY pack_id ORDER BY rank, ord)),
k AS (SELECT *, (max_tokens - (cum - tokens)) * 4 AS rest, max_tokens IS NULL OR cum <= max_tokens AS whole FROM c),
q AS (SELECT *, NOT whole AND strlen(excerpt) > rest AS cut FROM k WHERE whole OR (cum - tokens <= max_tokens AND rest > 100 AND excerpt IS NOT NULL)),
packed AS (SELECT pack_id, CAST(place AS INT) AS place, kind, path, tokens, cut, CASE WHEN cut THEN {utf8_cut('excerpt', 'CAST(rest AS INT)')} || '...[truncated]' ELSE excerpt END AS excerpt FROM q)"""


QUERIES = {
    "file_stats": file_stats,
    "project_stats": project_stats,
    "top_files": top_files,
    "stats_ext_filter": stats_ext_filter,
    "anchors_by_tag": anchors_by_tag,
    "outline_items": outline_items,
    "outline_given": outline_given,
    "outline_by_tag": outline_by_tag,
    "pack_budget": _pack(True),
    "pack_by_order": _pack(False),
    "pack_stats": pack_stats,
    "writing_evidence": writing_evidence,
    "outline_markdown": outline_markdown,
    "outline_tree": outline_tree,
    "stats_summary": stats_summary,
    "impact_results": impact_results,
    "token_models": token_models,
    "stale_counts": stale_counts,
    "stale_outlines": stale_outlines,
}
_MODEL = "CASE " + " ".join("WHEN lower(trim(token_model)) IN (" + ", ".join(f"'{x}'" for x in v) + f") THEN '{m}'" for m, v in ALIASES.items()) + " END"
_ONE = "a AS (SELECT id, coalesce(tags, []) AS tags, version, path, start_line, end_line, content FROM anchors QUALIFY row_number() OVER (PARTITION BY path, start_line, end_line, id ORDER BY anchor_key) = 1)"
_PREVIEW = "CASE WHEN length(line) > 60 THEN left(line, 60) || '...' ELSE line END"
_TOTALS = f"""WITH {BLOCKS}, {_STATS}, n AS (SELECT path, count(*) AS anchors FROM a GROUP BY 1),
t AS (SELECT CAST(count(*) AS BIGINT) AS files, {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("chars", "chars_no_space", "words", "cjk_chars", "line_count", "tokens", "anchors"))} FROM s LEFT JOIN n USING (path))"""
SQL = {
    "outline_markdown": f"""WITH {_ONE}, {_OUTLINE}, x AS (SELECT *, {_OUT}, {_PREVIEW} AS preview FROM oo)
SELECT DISTINCT path, 0 AS place, '## ' || path AS line FROM x UNION ALL
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start_line, end_line, id) AS INT), repeat('  ', level) || '- ' || id || ' (L' || start_line || '-' || end_line || ')' || coalesce(': ' || preview, '') FROM x""",
    "outline_tree": f"""WITH {_ONE}, {_OUTLINE}, x AS (SELECT *, {_OUT} FROM oo)
SELECT path, CAST(row_number() OVER w AS INT) AS place, CASE WHEN lead(id) OVER w IS NULL THEN '└── ' ELSE '├── ' END || repeat('  ', level) || id AS line FROM x WINDOW w AS (PARTITION BY path ORDER BY start_line, end_line, id)""",
    "stats_summary": _TOTALS + " SELECT name, CAST(value AS VARCHAR) AS value FROM (UNPIVOT t ON COLUMNS(*) INTO NAME name VALUE value)",
    "impact_results": _IMPACT + """ SELECT 'flow' AS kind, path, '{"impact_type":"' || kind || '","steps":' || steps || '}' AS data, CASE steps WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, 'mixed' AS source_mode FROM k""",
    "token_models": f"SELECT {_MODEL} AS model, count(*) AS packs, CAST(sum(estimated_tokens) AS BIGINT) AS tokens FROM packs GROUP BY 1",
    "stale_counts": f"""WITH n AS (SELECT doc_id, coalesce({heuristic('text')}, 0) AS tokens FROM documents)
SELECT stat_id, n.doc_id, s.tokens AS recorded, n.tokens FROM file_stats s JOIN n USING (doc_id) WHERE {_MODEL} = 'heuristic' AND s.tokens IS DISTINCT FROM n.tokens""",
    "stale_outlines": f"""WITH n AS (SELECT DISTINCT id, coalesce({heuristic('content')}, 0) AS tokens FROM anchors)
SELECT item_id, id, tokens AS recorded FROM outline_items o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = o.id AND n.tokens = o.tokens)""",
    "file_stats": f"WITH {DOCS}, {_STATS} SELECT * FROM s",
    "project_stats": f"""WITH {BLOCKS}, {_STATS}, n AS (SELECT path, count(*) AS anchors FROM a GROUP BY 1)
SELECT count(*) AS files, {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("chars", "chars_no_space", "words", "cjk_chars", "line_count", "tokens", "anchors"))} FROM s LEFT JOIN n USING (path)""",
    "top_files": f"WITH {DOCS}, {_STATS} SELECT path, chars, tokens FROM s ORDER BY chars DESC, path LIMIT 10",
    "stats_ext_filter": f"WITH {DOCS}, {_STATS} SELECT {EXT} AS ext, count(*) AS files, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens FROM s WHERE {EXT} IN ('md', 'rst') GROUP BY 1",
    "anchors_by_tag": "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM anchors) GROUP BY 1",
    "outline_items": f"WITH {BLOCKS}, {_OUTLINE} SELECT id, path, array_to_string({TAGS}, ',') AS tags, start_line, end_line, {_OUT}, CASE WHEN length(line) > 60 THEN left(line, 60) || '...' ELSE line END AS preview FROM oo",
    "outline_given": f"WITH {_GIVEN}, {_OUTLINE} SELECT id, path, start_line, end_line, {_OUT} FROM oo",
    "outline_by_tag": f"""WITH {BLOCKS}, x AS (SELECT unnest({TAGS}) AS tag, id, path, start_line, end_line FROM a WHERE {EXT} IN ({_EXTS}))
SELECT tag, id, CAST(row_number() OVER (PARTITION BY tag ORDER BY path, start_line, end_line, id) AS INT) AS place FROM x""",
    "pack_budget": _packed("conf") + " SELECT * FROM packed",
    "pack_by_order": _packed("0") + " SELECT * FROM packed",
    "pack_stats": _packed("conf") + f""", n AS (SELECT pack_id, count(*) AS asked FROM items GROUP BY 1),
g AS (SELECT pack_id, count(*) AS total_items, CAST(sum(strlen(coalesce(excerpt, ''))) AS BIGINT) AS total_bytes, CAST(sum({heuristic("coalesce(path, '')")} + {heuristic("coalesce(excerpt, '')")} + 15) AS BIGINT) AS estimated_tokens, bool_or(cut) AS cut FROM packed GROUP BY 1)
SELECT pack_id, coalesce(total_items, 0) AS total_items, coalesce(total_bytes, 0) AS total_bytes, coalesce(estimated_tokens, 0) AS estimated_tokens, coalesce(cut, false) OR coalesce(total_items, 0) < asked AS truncated, asked - coalesce(total_items, 0) AS dropped FROM n LEFT JOIN g USING (pack_id)""",
    "writing_evidence": f"""WITH {LINES}, {_GIVEN}, t AS (SELECT a.* FROM a WHERE id = (SELECT min(id) FROM anchors) ORDER BY path DESC, end_line DESC, start_line DESC LIMIT 1),
n AS (SELECT a.* FROM a, t WHERE a.id <> t.id AND list_has_any(a.tags, t.tags) AND a.path <> t.path QUALIFY row_number() OVER (PARTITION BY a.path ORDER BY a.end_line, a.start_line, a.id) = 1),
n5 AS (SELECT * FROM n ORDER BY path LIMIT 5),
h AS (SELECT path, line_no, text FROM l WHERE regexp_matches(text, 'cache|plan') AND path NOT IN (SELECT path FROM n5 UNION SELECT path FROM t) QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) = 1), h5 AS (SELECT * FROM h ORDER BY path LIMIT 5)
SELECT 1 AS stage, path, start_line AS line_no, content AS excerpt, 'high' AS confidence FROM t UNION ALL SELECT 2, path, start_line, content, 'medium' FROM n5
UNION ALL SELECT 3, path, line_no, regexp_replace(text, '[{_SPACE}]+$', ''), 'low' FROM h5""",
}
