"""Queries over files, paths, lines and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.heuristic import cjk_chars, heuristic_tokens
from loomspark.functions.paths import base_name, extension
from loomspark.operators import corpus, results, search
from loomspark.plans.sql import CJK_CLASS, FILES, LINES, heuristic, in_class, utf8_cut
from loomspark.sources.tables import table
from loomspark.streaming.watch import windowed_changes


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """The latest read of each path."""
    return corpus.latest(table(spark, folder, "files").filter("path is not null"), "path", "read_at", "file_id")


def entries_of(spark: SparkSession, folder: str) -> DataFrame:
    """The same without contents, which scans don't read."""
    return corpus.latest(table(spark, folder, "files").filter("path is not null").select("path", "is_dir", "depth", "size", "mtime_ms", "read_at", "file_id"), "path", "read_at", "file_id")


def docs_of(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files."""
    return corpus.document_files(table(spark, folder, "documents"))


def _scan(**options):
    return lambda spark, folder: corpus.scan(entries_of(spark, folder), **options)


def scan_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Entries below the first folder."""
    entries = entries_of(spark, folder)
    first = entries.filter("contains(path, '/') and not startswith(path, '.')").agg(F.min(F.substring_index("path", "/", 1))).first()[0]
    return corpus.scan(entries, scope=first or "none")


def _match(pattern: str, **options):
    return lambda spark, folder: search.match(docs_of(spark, folder), pattern, **options)


def text_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Every scalar of a text, of every document."""
    c = F.col("text")
    return table(spark, folder, "documents").filter("text is not null").select(
        "doc_id", F.length(c).cast("bigint").alias("chars"), T.chars_no_space(c).alias("chars_no_space"), T.english_words(c).alias("words"), cjk_chars(c).cast("bigint").alias("cjk"),
        T.line_count(c).alias("lines_n"), heuristic_tokens(c).alias("tokens"), F.octet_length(c).cast("bigint").alias("bytes"),
    )


def previews(spark: SparkSession, folder: str) -> DataFrame:
    """The preview of every document."""
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", T.preview(F.col("text")).alias("preview"))


def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Name and extension of every path."""
    return entries_of(spark, folder).select("path", base_name(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), T.dots(F.col("path")).cast("bigint").alias("dots"))


def keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The keywords of every document, as one string."""
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.array_join(T.keywords(F.col("text"), 5), " ").alias("keywords"))


def read_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """What a bounded read of 1000 bytes leaves of every file."""
    raw = table(spark, folder, "files").select("file_id", F.col("content").cast("binary").alias("raw"))
    return corpus.bounded_read(raw, truncate_size=1000).select("file_id", "truncated", "skipped", F.octet_length("content").cast("bigint").alias("bytes"), F.array_join("warnings", ",").alias("warnings"))


def read_configured(spark: SparkSession, folder: str) -> DataFrame:
    """Every file read by its own configuration: size strategy and limit of its row in read_configs."""
    f = table(spark, folder, "files").filter("content is not null").select("file_id", "content", F.col("config_id").alias("c"))
    k = table(spark, folder, "read_configs").select("config_id", "max_file_size", "truncate_size", F.lower("size_strategy").alias("how"))
    df = f.join(k, F.col("c") == F.col("config_id"))
    size = F.octet_length("content")
    skipped = F.col("how").isin("skip", "full") & F.coalesce(size > F.col("max_file_size"), F.lit(False))
    cut = (F.col("how") == "truncate") & F.coalesce(size > F.col("truncate_size"), F.lit(False))
    text = F.when(cut, T.utf8_cut(F.col("content"), F.col("truncate_size"))).otherwise(F.col("content"))
    return df.select("file_id", skipped.alias("skipped"), (cut & ~skipped).alias("cut"), F.when(~skipped, F.octet_length(text)).cast("bigint").alias("bytes"))


def extract_range(spark: SparkSession, folder: str) -> DataFrame:
    """Lines 2 to 5 of every document."""
    return corpus.extract(docs_of(spark, folder), 2, 5)


def extract_truncated(spark: SparkSession, folder: str) -> DataFrame:
    """Lines 1 to 12 of every document, in at most 200 bytes."""
    return corpus.extract(docs_of(spark, folder), 1, 12, 200)


def match_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines match."""
    return search.count_matches(docs_of(spark, folder), r"cache|index")


def match_context(spark: SparkSession, folder: str) -> DataFrame:
    """Matching lines with the lines around them."""
    df = search.match(docs_of(spark, folder), r"nightly build", context=1)
    return df.select("path", "line_no", "excerpt", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


def sorted_results(spark: SparkSession, folder: str) -> DataFrame:
    """Matches as result rows, in order."""
    hits = _match("retry policy")(spark, folder)
    rows = results.in_order(results.to_results(hits, "match", "rg", start="line_no", excerpt="excerpt"))
    return rows.select("kind", "path", F.col("range.start").alias("start"), F.col("range.end").alias("end"), "excerpt", "confidence", "source_mode", F.col("meta.truncated").alias("truncated"))


def render_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned files as JSON lines."""
    return results.jsonl(results.to_results(corpus.scan(entries_of(spark, folder), kind="file"), "file", "scan"))


def render_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned files as lines of Markdown."""
    return results.markdown(results.to_results(corpus.scan(entries_of(spark, folder), kind="file"), "file", "scan"))


def snapshot_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes that a snapshot stands for."""
    return corpus.fingerprint(corpus.scan(entries_of(spark, folder), kind="file")).select("files", "bytes")


def watch_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Changes by kind and hour, as the stream counts them."""
    return windowed_changes(table(spark, folder, "events").select("ts", F.col("event_type").alias("kind")), "1 hour", watermark=None)


_SCANNED = "path, is_dir, depth, CASE WHEN NOT is_dir THEN size END AS size, CASE WHEN NOT is_dir THEN mtime_ms END AS mtime_ms FROM f WHERE (depth IS NULL OR depth > 0)"
_SHOWN = "AND NOT regexp_matches(path, '(^|/)\\.')"
_SPACE = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _hits(condition: str, extra: str = "") -> str:
    return f"WITH {LINES} SELECT path, line_no, regexp_replace(text, '[{_SPACE}]+$', '') AS excerpt FROM l WHERE {condition} {extra}"


def _extracted(a: int, b: int, most: int) -> str:
    w = "(PARTITION BY path ORDER BY line_no"
    return f"""WITH {LINES}, w AS (SELECT path, line_no, text, strlen(text) AS len FROM l WHERE line_no BETWEEN {a} AND {b}),
e AS (SELECT *, coalesce(max(CAST(len > 0 AS INT)) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM w),
t AS (SELECT *, sum(len + seen) OVER {w}) AS tot FROM e),
p AS (SELECT *, coalesce(lag(tot) OVER {w}), 0) AS prev FROM t),
s AS (SELECT path, min(line_no) FILTER (WHERE prev + len + 1 > {most}) AS stop, max(line_no) AS last FROM p GROUP BY path),
b AS (SELECT p.path, string_agg(text, chr(10) ORDER BY line_no) AS body FROM p JOIN s USING (path) WHERE (stop IS NULL OR line_no < stop) AND (seen = 1 OR len > 0) GROUP BY 1)
SELECT s.path, CAST({a} AS BIGINT) AS range_start, coalesce(stop, last) AS range_end,
  coalesce(body, '') || coalesce({utf8_cut('p.text', f'CAST({most} - p.prev AS INT)')}, '') AS excerpt, stop IS NOT NULL AS truncated
FROM s LEFT JOIN b USING (path) LEFT JOIN p ON p.path = s.path AND p.line_no = s.stop"""


QUERIES = {
    "scan_files": _scan(kind="file"),
    "scan_dirs": _scan(kind="dir"),
    "scan_depth": _scan(max_depth=2),
    "scan_hidden": _scan(hidden=True),
    "scan_scope": scan_scope,
    "glob_include": _scan(include=["*.rs", "shared-core/*"]),
    "glob_exclude": _scan(exclude=["*.md", "src*plan"]),
    "find_path": lambda spark, folder: corpus.find(entries_of(spark, folder), "PLAN"),
    "path_parts": path_parts,
    "extract_range": extract_range,
    "extract_truncated": extract_truncated,
    "read_bounded": read_bounded,
    "read_configured": read_configured,
    "match_regex": _match(r"retry policy|cache[sd]?"),
    "match_ignore_case": _match(r"README\.MD", ignore_case=True),
    "match_word": _match(r"index", word=True),
    "match_max_count": _match(r"the", max_count=2),
    "match_glob": _match(r"cache", include=["**/docs/*", "*.txt"], exclude=["*plan*"]),
    "match_scope": _match(r"cache", scopes=["shared-core", "onyxfold-14"]),
    "match_count": match_count,
    "match_context": match_context,
    "text_stats": text_stats,
    "previews": previews,
    "keywords": keywords,
    "sorted_results": sorted_results,
    "render_jsonl": render_jsonl,
    "render_markdown": render_markdown,
    "snapshot_fingerprint": snapshot_fingerprint,
    "watch_windows": watch_windows,
}
_CONTEXT = "(PARTITION BY path ORDER BY line_no ROWS BETWEEN"
SQL = {
    "scan_files": f"WITH {FILES} SELECT {_SCANNED} {_SHOWN} AND NOT is_dir",
    "scan_dirs": f"WITH {FILES} SELECT {_SCANNED} {_SHOWN} AND is_dir",
    "scan_depth": f"WITH {FILES} SELECT {_SCANNED} {_SHOWN} AND depth <= 2",
    "scan_hidden": f"WITH {FILES} SELECT {_SCANNED}",
    "scan_scope": f"WITH {FILES} SELECT {_SCANNED} {_SHOWN} AND starts_with(path, (SELECT min(split_part(path, '/', 1)) FROM f WHERE contains(path, '/') AND NOT starts_with(path, '.')) || '/')",
    "glob_include": f"WITH {FILES} SELECT {_SCANNED} {_SHOWN} AND (path LIKE '%.rs' OR path LIKE 'shared-core/%')",
    "glob_exclude": f"WITH {FILES} SELECT {_SCANNED} {_SHOWN} AND NOT (path LIKE '%.md' OR (path LIKE '%src%' AND path LIKE '%plan%'))",
    "find_path": f"WITH {FILES} SELECT {_SCANNED} {_SHOWN} AND NOT is_dir AND path ILIKE '%plan%'",
    "path_parts": f"WITH {FILES} SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1) AS ext, length(path) - length(replace(path, '.', '')) AS dots FROM f",
    "extract_range": _extracted(2, 5, 65_536),
    "extract_truncated": _extracted(1, 12, 200),
    "read_bounded": f"""SELECT file_id, content IS NOT NULL AND strlen(content) > 1000 AS truncated, content IS NULL AS skipped, strlen({utf8_cut('content', '1000')}) AS bytes,
CASE WHEN strlen(content) > 1000 THEN 'FILE_TRUNCATED' ELSE '' END AS warnings FROM files""",
    "read_configured": f"""WITH x AS (SELECT file_id, content, lower(size_strategy) AS how, max_file_size AS most, truncate_size AS t FROM files f JOIN read_configs c ON f.config_id = c.config_id WHERE content IS NOT NULL),
y AS (SELECT *, how IN ('skip', 'full') AND coalesce(strlen(content) > most, false) AS skipped, how = 'truncate' AND coalesce(strlen(content) > t, false) AS c FROM x)
SELECT file_id, skipped, c AND NOT skipped AS cut, CASE WHEN NOT skipped THEN strlen(CASE WHEN c THEN {utf8_cut('content', 'CAST(t AS INT)')} ELSE content END) END AS bytes FROM y""",
    "match_regex": _hits("regexp_matches(text, 'retry policy|cache[sd]?')"),
    "match_ignore_case": _hits("regexp_matches(text, '(?i)README\\.MD')"),
    "match_word": _hits("regexp_matches(text, '(^|[^\\pL\\pM\\pN_])index([^\\pL\\pM\\pN_]|$)')"),
    "match_max_count": _hits("regexp_matches(text, 'the')", "QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 2"),
    "match_glob": _hits("regexp_matches(text, 'cache') AND (regexp_matches(path, '^(.*/)?docs/[^/]*$') OR regexp_matches(path, '\\.txt$')) AND NOT regexp_matches(path, '(^|/)[^/]*plan[^/]*$')"),
    "match_scope": _hits("regexp_matches(text, 'cache') AND (path LIKE 'shared-core/%' OR path LIKE 'onyxfold-14/%')"),
    "match_count": f"WITH {LINES} SELECT count(*) AS count FROM l WHERE regexp_matches(text, 'cache|index')",
    "match_context": f"""WITH {LINES}, c AS (SELECT *, coalesce(string_agg(text, chr(10)) OVER {_CONTEXT} 1 PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(text, chr(10)) OVER {_CONTEXT} 1 FOLLOWING AND 1 FOLLOWING), '') AS after FROM l)
SELECT path, line_no, regexp_replace(text, '[{_SPACE}]+$', '') AS excerpt, before, after FROM c WHERE text LIKE '%nightly build%'""",
    "text_stats": f"""SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS chars_no_space, len(regexp_extract_all(text, '[A-Za-z0-9]{{2,}}')) AS words, {in_class(CJK_CLASS, 'text')} AS cjk,
CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CAST(ends_with(text, chr(10)) AS INT) END AS lines_n, {heuristic('text')} AS tokens, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL""",
    "previews": f"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '<!--'))[1] AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(p) > 60 THEN left(p, 60) || '...' ELSE p END AS preview FROM x""",
    "sorted_results": f"""WITH {LINES} SELECT 'match' AS kind, path, line_no AS start, line_no AS "end", regexp_replace(text, '[{_SPACE}]+$', '') AS excerpt, 'high' AS confidence, 'rg' AS source_mode, false AS truncated FROM l WHERE text LIKE '%retry policy%'""",
    "render_jsonl": f"""WITH {FILES}, s AS (SELECT {_SCANNED} {_SHOWN} AND NOT is_dir)
SELECT '{{"kind":"file","path":' || to_json(path)::VARCHAR || ',"confidence":"high","source_mode":"scan","meta":{{' || coalesce('"mtime_ms":' || mtime_ms || ',', '') || coalesce('"size":' || size || ',', '') || '"truncated":false}}}}' AS line FROM s""",
    "render_markdown": f"""WITH {FILES}, s AS (SELECT {_SCANNED} {_SHOWN} AND NOT is_dir)
SELECT DISTINCT 1 AS group_no, 0 AS place, '## Files' AS line FROM s UNION ALL SELECT 1, row_number() OVER (ORDER BY path), '- ' || path FROM s""",
    "snapshot_fingerprint": f"WITH {FILES}, s AS (SELECT {_SCANNED} {_SHOWN} AND NOT is_dir) SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM s",
    "watch_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS kind, count(*) AS changes, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL",
}
