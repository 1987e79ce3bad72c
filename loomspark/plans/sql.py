"""Pieces of SQL shared by the texts in this package, in DuckDB's dialect."""

from __future__ import annotations

from loomspark.functions.heuristic import CJK_RANGES, SIGNS

SIGN_CLASS = "".join(f"\\x{{{ord(c):X}}}" for c in SIGNS)
CJK_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)"


def in_class(inner: str, c: str) -> str:
    """Characters of a class in a text."""
    return f"length(regexp_replace({c}, '[^{inner}]', '', 'g'))"


def heuristic(c: str) -> str:
    """The heuristic token count."""
    a, s, k = in_class("\\x00-\\x7F", c), in_class(SIGN_CLASS, c), in_class(CJK_CLASS, c)
    return f"(({a} - {s} + 3) // 4 + ({s} + 1) // 2 + (2 * {k} + 2) // 3 + (length({c}) - {a} - {k} + 1) // 2)"


def utf8_cut(s: str, k: str) -> str:
    """The longest start of s of at most k bytes."""
    tries = ", ".join(f"TRY(decode(encode({s})[1:greatest({k} - {i}, 0)]))" for i in range(4))
    return f"CASE WHEN strlen({s}) <= {k} THEN {s} ELSE coalesce({tries}) END"


def parts(c: str) -> str:
    """Lines as a list."""
    return f"list_transform(CASE WHEN {c} = '' THEN []::VARCHAR[] WHEN ends_with({c}, chr(10)) THEN string_split({c}, chr(10))[1:len(string_split({c}, chr(10))) - 1] ELSE string_split({c}, chr(10)) END, lambda x: regexp_replace(x, '\\r$', ''))"


#: The latest read of each path; the latest document of each path; its lines; its markers and their pairs.
FILES = "f AS (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY read_at DESC NULLS LAST, file_id DESC) = 1)"
DOCS = "d AS (SELECT path, text AS content, mtime_ms FROM documents WHERE path IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime_ms DESC NULLS LAST, doc_id DESC) = 1)"
_OF_D = f"l AS (SELECT path, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS text FROM (SELECT path, {parts('content')} AS p FROM d))"
LINES = f"{DOCS}, {_OF_D}"
#: Documents with two blocks set in each: lines 1 to 3, and line 2 inside of them.
MARKED = f"""{DOCS.replace('d AS', 'd0 AS', 1)},
d1 AS (SELECT path, mtime_ms, ends_with(content, chr(10)) AS nl, {parts('content')} AS x, regexp_extract(path, '[^/]*$') AS name FROM d0),
d2 AS (SELECT *, len(x) AS n, CASE WHEN len(x) >= 1 THEN x[1:1] || ['<!--Q:begin id=inner v=2-->'] || x[2:2] || ['<!--Q:end id=inner-->'] || x[3:] ELSE x END AS y FROM d1),
d3 AS (SELECT *, ['<!--Q:begin id=outer.' || name || ' tags=scan,' || split_part(path, '/', 1) || ' v=3-->'] || y[1:3] || ['<!--Q:end id=outer.' || name || '-->'] || y[4:] AS z FROM d2),
d AS (SELECT path, mtime_ms, n, array_to_string(z, chr(10)) || CASE WHEN nl THEN chr(10) ELSE '' END AS content FROM d3)"""
_B = r"<!--\s*Q:begin\s+id=(\S+)(\s+tags=(\S+))?(\s+v=(\d+))?\s*-->"
_E = r"<!--\s*Q:end\s+id=(\S+)\s*-->"
MARKS = f"""{MARKED}, {_OF_D}, m AS (
  SELECT path, line_no, 0 AS seq, 'B' AS kind, regexp_extract(text, '{_B}', 1) AS id, regexp_extract(text, '{_B}', 3) AS tags, coalesce(TRY_CAST(regexp_extract(text, '{_B}', 5) AS INT), 1) AS version FROM l WHERE text LIKE '%Q:begin%'
  UNION ALL SELECT path, line_no, 1, 'E', regexp_extract(text, '{_E}', 1), '', 1 FROM l WHERE text LIKE '%Q:end%'),
m1 AS (SELECT *, sum(CASE kind WHEN 'B' THEN 1 ELSE -1 END) OVER (PARTITION BY path, id ORDER BY line_no, seq) AS s FROM m WHERE id <> ''),
m2 AS (SELECT *, least(0, min(s) OVER (PARTITION BY path, id ORDER BY line_no, seq)) AS low, least(0, coalesce(min(s) OVER (PARTITION BY path, id ORDER BY line_no, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS plow FROM m1),
m3 AS (SELECT *, kind = 'E' AND s < plow AS lost, CASE WHEN kind = 'E' AND s < plow THEN -1 ELSE s - low + CASE kind WHEN 'B' THEN 0 ELSE 1 END END AS lvl FROM m2),
m4 AS (SELECT *, lead(kind) OVER v AS nxt, lead(line_no) OVER v AS end_no FROM m3 WINDOW v AS (PARTITION BY path, id, lvl ORDER BY line_no, seq)),
pr AS (SELECT path, line_no, kind, id, tags, version, CASE WHEN lost THEN 'unpaired_end' WHEN kind = 'B' AND nxt = 'E' THEN 'anchor' WHEN kind = 'B' THEN 'unpaired_begin' END AS state, end_no FROM m4)"""
BLOCKS = f"""{MARKS}, a AS (
  SELECT id, tags, version, pr.path, line_no AS start_line, end_no AS end_line,
    CASE WHEN end_no - line_no > 1 THEN array_to_string({parts('content')}[line_no + 1:end_no - 1], chr(10)) END AS content
  FROM pr JOIN d ON d.path = pr.path WHERE state = 'anchor')"""
#: Tags of a block as a list.
TAGS = "CASE WHEN tags = '' THEN []::VARCHAR[] ELSE list_transform(string_split(tags, ','), lambda t: trim(t)) END"


def place(c: str) -> str:
    """The place that a spelling of a path leads to."""
    plain = f"regexp_replace(replace({c}, chr(92), '/'), '^\\s+|\\s+$', '', 'g')"
    once = f"array_to_string(list_filter(string_split({plain}, '/'), lambda s: s <> '' AND s <> '.'), '/')"
    for _ in range(4):
        once = f"regexp_replace({once}, '(^|/)[^/]+/\\.\\.(/|$)', '\\1', 'g')"
    return f"nullif(regexp_replace({once}, '/$', ''), '')"


EDGES = f"g AS (SELECT DISTINCT {place('src')} AS src, {place('resolved_path')} AS dst FROM imports WHERE trim(resolved_path) <> '')"
