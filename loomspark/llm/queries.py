"""Registered queries of the training-text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.heuristic import CJK_RANGES, SIGNS
from loomspark.llm import encode, garbled, packing, residue, split, tokens
from loomspark.sources.tables import table

#: Models that the token cube is made for.
MODELS = ("heuristic", "byte_bpe_50k")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Budgets that their slice exceeds."""
    return tokens.over_budget(tokens.token_cube(table(spark, folder, "documents"), MODELS), table(spark, folder, "token_budgets")).select("source", "lang", "domain")


def p1_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals of all slices and roll-ups, heuristic and exact."""
    return tokens.token_cube(table(spark, folder, "documents"), MODELS)


def p1_cube_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    """The heuristic half of the cube, which SQL can express."""
    return tokens.token_cube(table(spark, folder, "documents"), ("heuristic",)).drop("model")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of files that were read in a wrong encoding."""
    return garbled.garbled(table(spark, folder, "files")).select("file_id")


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The affected rows with the chain that led there and their text as far as it can be known."""
    return garbled.restore(table(spark, folder, "files")).select("file_id", "chain", "restored")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items above a limit."""
    return split.oversized(*(table(spark, folder, t) for t in ("anchors", "packs", "files", "read_configs"))).select("item_kind", "item_id", "limit_id")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all items above a limit."""
    return split.split_pieces(*(table(spark, folder, t) for t in ("anchors", "packs", "files", "read_configs")))


def p3_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each item cover without their overlaps: first and last character, and how many in all."""
    own = p3_pieces(spark, folder).groupBy("item_kind", "item_id", "limit_id")
    return own.agg(F.min("start_char").cast("bigint").alias("first_char"), F.max("end_char").cast("bigint").alias("last_char"), F.sum(F.col("end_char") - F.col("start_char")).cast("bigint").alias("chars"))


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document."""
    return encode.encode_corpus(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in a container of each window."""
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "pack_windows"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers of each window are filled."""
    return packing.fill_report(p6_containers(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold residue."""
    return residue.residue(table(spark, folder, "documents")).select("doc_id")


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The worst passage of each document that holds residue."""
    return residue.residue(table(spark, folder, "documents"))


def _class(inner: str, c: str = "text") -> str:
    return f"length(regexp_replace({c}, '[^{inner}]', '', 'g'))"


_SIGNS_RE2 = "".join(f"\\x{{{ord(c):X}}}" for c in SIGNS)
_CJK_RE2 = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)


def _heuristic(c: str) -> str:
    a, s, k = _class("\\x00-\\x7F", c), _class(_SIGNS_RE2, c), _class(_CJK_RE2, c)
    return f"(({a} - {s} + 3) // 4 + ({s} + 1) // 2 + (2 * {k} + 2) // 3 + (length({c}) - {a} - {k} + 1) // 2)"


def _slice(c: str, cut: bool = False) -> str:
    name = f"lower(trim({c}))"
    name = f"regexp_extract({name}, '^[^-_]*')" if cut else name
    return f"coalesce(nullif({name}, ''), 'none')"


QUERIES = {
    "p1_found": p1_found,
    "p1_cube": p1_cube,
    "p1_cube_heuristic": p1_cube_heuristic,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_cover": p3_cover,
    "p5_ids": p5_ids,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
}
SQL = {
    "p1_found": f"""
WITH s AS (SELECT {_slice("source")} AS so, {_slice("lang", True)} AS la, {_slice("domain")} AS d, sum(coalesce({_heuristic("text")}, 0)) AS n FROM documents GROUP BY ALL)
SELECT source, lang, domain FROM token_budgets b JOIN s ON {_slice("b.source")} = so AND {_slice("b.lang", True)} = la AND {_slice("b.domain")} = d WHERE n > max_tokens""",
    "p1_cube_heuristic": f"""
WITH s AS (SELECT {_slice("source")} AS source, {_slice("lang", True)} AS lang, {_slice("domain")} AS domain, count(*) AS documents, sum(coalesce({_heuristic("text")}, 0)) AS tokens FROM documents GROUP BY ALL)
SELECT source, lang, domain, CAST(grouping_id(source, lang, domain) AS INT) AS level, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY CUBE (source, lang, domain)""",
    "p3_cover": f"""
WITH a AS (SELECT anchor_key, id, content, {_heuristic("content")} AS n FROM anchors WHERE content IS NOT NULL),
p AS (SELECT DISTINCT pack_id, max_tokens, unnest(anchors) AS id FROM packs),
i AS (SELECT DISTINCT 'anchor' AS item_kind, anchor_key AS item_id, pack_id AS limit_id, length(content) AS n FROM a JOIN p USING (id) WHERE a.n > max_tokens
UNION ALL SELECT 'file', file_id, CAST(c.config_id AS BIGINT), length(content) FROM files f JOIN read_configs c ON f.config_id = c.config_id WHERE strlen(content) > truncate_size)
SELECT item_kind, item_id, limit_id, CAST(0 AS BIGINT) AS first_char, CAST(n AS BIGINT) AS last_char, CAST(n AS BIGINT) AS chars FROM i""",
    "p3_found": f"""
WITH a AS (SELECT anchor_key, id, {_heuristic("content")} AS n FROM anchors WHERE content IS NOT NULL),
p AS (SELECT DISTINCT pack_id, max_tokens, unnest(anchors) AS id FROM packs)
SELECT DISTINCT 'anchor' AS item_kind, anchor_key AS item_id, pack_id AS limit_id FROM a JOIN p USING (id) WHERE n > max_tokens
UNION ALL
SELECT 'file', file_id, CAST(c.config_id AS BIGINT) FROM files f JOIN read_configs c ON f.config_id = c.config_id WHERE strlen(content) > truncate_size""",
}
