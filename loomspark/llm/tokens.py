"""Token budgets: exact or heuristic token counts of every text, and their cube over source, language and domain.

A vocabulary is compiled into a counting automaton (``bpe.CountingAutomaton``) that goes once over the bytes and keeps a
last token and a count, no ids. The heuristic count is the same kind of machine with four classes of signs in place of
tokens; it runs over the bytes of a whole Arrow batch at once. Both are models of one operator, and one pass counts for
all models asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.heuristic import count_array
from loomspark.llm import bpe

#: Names of recorded token models, in lower case, that mean the heuristic.
HEURISTIC_NAMES = ("heuristic", "fast", "estimate")
SLICE = ("source", "lang", "domain")


def token_counts(texts: DataFrame, models: Sequence[str], column: str = "text", folder: str = bpe.TOKENIZER_DIR) -> DataFrame:
    """Adds ``tokens STRUCT<model: BIGINT, ...>`` with the tokens of a text under each model.

    A model is ``heuristic`` or a rank file's name in ``folder``. Null and empty texts have 0 tokens. Texts are counted
    whole, whatever their length; a column named ``tokens`` in the input is replaced, others stay.
    """
    spark = texts.sparkSession
    names = list(dict.fromkeys(models))
    shared = {m: spark.sparkContext.broadcast(bpe.vocabulary(m, folder)) for m in names if m != "heuristic"}
    kind = pa.struct([(m, pa.int64()) for m in names])

    @F.arrow_udf("struct<" + ", ".join(f"`{m}`: bigint" for m in names) + ">")
    def count(rows: pa.Array) -> pa.Array:
        if pa.types.is_dictionary(rows.type):
            rows = rows.dictionary_decode()
        made = []
        for m in names:
            if m == "heuristic":
                made.append(pa.array(count_array(rows), pa.int64()))
            else:
                of = bpe.local("counts", shared[m].value, lambda v: bpe.ChunkCounts(bpe.CountingAutomaton(v))).of
                made.append(pa.array([of(t) for t in rows.to_pylist()], pa.int64()))
        return pa.StructArray.from_arrays(made, fields=list(kind))

    return texts.withColumn("tokens", count(F.col(column)))


def slice_key(c: Column, cut: bool = False) -> Column:
    """A slice's name: trimmed, in lower case, ``none`` for null or blank; with ``cut`` only up to the first - or _."""
    name = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    name = F.regexp_extract(name, r"^[^-_]*", 0) if cut else name
    return F.when(F.trim(name) != "", name).otherwise(F.lit("none"))


def token_cube(documents: DataFrame, models: Sequence[str], folder: str = bpe.TOKENIZER_DIR) -> DataFrame:
    """Totals of every slice and every roll-up of slices: ``source, lang, domain, level, model, documents, tokens``.

    ``level`` is Spark's grouping id: 0 for the slices themselves, 7 for the grand total; a rolled-up column is null.
    Documents are summed by slice first, on the map side, and only these sums are cubed; so no slice is too large for a
    task. Repeated texts count as often as they occur. An empty input has no rows.
    """
    counted = token_counts(
        documents.select(slice_key(F.col("source")).alias("source"), slice_key(F.col("lang"), cut=True).alias("lang"), slice_key(F.col("domain")).alias("domain"), "text"),
        models,
        folder=folder,
    )
    fine = counted.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("documents"), *(F.sum(F.col("tokens").getField(m)).alias(f"m{i}") for i, m in enumerate(models)))
    cube = fine.cube(*SLICE).agg(F.grouping_id().cast("int").alias("level"), F.sum("documents").alias("documents"), *(F.sum(f"m{i}").alias(f"m{i}") for i in range(len(models))))
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"m{i}").alias("tokens")) for i, m in enumerate(models)))
    return cube.filter("documents is not null").select(*SLICE, "level", "documents", F.inline(each)).select(*SLICE, "level", "model", "documents", "tokens")


def over_budget(cube: DataFrame, budgets: DataFrame) -> DataFrame:
    """The rows of ``budgets`` whose slice holds more tokens than ``max_tokens`` under its ``token_model``.

    A slice without documents holds none, a null ``max_tokens`` is no limit. Budget columns come out as they are.
    """
    sums = cube.filter("level = 0").select(F.col("source").alias("c_source"), F.col("lang").alias("c_lang"), F.col("domain").alias("c_domain"), F.col("model").alias("c_model"), F.col("tokens").alias("c_tokens"))
    model = F.lower(F.trim("token_model"))
    model = F.when(model.isin(*HEURISTIC_NAMES) | (F.coalesce(model, F.lit("")) == ""), F.lit("heuristic")).otherwise(model)
    return (
        budgets.withColumn("_model", model)
        .join(
            sums,
            (slice_key(F.col("source")) == F.col("c_source")) & (slice_key(F.col("lang"), cut=True) == F.col("c_lang")) & (slice_key(F.col("domain")) == F.col("c_domain")) & (F.col("_model") == F.col("c_model")),
        )
        .filter(F.col("c_tokens") > F.col("max_tokens"))
        .select(*budgets.columns)
    )


def count_frame(texts: pd.Series, model: str, folder: str = bpe.TOKENIZER_DIR) -> list[int]:
    """The same counts on the driver, for tests and small lists."""
    if model == "heuristic":
        return count_array(pa.array(texts, pa.string())).tolist()
    of = bpe.ChunkCounts(bpe.CountingAutomaton(bpe.vocabulary(model, folder))).of
    return [of(t) for t in texts]
