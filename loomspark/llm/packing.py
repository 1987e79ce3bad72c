"""Filling containers of fixed capacity: first-fit decreasing, by itself in each of many randomised groups of items.

A group holds a bounded number of items whatever their keys are, as it is drawn from each row's place and not from a
column. Within a group a tournament tree over the room left in the open containers finds the first that an item fits in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bpe
from loomspark.llm.tokens import token_counts

#: Texts of a group. A group leaves about one container partly filled.
GROUP_ITEMS = 20_000
#: Windows up to which their table is broadcast.
BROADCAST_WINDOWS = 10_000


class Tournament:
    """The most room under each inner node; leaves are containers in the order they were opened."""

    def __init__(self, capacity: int):
        self.capacity, self.width, self.open = capacity, 1, 0
        self.tree = [0, 0]

    def _grow(self) -> None:
        leaves = self.tree[self.width :] + [0] * self.width
        self.width *= 2
        self.tree = [0] * self.width + leaves
        for i in range(self.width - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def place(self, size: int) -> int:
        """The first container with room for size, opened if there is none; takes the room."""
        tree, i = self.tree, 1
        if self.open and (tree[1] >= size if size else True):
            if size == 0:
                return 0
            while i < self.width:
                i *= 2
                if tree[i] < size:
                    i += 1
            tree[i] -= size
        else:
            if self.open == self.width:
                self._grow()
                tree = self.tree
            i = self.width + self.open
            self.open += 1
            tree[i] = self.capacity - size
        at = i - self.width
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            most = a if a >= b else b
            if tree[i] == most and size:
                break
            tree[i] = most
            i >>= 1
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, items taken by falling size and then in their order; none above the capacity."""
    bins = np.zeros(len(sizes), np.int64)
    tree = Tournament(capacity)
    place = tree.place
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i] = place(int(sizes[i]))
    return bins


def _fill(table: pa.Table) -> pa.Table:
    order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-(1 << 62)).to_numpy(), table.column("row").to_numpy()))
    table = table.take(pa.array(order))
    sizes = table.column("n_tokens").to_numpy()
    bins = first_fit_decreasing(sizes, table.column("capacity_tokens")[0].as_py()) if len(sizes) else sizes
    made = table.select(["window_id", "capacity_tokens", "bin_group"]).append_column("bin", pa.array(bins, pa.int64()))
    for c in ("doc_id", "piece", "start_token", "n_tokens"):
        made = made.append_column(c, table.column(c))
    return made


def pack_items(sizes: DataFrame, windows: DataFrame, group_items: int = GROUP_ITEMS, seed: int = 7, n_items: int | None = None) -> DataFrame:
    """Assigns every item to a container of each window.

    Input: ``sizes(doc_id BIGINT, tokenizer STRING, n_tokens BIGINT)`` and ``windows(window_id, tokenizer,
    capacity_tokens)``. Output: ``window_id, capacity_tokens, bin_group, bin, doc_id, piece, start_token, n_tokens``;
    a container is (window_id, bin_group, bin). An item above the capacity is split into full containers and the rest;
    others stay whole. Items of no tokens, and of null size, take no room and come out too. Repeated and null doc_ids are
    items of their own. Windows with a null or non-positive capacity have no rows, nor has an empty input.
    """
    groups = max(1, math.ceil((sizes.count() if n_items is None else n_items) / group_items))
    asked = windows.filter("capacity_tokens > 0").select("window_id", "tokenizer", "capacity_tokens")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_WINDOWS else asked
    rows = sizes.select("doc_id", F.col("tokenizer").alias("i_tokenizer"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("bin_group", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).cast("int"))
    wide = rows.join(asked, F.col("i_tokenizer") == F.col("tokenizer"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.col("capacity_tokens"))
    pieces = wide.select("window_id", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"), "bin_group", "doc_id", "row", "size", F.posexplode(starts).alias("piece", "start_token"))
    items = pieces.select("window_id", "capacity_tokens", "bin_group", "doc_id", "row", "piece", "start_token", F.least(F.col("capacity_tokens"), F.col("size") - F.col("start_token")).alias("n_tokens"))
    w = windows.schema["window_id"].dataType.simpleString()
    return items.groupBy("window_id", "bin_group").applyInArrow(_fill, f"window_id {w}, capacity_tokens bigint, bin_group int, bin bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint")


def pack_documents(documents: DataFrame, windows: DataFrame, folder: str = bpe.TOKENIZER_DIR, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``pack_items`` over texts sized in tokens of each window's tokenizer, counted by the automaton."""
    models = sorted(r[0] for r in windows.filter("tokenizer is not null").select("tokenizer").distinct().collect())
    if not models:
        models = ["byte_bpe_50k"]
    counted = token_counts(documents.select("doc_id", "text"), models, folder=folder)
    each = F.array(*(F.struct(F.lit(m).alias("tokenizer"), F.col("tokens").getField(m).alias("n_tokens")) for m in models))
    return pack_items(counted.select("doc_id", F.inline(each)), windows, group_items, n_items=documents.count())


def fill_report(packed: DataFrame) -> DataFrame:
    """``window_id, capacity_tokens, items, tokens, containers, least, fill``: ``least`` is the lower bound of containers."""
    bins = packed.groupBy("window_id", "capacity_tokens", "bin_group", "bin").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return (
        bins.groupBy("window_id", "capacity_tokens")
        .agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("containers"))
        .withColumn("least", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
        .withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )
