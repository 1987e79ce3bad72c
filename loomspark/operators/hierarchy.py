"""Parent links to full hierarchies.

Weighted disjoint sets: each block of links is contracted by itself, so that every node points to the topmost node
it reaches inside the block, with its distance to it. Only nodes in which chains of different blocks meet go on to the
next level, where they are contracted again over larger stretches of the forest; then roots and distances are handed
back down, level by level. Blocks are ranges of node names with a bounded number of rows, whatever the keys are, so a
tree, folder or parent that holds a third of all rows is spread like any other. No link ever goes to the driver.

Paths come after that, for the trees alone: the links are an index by node, in which every node looks up what stands
above its own stretch of the way, so that stretches double with each look. Contraction carries no paths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.paths import lexical_path
from loomspark.session import cut_lineage

#: Rows that one task contracts at once.
BLOCK_ROWS = 100_000
_SCHEMA = "node string, top string, gap bigint, low string, closed boolean"
_ARROW = pa.schema([("node", pa.string()), ("top", pa.string()), ("gap", pa.int64()), ("low", pa.string()), ("closed", pa.bool_())])


def contract_links(nodes: list[str], tops: list[str], gaps: list[int], lows: list[str], closed: list[bool]):
    """Contracts weighted links (one per node) with a disjoint-set forest and path compression.

    ``gap`` is the distance from node to top, ``low`` the first path from node up to but without top. A closed link ends
    in a cycle whose first path is its top. Returns the lists of top, gap, low and closed after contraction.
    """
    at = {n: i for i, n in enumerate(nodes)}
    up = [-1 if closed[i] else at.get(t, -1) for i, t in enumerate(tops)]
    top, gap, low, shut = list(tops), list(gaps), list(lows), list(closed)
    state = bytearray(len(nodes))  # 0 untouched, 1 on the current walk, 2 done
    for start in range(len(nodes)):
        walk, i = [], start
        while i >= 0 and state[i] == 0:
            state[i] = 1
            walk.append(i)
            i = up[i]
        if i >= 0 and state[i] == 1:
            ring = walk[walk.index(i):]
            first = min(low[j] for j in ring)
            for j in ring:
                top[j], gap[j], shut[j], state[j] = first, 0, True, 2
            del walk[len(walk) - len(ring):]
        for j in reversed(walk):
            k = up[j]
            if k >= 0:
                top[j], shut[j] = top[k], shut[k]
                if not shut[k]:
                    gap[j] += gap[k]
                    low[j] = min(low[j], low[k])
            state[j] = 2
    return top, gap, low, shut


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    col = {c: t.column(c).to_pylist() for c in ("node", "top", "gap", "low", "closed")}
    top, gap, low, shut = contract_links(col["node"], col["top"], col["gap"], col["low"], col["closed"])
    for i in range(0, len(top), 20_000):
        s = slice(i, i + 20_000)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((col["node"][s], top[s], gap[s], low[s], shut[s]), _ARROW)], schema=_ARROW)


def _halve(links: DataFrame, level: int) -> DataFrame:
    """Random mating: links into a node drawn for removal, whose own top stays, are led past it. A level that cannot
    shrink by contraction, as a ring with no two neighbours in one block, loses a quarter of its meeting points here."""
    drawn = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 1
    past = links.filter(drawn(F.col("node")) & (F.col("closed") | ~drawn(F.col("top"))) & (F.col("node") != F.col("top"))).select(
        F.col("node").alias("via"), F.col("top").alias("v_top"), F.col("gap").alias("v_gap"), F.col("low").alias("v_low"), F.col("closed").alias("v_closed")
    )
    led = links.join(past, (F.col("top") == F.col("via")) & ~F.col("closed"), "left")
    is_led = F.col("via").isNotNull()
    return led.select(
        "node",
        F.coalesce("v_top", "top").alias("top"),
        F.when(is_led & F.col("v_closed"), F.lit(0)).when(is_led, F.col("gap") + F.col("v_gap")).otherwise(F.col("gap")).cast("bigint").alias("gap"),
        F.least("low", "v_low").alias("low"),
        F.coalesce("v_closed", "closed").alias("closed"),
    )


def _settle(links: DataFrame, block_rows: int, level: int = 0, count: int | None = None) -> DataFrame:
    """Leads every link to its root or its cycle."""
    count = links.count() if count is None else count
    blocks = max(1, math.ceil(count / block_rows))
    place = F.col("node") if level % 2 == 0 else F.xxhash64("node", F.lit(level))
    spread = links.repartitionByRange(blocks, place) if blocks > 1 else links.coalesce(1)
    here = spread.mapInArrow(_contract, _SCHEMA)
    if blocks == 1:
        return here
    here = cut_lineage(here)
    meet = here.filter(~F.col("closed")).select(F.col("top").alias("node")).distinct()
    above = cut_lineage(here.join(meet, "node", "left_semi"))
    n_above = above.count()
    if n_above == 0:
        return here
    if n_above > 0.8 * count:
        here = cut_lineage(_halve(here, level + 1))
        meet = here.filter(~F.col("closed")).select(F.col("top").alias("node")).distinct()
        above = cut_lineage(here.join(meet, "node", "left_semi"))
        n_above = above.count()
    done = _settle(above, block_rows, level + 1, n_above).select(F.col("node").alias("via"), F.col("top").alias("v_top"), F.col("gap").alias("v_gap"), F.col("closed").alias("v_closed"))
    led = here.join(done, (F.col("top") == F.col("via")) & ~F.col("closed"), "left")
    is_led = F.col("via").isNotNull()
    return led.select(
        "node",
        F.coalesce("v_top", "top").alias("top"),
        F.when(is_led & F.col("v_closed"), F.lit(0)).when(is_led, F.col("gap") + F.col("v_gap")).otherwise(F.col("gap")).cast("bigint").alias("gap"),
        "low",
        F.coalesce("v_closed", "closed").alias("closed"),
    )


def _ways(links: DataFrame, deepest: int) -> DataFrame:
    """``node, way`` of nodes below a root: from ``node, parent, depth`` of all of them, the way without the root.

    A stretch is the lower end of a way and names the node above it. Each look joins it to that node's own stretch and so
    doubles it; ways that reach their root stay as they are. As many looks as the depth has binary digits, each over rows
    and not over blocks, so that no task holds more than a few ways at once, however long they are.
    """
    now = cut_lineage(links.select("node", F.col("parent").alias("up"), "depth", F.array("node").alias("way")))
    length = 1
    while length < deepest:
        open_ = F.size("way") < F.col("depth")
        above = now.select(F.col("node").alias("up"), F.col("up").alias("a_up"), F.col("way").alias("a_way"))
        longer = now.filter(open_).join(above, "up").select("node", F.col("a_up").alias("up"), "depth", F.concat("a_way", "way").alias("way"))
        now = cut_lineage(now.filter(~open_).unionByName(longer))
        length *= 2
    return now.select("node", "way")


def hierarchy(links: DataFrame, node: str = "node", parent: str = "parent", with_paths: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Root, depth and, if asked for, the way from the root of every node of a forest of parent links.

    Input: one column of nodes, one of their parents; other columns are ignored. Rows with a null node or parent are
    no links, repeated rows count once, and of several parents of one node the first in code-point order holds.
    Output: ``path, root_path, depth INT`` and with paths ``way ARRAY<STRING>`` (root first, the node last), one row
    per node that occurs as either. A root has depth 0 and is its own root. On or below a cycle the depth is -1,
    ``root_path`` the first path of the cycle and ``way`` null. An empty input gives an empty result.
    """
    one = (
        links.select(F.col(node).alias("node"), F.col(parent).alias("top"))
        .filter(F.col("node").isNotNull() & F.col("top").isNotNull())
        .groupBy("node")
        .agg(F.min("top").alias("top"))
        .select("node", "top", F.lit(1).cast("bigint").alias("gap"), F.col("node").alias("low"), F.lit(False).alias("closed"))
    )
    one = cut_lineage(one)
    done = _settle(one, block_rows)
    done = cut_lineage(done) if with_paths else done
    below = done.select(F.col("node").alias("path"), F.col("top").alias("root_path"), F.when(F.col("closed"), F.lit(-1)).otherwise(F.col("gap")).cast("int").alias("depth"))
    roots = below.filter("depth >= 0").select("root_path").distinct()
    top = roots.select(F.col("root_path").alias("path"), "root_path", F.lit(0).cast("int").alias("depth"))
    if not with_paths:
        return below.unionByName(top)
    deepest = below.agg(F.max("depth")).first()[0] or 0
    trees = below.filter("depth > 0").select(F.col("path").alias("node"), "depth").join(one.select("node", F.col("top").alias("parent")), "node")
    ways = _ways(trees, deepest).withColumnRenamed("node", "path")
    found = below.join(ways, "path", "left").select("path", "root_path", "depth", F.when(F.col("depth") > 0, F.concat(F.array("root_path"), "way")).alias("way"))
    return found.unionByName(top.withColumn("way", F.array("root_path")))


def import_links(imports: DataFrame) -> DataFrame:
    """``node, parent`` of every import that resolves to something, both as the places their spellings lead to."""
    found = imports.filter(F.trim("resolved_path") != "").select("src", "resolved_path").distinct()
    return found.select(lexical_path(F.col("src")).alias("node"), lexical_path(F.col("resolved_path")).alias("parent")).filter("node is not null and parent is not null")


def descendants(tree: DataFrame) -> DataFrame:
    """Every pair of a node and a node below it: ``path, below, steps INT``; input is ``hierarchy(with_paths=True)``.

    Pairs stay rows, so that a root above a third of all nodes never becomes one value. Nodes on or below a cycle have
    no ways and no pairs; ``cycle_members`` lists them."""
    return tree.filter("depth > 0").select(F.col("path").alias("below"), "depth", F.posexplode("way").alias("at", "path")).filter("path <> below").select("path", "below", (F.col("depth") - F.col("at")).cast("int").alias("steps"))


def cycle_members(tree: DataFrame) -> DataFrame:
    """``path, root_path`` of the nodes on or below a cycle, ``root_path`` naming the cycle."""
    return tree.filter("depth < 0").select("path", "root_path")
