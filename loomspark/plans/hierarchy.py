"""Queries of problem 4: the hierarchies that the imports form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import hierarchy as H
from loomspark.plans.sql import place
from loomspark.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every file of the import forest."""
    return H.hierarchy(H.import_links(table(spark, folder, "imports")))


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The full way from the root to every file, as one string; null on or below a cycle."""
    tree = H.hierarchy(H.import_links(table(spark, folder, "imports")), with_paths=True)
    return tree.select("path", "root_path", "depth", F.array_join("way", " > ").alias("full_path"))


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below every file, with the number of steps between."""
    return H.descendants(H.hierarchy(H.import_links(table(spark, folder, "imports")), with_paths=True))


def p4_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Files on or below a cycle."""
    return H.cycle_members(H.hierarchy(H.import_links(table(spark, folder, "imports"))))


_TREE = f"""
WITH RECURSIVE l AS (
  SELECT {place('src')} AS node, min({place('resolved_path')}) AS parent
  FROM imports WHERE trim(resolved_path) <> '' GROUP BY 1),
down AS (
  SELECT DISTINCT parent AS path, parent AS root_path, 0 AS depth, parent AS full_path FROM l
  WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.node = l.parent)
  UNION ALL
  SELECT l.node, d.root_path, d.depth + 1, d.full_path || ' > ' || l.node FROM down d JOIN l ON l.parent = d.path),
rest AS (SELECT l.* FROM l WHERE node NOT IN (SELECT path FROM down)),
up AS (
  SELECT node, parent AS over FROM rest
  UNION
  SELECT up.node, rest.parent FROM up JOIN rest ON rest.node = up.over),
ring AS (SELECT node FROM up WHERE node = over),
shut AS (SELECT up.node AS path, min(up.over) AS root_path FROM up JOIN ring ON ring.node = up.over GROUP BY 1),
tree AS (
  SELECT path, root_path, depth, full_path FROM down
  UNION ALL SELECT path, root_path, -1, NULL FROM shut)
"""

QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p4_cycles": p4_cycles}
SQL = {
    "p4_found": _TREE + "SELECT path, root_path, CAST(depth AS INT) AS depth FROM tree",
    "p4_paths": _TREE + "SELECT path, root_path, CAST(depth AS INT) AS depth, full_path FROM tree",
    "p4_descendants": _TREE
    + """, pairs AS (
  SELECT parent AS path, node AS below, 1 AS steps FROM l WHERE node IN (SELECT path FROM down)
  UNION ALL SELECT l.parent, p.below, p.steps + 1 FROM pairs p JOIN l ON l.node = p.path)
SELECT path, below, CAST(steps AS INT) AS steps FROM pairs""",
    "p4_cycles": _TREE + "SELECT path, root_path FROM tree WHERE depth < 0",
}
