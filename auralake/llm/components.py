"""Connected components of an edge table, without gathering nodes anywhere.

Alternates the large-star and small-star steps (Kiveris et al., 2014): each is
a partially aggregated minimum per node and an equi-join, and only O(log n)
rounds are needed. The minima of hubs are broadcast to their edges, so a hub of
any degree stays spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.session import join_unique, materialise


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step over ``total`` edges (u, v), u > v; gives edges of the same form."""
    if large:
        links = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = links.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("m"), "n")
        kept = join_unique(links.where("v > u"), least, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = join_unique(edges, least, ["u"], "n", total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return kept.where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node reachable.

    Null ends and loops are no edges; an empty table gives an empty one.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("v")).first()

    seen = state(now)
    while seen[0]:
        now = materialise(_star(materialise(_star(now, True, seen[0]), seen[0]), False, seen[0]), seen[0])
        found = state(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
