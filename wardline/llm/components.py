"""Connected components of links, by alternating large and small stars.

Each round replaces a node's links by links to the smallest node around it; the number of rounds
follows the logarithm of the longest path. A node that holds much of all links is only ever grouped
with partial sums or joined to one row of its own, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut_lineage


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """``pairs`` u, v: each node u looks at its neighbours v (the smaller ones only, for a small star)."""
    around = pairs.where("v < u") if small else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))
    met = around.join(least, F.col("u") == F.col("_u"))
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _state(pairs: DataFrame):
    return pairs.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest member) for every node with a link to another; nulls have none."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    pairs = cut_lineage(pairs)
    before = _state(pairs)
    while before[0]:
        pairs = cut_lineage(_star(cut_lineage(_star(pairs, small=False)), small=True))
        now = _state(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
