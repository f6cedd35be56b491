"""Connected components by alternating star operations, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import discard, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: neighbours are linked to the smallest one."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if small:  # smaller neighbours and the node itself go to the least of them
        new = joined.select(F.col("v").alias("u"), "m").unionByName(least.select("u", "m"))
    else:  # larger neighbours go to the least
        new = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), "m")
    return new.filter(F.col("u") > F.col("m")).select("u", F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge (a, b); component is the smallest node reached.

    Large and small stars alternate until nothing changes, in a number of rounds that grows
    with the logarithm of the longest path; each round is stored, so its lineage is cut.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    now, mark = stored(now, "edges"), None
    while True:
        last, now = now, stored(_star(_star(now, small=False), small=True), "edges")
        discard(last)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
