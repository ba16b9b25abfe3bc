"""Connected components by alternating large-star and small-star rounds, each a written table.

Defined results: edges (a, b) with a null end, and loops, link nothing and name no node; repeated edges and both directions of one
count once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (large: those above it; else those below, and itself) point to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    met = around.join(least, F.col("a") == F.col("u"))
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node that it reaches. Hubs are aggregated
    before the shuffle, and rounds grow with the logarithm of the longest path, not with a group's size."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(now)
    while before[0]:
        now = stored(_star(_star(now, large=True), large=False), "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    children = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return children.unionByName(roots)
