"""Connected components of a graph given by its edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _mark(edges: DataFrame) -> tuple:
    """Number and sum of the edges' hashes: equal for equal sets."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), longs in any order -> node, root, for every node of an edge; the root is the component's smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour, with one
    aggregate and one join on the node; chains halve, and a hub is a key of the join whose rows Spark can split.
    Rounds go through tables in the shared folder.  No edges give no nodes.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = written(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct(), "edges")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
