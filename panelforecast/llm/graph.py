"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforecast.sources.stages import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of a link; ``root`` is the smallest node it can reach.

    Each round hangs all larger neighbours of a node on its smallest neighbour, then
    the node itself. Minima combine on the map side and the joins back are plain
    equality joins that adaptive execution splits, so a node with very many links is
    not one task's work. Rounds grow with the logarithm of the longest path, and each
    is a table in the shared folder: no lineage piles up and a lost executor costs a
    task. Links to null or to itself link nothing; without links the result is empty.
    """
    edges = links.select(F.col(a), F.col(b)).where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    edges = stage(edges.where("u <> v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = stage(hung.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
