"""Connected components by alternating large-star and small-star steps, all of it joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.plans.materialise import keyed_join, store

# The steps need about log(n) rounds; a run that needs more has a fault.
MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    """For each node on the left the smallest of itself and its neighbours, and how many links it has."""
    best = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links"))
    return best.select("u", F.least("u", "m").alias("m"), "links")


def _with_smallest(edges: DataFrame, n: int) -> DataFrame:
    """A hub's links are spread over all tasks to meet its one row."""
    return keyed_join(edges, _smallest(edges), {"u": "u"}, False, "links", n)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an undirected list of links; the smallest node names it.

    Links of a node to itself and repeated links do no harm.  A node without links
    is not in the result.  Only one smallest neighbour per node is joined back, so
    a hub with very many links is a skewed join side, never a collected group.
    """
    edges = store(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.df.union(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both, 2 * edges.rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small = _with_smallest(large, edges.rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = _smallest(large).select("u", F.col("m").alias("v"))
        edges = store(small.union(low).distinct())
        now = edges.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
