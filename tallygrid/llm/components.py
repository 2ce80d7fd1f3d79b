"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import saved

#: Edges that a task of a round is meant to take; a small graph is worked through in few tasks.
TASK_EDGES = 250_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node in edges (columns a and b of one orderable type).

    Large-star and small-star rounds in turn: each points a node's neighbours to its smallest one, first those above
    the node, then those below. A component becomes a star after about log(nodes) squared rounds at most, few in
    practice. Each round's edges are written to the shared folder. Self-links, repeats and nulls do no harm; rows with
    a null end are left out.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges)
    tasks, before = max(1, math.ceil(edges.count() / TASK_EDGES)), None
    edges = edges.coalesce(tasks)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        large = large.distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = saved(small.where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("a"), F.col("b").alias("component")).distinct()
    return stars.union(roots).select(F.col("a").alias("node"), "component").coalesce(tasks)
