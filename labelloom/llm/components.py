"""Connected components by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import gathered


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))).first()
    return int(row[0]), int(row[1])


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """edges: a, b (long); nodes: about how many there are, for the number of files. Returns node, component: the smallest node that is reachable; nodes without an edge to another are left out.

    Each pass hangs nodes on the smallest neighbour, so stars collapse at once and chains
    by halves. A node with very many edges is one partial minimum, and a large partition of
    one side of a join, which adaptive execution splits; sides within the broadcast bound are broadcast. A pass writes one table.
    """
    now = gathered(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", nodes)
    seen = _sum(now)
    while seen[0]:
        # a pass never has more edges than the one before, nor more nodes than twice as many
        sized = F.broadcast if 2 * seen[0] <= common.broadcast_rows(narrow=True) else (lambda df: df)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sized(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        now = gathered(small.distinct(), "stars", nodes)
        last, seen = seen, _sum(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
