"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node with a link can reach, from links (a, b) of longs.

    Each round hangs larger neighbours, then smaller ones, on the smallest neighbour, until every node hangs on its
    component's smallest node: rounds grow with the logarithm of the longest path. Hubs are aggregated before their
    shuffle, and the joins on them can be split by the engine. Each round's links are written to the shared folder.
    """
    if rounds < 1:
        raise ValueError("rounds must be positive")
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # a smallest node keeps its place: its own links come back as those of its neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), label)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
