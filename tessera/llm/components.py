"""Connected components of a graph held as a table of links.

Alternating large-star and small-star steps (Kiveris et al., 2014), each a
grouped minimum and a join, written to the shared folder once per round. Links
never leave the executors. The minimum per node is combined before the shuffle
and is one row per node, so a node with very many links is only a skewed join
side, which adaptive execution splits or avoids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def connected(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every linked node; the component is its least node."""
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    links = materialize(links, "links")
    held, state = links, _state(links)
    for _ in range(max_rounds):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a")
        links = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        links, read = materialize(links, "links"), held
        discard(read)
        held = links
        before, state = state, _state(links)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
