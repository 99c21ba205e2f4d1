"""Connected components of a link table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(u, v, least): every pair with the least of u and its partners; and the table of least ones.

    The minimum is a partial aggregate and is written before it is joined
    back, so a node with very many links is one row there and Spark may split
    its other side.
    """
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), name)
    return pairs.join(least, "u"), least


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; component is the least node reachable.

    Large-star and small-star steps in turn until nothing changes: the number
    of steps grows with the logarithm of the longest path.  Self-links and
    nulls are ignored, repeated links count once.  A step's tables are deleted
    when the next one is written.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    pairs = materialize(pairs, "links")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star, least = _star(both, "large")
        large = materialize(star.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct(), "links")
        release(pairs, least)
        # Small star: all partners are smaller here, so each pair (u, v) moves v and u under the least.
        small, least = _star(large, "small")
        moved = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v")))
        pairs = materialize(moved.filter("u <> v").distinct(), "links")
        release(large, least)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
