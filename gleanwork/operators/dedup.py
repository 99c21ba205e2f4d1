"""First-seen deduplication in its several forms."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, forget, written


def first_seen(rows: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of every key in the given order."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rank", first).filter("__rank = 1").drop("__rank")


def greedy_first_seen(rows: DataFrame, keys: list[str], order: str, rounds: int = 6) -> DataFrame:
    """Accept a row iff it shares no key with an accepted earlier row; rejected rows claim nothing.

    ``order`` is a unique column.  Rounds decide all rows whose earlier
    neighbours are decided: a row that is the earliest undecided one of all
    its keys is accepted, and rows that share a key with it are rejected.
    Each round is a few aggregations by key over what is undecided; rows come in
    no particular order in practice, so few rounds settle nearly all.  A chain
    of rows that each share a key with the next, in order, would be decided one
    link a round, so after ``rounds`` rounds what is left is parted into its
    connected components, and each is scanned once in order, with the keys of
    its accepted rows in memory.  A round's tables are deleted once the next
    ones are written.  Null and empty keys do not count.
    """
    claims = None
    for k, name in enumerate(keys):
        part = rows.filter(F.col(name).isNotNull() & (F.col(name).cast("string") != "")).select(F.col(order).alias("o"), F.lit(k).alias("k"), F.col(name).cast("string").alias("v"))
        claims = part if claims is None else claims.union(part)
    open_claims = written(claims, "claims")
    accepted = [written(rows.select(F.col(order).alias("o")).join(open_claims.select("o").distinct(), "o", "left_anti"), "accepted")]
    left = True
    for _ in range(rounds):
        left = open_claims.limit(1).count() > 0
        if not left:
            break
        least = open_claims.groupBy("k", "v").agg(F.min("o").alias("first"))
        judged = open_claims.join(least, ["k", "v"])
        won = written(judged.groupBy("o").agg(F.bool_and(F.col("o") == F.col("first")).alias("won")).filter("won").select("o"), "won")
        accepted.append(won)
        taken = open_claims.join(won, "o", "left_semi").select("k", "v").distinct()
        lost = open_claims.join(taken, ["k", "v"], "left_semi").select("o").distinct()
        before, open_claims = open_claims, written(open_claims.join(lost, "o", "left_anti"), "claims")
        forget(before)
    if left and open_claims.limit(1).count():
        accepted.append(_scanned_in_order(open_claims))
    return rows.join(reduce(DataFrame.union, accepted).withColumnRenamed("o", order), order, "left_semi")


def _scanned_in_order(claims: DataFrame) -> DataFrame:
    """(o) of the rows that a scan of each component of ``claims`` (o, k, v) accepts."""
    node = F.xxhash64(F.lit("row"), F.col("o").cast("string"))
    # Hashes name the nodes: two with one hash make a component larger, not wrong.
    found = components(claims.select(node.alias("a"), F.xxhash64(F.lit("key"), "k", "v").alias("b")))
    held = claims.groupBy("o").agg(F.collect_list(F.concat_ws("\0", "k", "v")).alias("held"))
    placed = held.join(found, F.xxhash64(F.lit("row"), F.col("o").cast("string")) == F.col("node")).select("o", "held", "component")
    kind = dict(claims.dtypes)["o"]

    def scan(frames):
        here, seen = None, set()
        for frame in frames:
            kept = []
            for o, own, component in zip(frame["o"], frame["held"], frame["component"], strict=True):
                if component != here:
                    here, seen = component, set()
                if seen.isdisjoint(own):
                    kept.append(o)
                    seen.update(own)
            yield pd.DataFrame({"o": kept})

    out = written(placed.repartition("component").sortWithinPartitions("component", "o").mapInPandas(scan, f"o {kind}"), "scanned")
    forget(found)
    return out


def capped(rows: DataFrame, key: list[str], order: list[str | Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of every key, numbered from 1 as ``pos``."""
    pos = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("pos", pos).filter(F.col("pos") <= limit)
