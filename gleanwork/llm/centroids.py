"""Centroid clustering in whole numbers, with DataFrame expressions alone.

Components are scaled and floored once and written as arrays of integers.  In
each round ``zip_with`` and ``aggregate`` give the squared distance of a vector
to every centroid of a literal array, ``array_min`` of (distance, number)
structs picks the nearest (ties: smaller number), and one aggregation with a
sum for each component, combined before its shuffle, gives the next centroids:
``k`` rows of ``dim`` sums, whatever the number of vectors, are all that the
driver sees.  Sums and floors are exact, so results do not depend on order.

Defined results: vectors that are null, have another length, or hold a null,
non-finite or huge component (scaled beyond ``LARGEST``, where squared
distances would not fit a long) are not kept and give no row; a null id counts
as the empty string when starts are drawn, and is returned as null; repeated
rows are clustered each, equal vectors alike; with fewer kept vectors than
``k`` each starts a centroid (equal ones: the smaller number wins, the other
stays empty and unchanged); an empty table gives an empty one; columns beside
id and vector are ignored.  An inertia that does not fit a long is null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: 64 squared differences of numbers up to here stay below 2 ** 63.
LARGEST = 1 << 27


def scaled(df: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(key, q): kept vectors, each component as the integer floor(scale * x), x as double."""
    # A null component makes forall null, and so the row is dropped as well.
    raised = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.floor(F.when((x * scale >= -float(LARGEST)) & (x * scale < float(LARGEST)), x * scale)))
    rows = df.select(F.col(f"`{key}`").alias("key"), raised.alias("q"))
    return rows.filter((F.size("q") == dim) & F.forall("q", lambda x: x.isNotNull())).select("key", F.col("q").cast("array<int>").alias("q"))


def nearest(q: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, number) of the centroid nearest to ``q``."""

    def distance(c: Column) -> Column:
        return F.aggregate(F.zip_with(q, c, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)

    # Foldable, so that the plan holds the arrays as one literal, made by one call instead of one for each number.
    arrays = F.from_json(F.lit(json.dumps(centroids)), "array<array<bigint>>")
    return F.array_min(F.transform(arrays, lambda c, i: F.struct(distance(c).alias("distance"), i.alias("number"))))


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ``seed:key`` has the smallest SHA-256, in that order (ties: smaller vector)."""
    drawn = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in vectors.select(drawn.alias("h"), "q").orderBy("h", "q").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Centroids after one round: floors of the means of their vectors; empty ones stay."""
    assigned = vectors.select("q", nearest(F.col("q"), centroids)["number"].alias("cluster"))
    sums = [F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(dim)]
    out = list(centroids)
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """One row for each kept vector: its key, cluster, distance, inertias and the digest of its centroid."""
    spark = df.sparkSession
    vectors = materialize(scaled(df, key, vector, dim, scale), "scaled")
    centroids = starts(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids, dim)
    chosen = nearest(F.col("q"), centroids or [[0] * dim])
    assigned = materialize(vectors.select("key", chosen.alias("near")).select("key", F.col("near.number").alias("cluster"), F.col("near.distance").alias("distance")), "clusters")
    release(vectors)
    # At most k rows each: the sums over clusters, and the centroids themselves.
    spent = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("spent")).collect()
    total = sum(r["spent"] for r in spent)
    of = {r["cluster"]: r["spent"] for r in spent}
    known = spark.createDataFrame([(i, *(None if v is None or v >= 1 << 63 else int(v) for v in (of.get(i), total)), ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, components string")
    named = known.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(named), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
