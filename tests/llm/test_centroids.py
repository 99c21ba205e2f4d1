"""Centroid clustering against plain integers, and on rows that are no vectors."""

import hashlib
import math

import numpy as np
import pytest

from gleanwork.llm import centroids, queries


def brute(vectors, k, rounds, dim):
    """(cluster, distance) of each vector, the final centroids."""
    q = [[math.floor(256 * x) for x in v] for _, v in vectors]
    drawn = sorted(range(len(q)), key=lambda i: (hashlib.sha256(f"2:{vectors[i][0]}".encode()).hexdigest(), q[i]))[:k]
    c = [list(q[i]) for i in drawn]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), n) for n, m in enumerate(c)) for v in q]

    for _ in range(rounds):
        near = assign()
        for n in range(len(c)):
            mine = [v for v, (_, m) in zip(q, near, strict=True) if m == n]
            if mine:
                c[n] = [sum(v[i] for v in mine) // len(mine) for i in range(dim)]
    return [(n, d) for d, n in assign()], c


def rows_of(vectors, k, rounds, dim):
    near, c = brute(vectors, k, rounds, dim)
    of = {n: sum(d for m, d in near if m == n) for n, _ in near}
    return sorted((key, n, d, of[n], sum(d for _, d in near), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (key, _), (n, d) in zip(vectors, near, strict=True))


def test_registered_query(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_centroid_clusters"](spark, sf_dir)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == rows_of(vectors, 40, 5, 64)


@pytest.mark.parametrize("seed", range(2))
def test_random_vectors_with_a_hot_one(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)] + [(100 + i, [0.5, -0.25, 0.1]) for i in range(30)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = centroids.cluster(df, dim=3, k=5, rounds=3)
    assert sorted(map(tuple, got.collect())) == rows_of(vectors, 5, 3, 3)


def test_rows_without_a_sound_vector(spark):
    rows = [
        (1, [0.0, 1.0], 5), (1, [0.0, 1.0], 5), (None, [1.0, 0.0], 5), (2, None, 5), (3, [], 5), (4, [1.0], 5), (5, [1.0, None], 5),
        (6, [float("nan"), 1.0], 5), (7, [float("inf"), 1.0], 5), (8, [1e30, 1.0], 5), (9, [1.0, 2.0, 3.0], 5),
    ]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int"), dim=2, k=4, rounds=2).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (1, 0), (1, 0)]
    assert len({r.cluster for r in got if r.vec_id == 1}) == 1


def test_empty_table(spark):
    got = centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.count() == 0 and dict(got.dtypes)["distance"] == "bigint"


def test_no_python_and_no_vectors_in_the_plan_of_a_round(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    vectors = centroids.scaled(df, "vec_id", "embedding", 2, 256)
    plan = vectors.select(centroids.nearest(vectors["q"], [[0, 1], [5, 5]]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "array_min" in plan
