"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are drawn from the vectors by hash and thinned, so
that a group of near copies supplies one pivot and not its share of them; their
number grows with the square root of the vectors' number, which bounds their
broadcast.  A vector is described by its nearest pivots in order; the index is
the inverted list of each pivot, within each label and vector length.  Two
vectors are candidates if their descriptions share at least ``SHARED`` pivots,
counted over the lists; a candidate pair is verified once, in the list of its
least shared pivot, by cosine in double precision.

The length of descriptions is ``PREFIX`` or more: links of ``TRIALS`` sampled
vectors with all others, and pairs made to lie just at the threshold, must be
candidates at a rate of ``RECALL``; where the sample is the whole table, so that
its links are all there are, each of them must.  This holds at every size: a
small table has fewer pivots and goes the same way.

A list may be very long (a third of all rows may be near copies): lists are
cut into blocks of ``BLOCK`` members and pairs of blocks become tasks of their
own, so no task holds more than two blocks.  Ids and descriptions travel first;
vectors follow only to tasks where their row has a candidate.  Bit-equal vectors
are one class with a weight before all that.  No pair leaves a task: it returns
link counts and, for the components, a spanning forest.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite
values link with nothing, as do those with a null label and rows with a null id;
repeated rows of one id count as separate vectors; an empty table gives an empty
one; columns other than the three named ones are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

PREFIX = 10
SHARED = 2
BLOCK = 2048
FEWEST_PIVOTS = 64
RECALL = 0.995
TRIALS = 512
#: Of the links that a batch of rows has with the sampled vectors, so many are looked at.
LINKS_AT_ONCE = 512
ROUNDS = 8
PIVOTS_AT_ONCE = 1024
#: Similarities of so many pairs of a row and a pivot are in memory at a time.
CELLS_AT_ONCE = 1 << 21


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; large and small values are scaled first."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _blocks(rows: int, pivots: int) -> list[slice]:
    step = max(1, CELLS_AT_ONCE // max(1, pivots))
    return [slice(k, k + step) for k in range(0, rows, step)]


def describe(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first; ties go to the lower pivot."""
    take = min(prefix, len(pivots))
    out = np.empty((len(vectors), take), np.int32)
    for rows in _blocks(len(vectors), len(pivots)):
        far = -(vectors[rows] @ pivots.T)
        # The furthest of those taken; what lies nearer is in, and of those at that distance the lowest.
        last = np.partition(far, take - 1, axis=1)[:, take - 1 : take]
        room = take - (far < last).sum(axis=1, keepdims=True)
        level = far == last
        held = (far < last) | level & (np.cumsum(level, axis=1) <= room)
        names = np.nonzero(held)[1].reshape(-1, take)
        order = np.argsort(np.take_along_axis(far, names, axis=1), axis=1, kind="stable")
        out[rows] = np.take_along_axis(names, order, axis=1)
    return out


def number_of_pivots(n: int) -> int:
    return max(FEWEST_PIVOTS, 4 * math.isqrt(max(1, n)))


def apart(least: float) -> float:
    """Pivots are less alike than this: about two links away from each other."""
    return min(least, max(0.5, 2 * least * least - 1))


def thinned(kept: np.ndarray, drawn: np.ndarray, most: float, wanted: int) -> np.ndarray:
    """``kept`` and those of ``drawn``, in order, that are less than ``most`` alike to all before them."""
    out = list(kept)
    room = np.zeros((len(kept) + len(drawn), drawn.shape[1]))
    room[: len(kept)] = kept
    for v in drawn:
        if len(out) == wanted:
            break
        if not out or (room[: len(out)] @ v).max() < most:
            room[len(out)] = v
            out.append(v)
    return np.array(out)


def needed_prefix(x: np.ndarray, y: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The shortest descriptions with which x_i and y_i are candidates."""
    shared = min(SHARED, len(pivots)) - 1
    out = np.empty(len(x), np.int64)
    for rows in _blocks(len(x), len(pivots)):
        rank = [np.argsort(np.argsort(-(v[rows] @ pivots.T), axis=1, kind="stable"), axis=1) for v in (x, y)]
        out[rows] = np.partition(np.maximum(*rank), shared, axis=1)[:, shared] + 1
    return out


def enough(needed: np.ndarray, weight: np.ndarray, target: float = RECALL) -> int:
    """The shortest prefix that suffices for a share of ``target`` of the weight."""
    order = np.argsort(needed)
    return int(needed[order][np.searchsorted(np.cumsum(weight[order]), target * weight.sum() * (1 - 1e-12))])


def _draw(classes: DataFrame, n: int, dim: int, least: float) -> np.ndarray:
    """Pivots by hash; drawn again from the vectors far from all so far until there are enough or none is left."""
    wanted, most = number_of_pivots(n), apart(least)
    spots = classes.select(F.pmod(F.xxhash64("bits"), F.lit(1 << 30)).alias("s"), "v")
    share = min(1.0, 3 * wanted / max(1, n))
    left = spots.filter(F.col("s") < int(share * (1 << 30)) + 1)
    kept = np.zeros((0, dim))
    for _ in range(ROUNDS):
        drawn = left.orderBy("s").limit(2 * wanted).collect()
        if drawn:
            kept = thinned(kept, unit_rows(np.array([r["v"] for r in drawn])), most, wanted)
        if len(kept) == wanted or (not drawn and len(kept)):
            break
        shared = classes.sparkSession.sparkContext.broadcast(kept)

        def far(batches, shared=shared):
            for batch in batches:
                if batch.num_rows and len(shared.value):
                    x = unit_rows(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, dim))
                    near = [(x[rows] @ shared.value.T).max(axis=1) for rows in _blocks(len(x), len(shared.value))]
                    batch = batch.filter(pa.array(np.concatenate(near) < most))
                yield batch

        left = spots.mapInArrow(far, spots.schema)
    return kept


def _prefix_for_recall(classes: DataFrame, n: int, pivots: np.ndarray, dim: int, least: float) -> int:
    """Prefix that makes links candidates at the target rate: of all sampled links, of a sampled vector on average, and at the threshold."""
    whole = n <= TRIALS
    labels = classes.withColumn("h", F.xxhash64("label"))
    trials = labels.select("cid", "h", "v").orderBy(F.xxhash64("bits", F.lit(1))).limit(TRIALS).collect()
    q = unit_rows(np.array([r["v"] for r in trials]))
    cid, h = np.array([r["cid"] for r in trials]), np.array([r["h"] for r in trials])
    prefix = min(PREFIX, len(pivots))
    if dim > 1:
        u = np.random.default_rng(5).normal(size=q.shape)
        u -= (u * q).sum(axis=1, keepdims=True) * q
        edge = least * q + math.sqrt(max(0.0, 1 - least * least)) * u / np.sqrt((u * u).sum(axis=1, keepdims=True))
        prefix = max(prefix, enough(needed_prefix(q, edge, pivots), np.ones(len(q))))
    shared = classes.sparkSession.sparkContext.broadcast((q, cid, h, pivots))

    def links(batches):
        q, cid, h, pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, dim))
            same = (batch.column("h").to_numpy()[:, None] == h) & (batch.column("cid").to_numpy()[:, None] != cid)
            i, j = np.nonzero((x @ q.T >= least) & same)
            if len(i):
                take = np.arange(len(i)) if whole else np.linspace(0, len(i) - 1, min(len(i), LINKS_AT_ONCE)).astype(int)
                needed = needed_prefix(x[i[take]], q[j[take]], pivots)
                yield pa.RecordBatch.from_arrays([pa.array(j[take], pa.int64()), pa.array(needed, pa.int64()), pa.array(np.full(len(take), len(i) / len(take)))], names=["q", "needed", "weight"])

    found = labels.select("cid", "h", "v").mapInArrow(links, "q long, needed long, weight double").groupBy("q", "needed").agg(F.sum("weight").alias("weight")).collect()
    if found:
        q, needed, weight = np.array([tuple(r) for r in found]).T
        each = weight / np.bincount(q.astype(int), weight)[q.astype(int)]
        prefix = max(prefix, int(needed.max())) if whole else max(prefix, enough(needed, weight), enough(needed, each))
    return prefix


def candidates(near_x: np.ndarray, near_y: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Whether x_i and y_j share enough pivots and ``pivot`` is the least of them; a few pivots at a time."""
    names = np.unique(np.concatenate([near_x.ravel(), near_y.ravel()]))
    count = np.zeros((len(near_x), len(near_y)), np.float32)
    lower = np.zeros(count.shape, bool)
    edges = [*range(0, int(np.searchsorted(names, pivot)), PIVOTS_AT_ONCE), *range(int(np.searchsorted(names, pivot)), len(names), PIVOTS_AT_ONCE), len(names)]
    for start, stop in zip(edges, edges[1:], strict=False):
        both = _held(near_x, names[start:stop]) @ _held(near_y, names[start:stop]).T
        count += both
        if names[start] < pivot:
            lower |= both > 0
    return (count >= shared) & ~lower


def _held(near: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Rows x names: 1 where a description holds the pivot."""
    out = np.zeros((len(near), len(names) + 1), np.float32)
    place = np.minimum(np.searchsorted(names, near), len(names) - 1)
    out[np.arange(len(near))[:, None], np.where(names[place] == near, place, len(names))] = 1
    return out[:, :-1]


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A star for each connected component of n places."""
    parent = np.arange(n)
    while True:
        low = np.minimum(parent[pairs[:, 0]], parent[pairs[:, 1]])
        before = parent.copy()
        np.minimum.at(parent, pairs[:, 0], low)
        np.minimum.at(parent, pairs[:, 1], low)
        parent = parent[parent]
        if (parent == before).all():
            return [(int(parent[k]), k) for k in np.flatnonzero(parent != np.arange(n))]


def near_duplicates(df: DataFrame, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    sound = "vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    good = rows.filter(sound).withColumn("bits", F.sha2(F.to_json(F.struct("label", "v")), 256))
    # Bit-equal vectors of a label: one class with a weight; its number is fixed once the table is written.
    same = good.groupBy("bits").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(same.select(F.monotonically_increasing_id().alias("cid"), "bits", "rep", "weight", "label", "v", F.size("v").alias("dim")), "vector-classes")
    plan: dict[int, tuple[np.ndarray, int]] = {}
    for dim, n in classes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        mine = classes.filter(F.col("dim") == dim)
        drawn = _draw(mine, n, dim, least)
        plan[dim] = drawn, _prefix_for_recall(mine, n, drawn, dim, least)
    pivots = spark.sparkContext.broadcast(plan)
    kind = dict(classes.dtypes)["label"]

    def post(batches):
        plan_of = pivots.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat, stop = np.asarray(batch.column("v").flatten()), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = unit_rows(flat[(stop[own] - dim)[:, None] + np.arange(dim)])
                near = np.sort(describe(x, *plan_of[dim]), axis=1)
                rows = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("label", "dim", "cid", "weight")), pa.array(list(near), pa.list_(pa.int32())), pa.array([v.tobytes() for v in x], pa.binary())], names=["label", "dim", "cid", "weight", "near", "x"])

    described = materialize(classes.select("label", "dim", "cid", "weight", "v").mapInArrow(post, f"label {kind}, dim int, cid long, weight long, near array<int>, x binary"), "descriptions")
    postings = described.select("label", "dim", F.explode("near").alias("pivot"), "cid", "near")
    lists = materialize(postings.groupBy("label", "dim", "pivot").agg(F.count("*").alias("members")).filter("members > 1").select("label", "dim", "pivot", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "pivot-list-sizes")
    placed = postings.join(lists, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Every pair of blocks is one task: a row goes to all pairs that its block is in.
    task = ["label", "dim", "pivot", "low", "high"]
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select(*task, "own", "cid", "near")

    def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the two blocks' rows, all rows' descriptions, and which pairs are candidates."""
        dim, pivot, low, high = (table.column(c)[0].as_py() for c in ("dim", "pivot", "low", "high"))
        own, flat = table.column("own").to_numpy(), np.asarray(table.column("near").combine_chunks().flatten())
        near = flat.reshape(len(own), -1)
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        pair = candidates(near[a], near[b], pivot, min(SHARED, len(pivots.value[dim][0])))
        if low == high:
            pair &= ~np.eye(len(a), dtype=bool)
        return a, b, pair, own

    def meet(table: pa.Table) -> pa.Table:
        a, b, pair, _ = sides(table)
        some = np.union1d(a[pair.any(axis=1)], b[pair.any(axis=0)])
        return table.take(pa.array(some)).drop_columns("near")

    met = spread.groupBy(*task).applyInArrow(meet, f"label {kind}, dim int, pivot int, low int, high int, own int, cid long")
    full = materialize(met, "pivot-tasks").join(described.select("cid", "weight", "near", "x"), "cid")

    def verify(table: pa.Table) -> pa.Table:
        a, b, pair, own = sides(table)
        cid, weight = table.column("cid").to_numpy(), table.column("weight").to_numpy()
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float64).reshape(len(cid), -1)
        hit = pair & (x[a] @ x[b].T >= least)
        links = np.zeros(len(cid), np.int64)
        links[a] += hit @ weight[b]
        if len(a) and len(b) and own[a[0]] != own[b[0]]:
            links[b] += hit.T @ weight[a]
        i, j = np.nonzero(hit)
        forest = _forest(len(cid), np.column_stack([a[i], b[j]])) if len(i) else []
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array([*cid[some].tolist(), *[int(cid[p]) for p, _ in forest]], pa.int64()), "b": pa.array([None] * len(some) + [int(cid[c]) for _, c in forest], pa.int64()), "links": pa.array([*links[some].tolist(), *[0] * len(forest)], pa.int64())})

    found = materialize(full.groupBy(*task).applyInArrow(verify, "a long, b long, links long"), "vector-links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("b is not null")).withColumnRenamed("node", "cid")
    reached = materialize(classes.select("cid", "rep").join(components, "cid"), "vector-components")
    smallest = materialize(reached.groupBy("component").agg(F.min("rep").alias("component_id")), "vector-component-ids")
    by_class = reached.join(smallest, "component").select("cid", "component_id")
    facts = materialize(classes.select("bits", "cid", "rep", "weight").join(counts, "cid", "left").join(by_class, "cid", "left").select("bits", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "vector-facts")
    # Members of a class find it by their bits; a huge class is split there, not gathered.
    joined = good.select("vec_id", "bits").join(facts, "bits").select("vec_id", "n_links", "component_id")
    rest = rows.filter(f"not coalesce({sound}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(df: DataFrame, least: float = 0.93, every: int = 100) -> float:
    """Share of true links found for the rows whose id ``every`` divides, by brute force against all rows in blocks of the query set."""
    found = near_duplicates(df, least).select("vec_id", "n_links").filter(F.col("vec_id") % every == 0)
    rows = df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter("label is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.select("vec_id", "label", F.transform("v", lambda x: x / norm).alias("u"))
    query = F.broadcast(unit.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), "label", F.col("u").alias("w")))
    dot = F.aggregate(F.zip_with("u", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    truth = unit.join(query, "label").filter((F.col("vec_id") != F.col("q")) & (dot >= least)).groupBy(F.col("q").alias("vec_id")).agg(F.count("*").alias("true_links"))
    both = found.join(truth, "vec_id", "left").agg(F.sum("n_links"), F.sum("true_links")).first()
    return float(both[0] / both[1]) if both[1] else 1.0
