"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashed word 5-grams, ordered by one global order: rare tokens by
hash, then frequent ones from less to more frequent.  A set of n tokens can
miss at most ``t = n - ceil(0.75 n)`` of them in a partner.  Its prefix is
extended until it weighs t + 1, where a rare token weighs 1 and a class of
frequent tokens weighs its size less 1; rare tokens are indexed singly,
frequent ones as all 2-combinations within their class.  Any two sets that
are similar enough share an indexed signature.  Classes are cut by hash into
as many parts as sets of a size level need, so a set has about as many
combinations as tokens; a set is indexed for its own size level and, if a
partner may be one level up, for that one too.

Where rare tokens suffice, prefixes are longer by ``n // 10`` tokens, of which
a partner must then share as many: a passage in common is not enough.

Equal sets (by 128 bits of their hash) are one node.  Signatures are dealt by
hash as packed arrays, into as many buckets as their number asks for.  In a
list of up to SHORT nodes pairs are counted, and pairs with too few shared
signatures over all lists go; longer lists link their nodes in a star.  The
components of these candidate links are verified by exact overlap counts from
inverted lists, in blocks of bounded size.  Of a component larger than a block
every node meets some hubs first, which joins a group of near copies in time
proportional to its size; blocks whose nodes are then still apart meet in
pairs.  No list of all pairs of a group is ever made, and no two sets that are
similar stay apart.

What counts as frequent comes from repeats seen inside a task, summed over all
documents: it steers the order and so the speed, never the result.  The
frequent table is bounded: the least count that counts as frequent is raised
until at most MOST_FREQUENT tokens have it.

Defined results: null and empty texts have no shingles and link with nothing;
rows with a null id keep a null component and link with nothing; rows that
repeat an id are documents of their own under one id; an empty table gives an
empty one; columns other than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .graph import connected_components

WORDS = 5
PERCENT = 75
TOKENS_AT_ONCE = 1 << 20
COUNTED_AT_ONCE = 1 << 22
LEAST_FREQUENT = 4
MOST_FREQUENT = 1 << 20
BLOCK = 1024
HUBS = 64
SHORT = 64
ENTRIES_AT_ONCE = 1 << 21
CACHE_WORDS = 300_000
_ODD = (np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of hashed word 5-grams; A-Z in lower case, words end at ASCII white space only."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        h = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct tokens of a whole text."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, make = self.known, self._hash
        w = np.array([known[x] if x in known else make(x) for x in words], dtype=np.uint64)
        if len(w) < WORDS:
            h = np.full(1, len(w), np.uint64)
            for x in w:
                h = _mixed(h * _ODD[0] + x)
            return h
        n = len(w) - WORDS + 1
        h = w[:n] * _ODD[0]
        for j in range(1, WORDS):
            h = h + w[j : j + n] * _ODD[j]
        return np.unique(_mixed(h))


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's hash as two longs."""
    h = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def most_missing(n: int) -> int:
    return n - -(-PERCENT * n // 100)


def level(n: int) -> int:
    return n.bit_length() - 1


def classes_at(lev: int) -> int:
    return max(1, (1 << lev) // 16)


@dataclass
class Frequent:
    """Frequent tokens in order of value, and each one's place in the order of frequency."""

    tokens: np.ndarray
    rank: np.ndarray

    def split(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rare tokens by hash, frequent tokens from less to more frequent)."""
        if not len(self.tokens):
            return tokens, tokens[:0]
        place = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        hot = self.tokens[place] == tokens
        return tokens[~hot], tokens[hot][np.argsort(self.rank[place[hot]], kind="stable")]


def signatures(tokens: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, int]:
    """Signatures of one set (single rare tokens, 2-combinations of frequent ones), and how many a partner must share."""
    n = len(tokens)
    missing = most_missing(n)
    rare, hot = frequent.split(tokens)
    if len(rare) > missing:
        rare = rare[: missing + max(1, n // 10)]
        return rare, len(rare) - missing
    made = [rare]
    need = missing + 1 - len(rare)
    levels = [level(n)] + [level(n) + 1] * (4 * n >= 3 << (level(n) + 1))
    for lev in levels:
        part = (_mixed(hot + np.uint64(lev)) % np.uint64(classes_at(lev))).astype(np.int64)
        # A token adds weight unless it is the first of its class.
        first = np.zeros(len(hot), dtype=bool)
        first[np.unique(part, return_index=True)[1]] = True
        weight = np.cumsum(~first)
        enough = np.flatnonzero(weight >= need)
        size = int(enough[0]) + 1 if len(enough) else len(hot)
        order = np.argsort(part[:size], kind="stable")
        group, token = part[:size][order], hot[:size][order]
        for gap in range(1, size):
            same = group[gap:] == group[:-gap]
            if not same.any():
                break
            a, b = token[gap:][same], token[:-gap][same]
            made.append(_mixed(np.minimum(a, b) * _ODD[1] + np.maximum(a, b) * _ODD[2] + np.uint64(lev + 1)))
    return np.unique(np.concatenate(made)), 1


def list_links(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) linked by long lists, as a spanning forest; then (a, b, shared) for pairs within short lists."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    one = np.ones(len(keys), dtype=bool)
    one[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[one], nodes[one]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    size = np.diff(np.append(start, len(keys)))
    length = np.repeat(size, size)
    head = np.repeat(nodes[start], size)
    far = (length > SHORT) & (head != nodes)
    star = forest(head[far], nodes[far])
    near = (length > 1) & (length <= SHORT)
    keys, nodes = keys[near], nodes[near]
    names, place = np.unique(nodes, return_inverse=True)
    codes = []
    for gap in range(1, SHORT):
        same = keys[gap:] == keys[:-gap]
        if not same.any():
            break
        codes.append(place[:-gap][same] * len(names) + place[gap:][same])
    code, shared = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return *star, names[code // max(1, len(names))], names[code % max(1, len(names))], shared


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (least node, node) for each connected component of links a - b."""
    if not len(a):
        return a, b
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        before = parent.copy()
        low = np.minimum(parent[x], parent[y])
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        np.minimum.at(parent, before[x], low)
        np.minimum.at(parent, before[y], low)
        parent = parent[parent]
        if (parent == before).all():
            break
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[parent[child]], nodes[child]


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of sets in ``left`` and ``right`` that are similar enough, by exact overlap counts.

    With equal sides each pair is looked at once.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    held = np.zeros(m, dtype=bool)
    held[right] = True
    order = np.argsort(tokens, kind="stable")
    distinct, run = np.unique(tokens, return_inverse=True)
    posted = owner[order]
    stop = np.cumsum(np.bincount(run, minlength=len(distinct)))
    start = np.concatenate([[0], stop[:-1]])
    at = np.concatenate([[0], np.cumsum(size)])
    both = len(left) == len(right) and (left == right).all()
    out_a, out_b = [], []
    for i in left.tolist():
        runs = run[at[i] : at[i + 1]]
        runs = runs[stop[runs] - start[runs] > 1]
        if not len(runs):
            continue
        length = stop[runs] - start[runs]
        spot = np.repeat(start[runs] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        shared = np.bincount(posted[spot], minlength=m)
        good = held & (100 * shared >= PERCENT * (size[i] + size - shared)) & (shared > 0)
        good[i] = False
        if both:
            good[: i + 1] = False
        j = np.flatnonzero(good)
        out_a.append(np.full(len(j), i))
        out_b.append(j)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))


FACTS_SCHEMA = "doc_id long, n long, node long, twin long, token long, repeats long"


def _facts(rows: DataFrame) -> DataFrame:
    """One row for each document (doc_id, n, node, twin), and rows (token, repeats) of tokens that repeat inside a task."""
    names = [f.split()[0] for f in FACTS_SCHEMA.split(", ")]

    def batch_of(size: int, **known: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([known.get(n, pa.nulls(size, pa.int64())) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, seen, size = Shingler(), [], set(), 0

        def repeats() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token, count = token[count > 1], count[count > 1]
            return batch_of(len(token), token=pa.array(token.view(np.int64)), repeats=pa.array(count, pa.int64()))

        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(1):
                tokens = shingle(text.as_py())
                sizes.append(len(tokens))
                nodes.append(set_id(tokens) if len(tokens) else (None, None))
                if len(tokens) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    held.append(tokens)
                    size += len(tokens)
                if size >= COUNTED_AT_ONCE:
                    yield repeats()
                    held, seen, size = [], set(), 0
            yield batch_of(len(sizes), doc_id=batch.column(0), n=pa.array(sizes, pa.int64()), node=pa.array([n for n, _ in nodes], pa.int64()), twin=pa.array([t for _, t in nodes], pa.int64()))
        yield repeats()

    return rows.mapInArrow(run, FACTS_SCHEMA)


def _frequent(facts: DataFrame) -> Frequent:
    """The most repeated tokens: all whose summed repeats reach the least count that at most MOST_FREQUENT tokens reach."""
    counts = materialize(facts.filter("token is not null").groupBy("token").agg(F.sum("repeats").alias("n")).filter(F.col("n") >= LEAST_FREQUENT), "token-repeats")
    # Sixteenths of a power of two: about a thousand rows at most, whatever the input.
    counts = counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int"))
    bound, kept = 1 << 30, 0
    for row in counts.groupBy("level").agg(F.count("*").alias("tokens")).orderBy(F.desc("level")).collect():
        kept += row["tokens"]
        if kept > MOST_FREQUENT:
            break
        bound = row["level"]
    hot = counts.filter(F.col("level") >= bound).select("token", "n").toPandas()
    token, count = hot["token"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64)
    order = np.argsort(token)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, count))] = np.arange(len(token))
    return Frequent(token[order], rank[order])


def _candidates(rows: DataFrame, frequent: Frequent, buckets: int) -> DataFrame:
    """Links (a, b) between nodes that share enough signatures.

    A signature is its bucket and 32 more bits of its hash: at any size of
    input a bucket holds about as many, so chance matches stay as rare.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    entry = np.dtype([("key", "<u4"), ("need", "<u4"), ("node", "<i8")])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, seen, size = Shingler(), [], set(), 0

        def flush() -> pa.RecordBatch:
            keys, length = np.concatenate([k for k, _, _ in held]), [len(k) for k, _, _ in held]
            rows = np.zeros(len(keys), entry)
            rows["key"] = (keys >> np.uint64(32)).astype(np.uint32)
            rows["node"], rows["need"] = np.repeat([n for _, n, _ in held], length), np.repeat([m for _, _, m in held], length)
            bucket = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = rows[order]
            some, cut = np.unique(bucket[order], return_index=True)
            cut = np.append(cut, len(rows))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for text in batch.column(0):
                tokens = shingle(text.as_py())
                node = set_id(tokens) if len(tokens) > 1 else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                own, need = signatures(tokens, shared.value)
                held.append((own, node[0], need))
                size += len(own)
                if size >= TOKENS_AT_ONCE:
                    yield flush()
                    held, size = [], 0
                    if len(seen) > CACHE_WORDS:
                        seen = set()
        if size:
            yield flush()

    def link(table: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(e, entry) for e in table.column("entries").to_pylist()])
        node, first = np.unique(entries["node"], return_index=True)
        own = entries["need"][first].astype(np.int64)
        a, b, x, y, count = list_links(entries["key"], entries["node"])
        need = np.minimum(own[np.searchsorted(node, x)], own[np.searchsorted(node, y)])
        return pa.table({"a": pa.array(np.concatenate([a, x]), pa.int64()), "b": pa.array(np.concatenate([b, y]), pa.int64()), "missing": pa.array(np.concatenate([np.zeros(len(a), np.int64), need - count]), pa.int64()), "need": pa.array(np.concatenate([np.zeros(len(a), np.int64), need]), pa.int64())})

    packed = rows.select("text").mapInArrow(post, "bucket long, entries binary")
    pairs = packed.groupBy("bucket").applyInArrow(link, "a long, b long, missing long, need long")
    # The lists of one pair may lie in several buckets: what they share adds up.
    return pairs.groupBy("a", "b").agg(F.sum(F.col("need") - F.col("missing")).alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")


NODE = ["vid", "doc_id", "node", "twin"]


def _size_class(n: str = "n"):
    """Similar sets lie in the same or the next class: their sizes differ by a third at most."""
    return F.floor(F.log(n) / float(np.log(100 / PERCENT))).cast("long")


def _first_tasks(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their task and side, nodes of large clusters).

    Clusters of up to BLOCK nodes are packed together by hash.  Larger ones are
    cut by size class and by hash; about HUBS nodes of a class, drawn by hash,
    meet every block of their class and its neighbours.
    """
    rows = clustered.withColumn("c", _size_class())
    per_class = rows.groupBy("cluster", "c").agg(F.count("*").alias("m"))
    total = per_class.groupBy("cluster").agg(F.sum("m").alias("total"))
    blocks = materialize(per_class.join(total, "cluster").filter(F.col("total") > BLOCK).select("cluster", "c", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "blocks")
    placed = rows.join(blocks, ["cluster", "c"], "left")
    packs = max(1, -(-rows.count() // BLOCK))
    small = placed.filter("blocks is null").select(*NODE, F.concat(F.lit("pack-"), F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("string")).alias("task"), F.lit(0).alias("side"))
    large = placed.filter("blocks is not null")
    own = large.select(*NODE, F.concat_ws("/", "cluster", "c", F.pmod(F.xxhash64("vid"), F.col("blocks"))).alias("task"), F.lit(1).alias("side"))
    hubs = large.filter(F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(1 << 30)) * F.col("m") <= F.lit(HUBS << 30)).select(*NODE, "cluster", F.explode(F.array(F.col("c") - 1, "c", F.col("c") + 1)).alias("c"))
    met = hubs.join(blocks.select("cluster", "c", "blocks"), ["cluster", "c"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return small.union(own).union(met.select(*NODE, F.concat_ws("/", "cluster", "c", "k").alias("task"), F.lit(2).alias("side"))), large.select(*NODE, "cluster", "c")


def _second_tasks(apart: DataFrame) -> DataFrame:
    """Nodes of large clusters (vid, ..., cluster, c, component) with the tasks where they meet nodes of other components.

    A component that fills half a block of its class has blocks of its own,
    the others share blocks; all blocks of neighbouring classes meet but two
    of one component.
    """
    many = apart.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("cluster")
    rows = apart.join(materialize(many, "split-clusters"), "cluster")
    sizes = rows.groupBy("cluster", "c", "component").agg(F.count("*").alias("m")).withColumn("pure", F.when(F.col("m") >= BLOCK // 2, F.col("component")).otherwise(-1))
    parts = materialize(sizes, "component-sizes")
    blocks = parts.groupBy("cluster", "c", "pure").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"))
    numbered = materialize(blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bid", F.monotonically_increasing_id()), "component-blocks")
    placed = rows.join(parts.select("cluster", "c", "component", "pure"), ["cluster", "c", "component"]).join(blocks, ["cluster", "c", "pure"]).withColumn("k", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    placed = placed.join(numbered.select("cluster", "c", "pure", "k", "bid"), ["cluster", "c", "pure", "k"]).select(*NODE, "bid")
    left = numbered.select("cluster", F.explode(F.array("c", F.col("c") + 1)).alias("c"), F.col("c").alias("own"), F.col("pure").alias("p"), F.col("bid").alias("a"))
    pairs = left.join(numbered.select("cluster", "c", "pure", F.col("bid").alias("b")), ["cluster", "c"]).filter("(own < c or a <= b) and (p = -1 or p <> pure)")
    pairs = materialize(pairs.select("a", "b", F.concat_ws("/", "a", "b").alias("task")), "block-pairs")
    one = pairs.select(F.col("a").alias("bid"), "task", F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side"))
    other = pairs.filter("a <> b").select(F.col("b").alias("bid"), "task", F.lit(2).alias("side"))
    return placed.join(one.union(other), "bid").select(*NODE, "task", "side")


def _verify(dealt: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between similar nodes of each task, as a spanning forest."""
    tasks = materialize(dealt.groupBy(*NODE).agg(F.collect_list(F.struct("task", "side")).alias("tasks")), "tasks")
    # A merge join at every size: the texts are dealt by id once, whatever share of them is a candidate.
    texts = tasks.join(rows.hint("merge"), "doc_id").select("vid", "node", "twin", "tasks", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            kept, packed = [], []
            for k, (node, twin, text) in enumerate(zip(batch.column("node").to_pylist(), batch.column("twin").to_pylist(), batch.column("text"), strict=True)):
                tokens = shingle(text.as_py())
                # An id may belong to several rows: only the text with this set counts.
                if len(tokens) and set_id(tokens) == (node, twin):
                    kept.append(k)
                    packed.append(tokens.tobytes())
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("vid"), rows.column("tasks"), pa.array(packed, pa.binary())], names=["vid", "tasks", "tokens"])

    def check(table: pa.Table) -> pa.Table:
        facts = np.column_stack([table.column("vid").to_numpy(), table.column("side").to_numpy()])
        facts, first = np.unique(facts, axis=0, return_index=True)
        vid, side = facts.T
        packed = table.column("tokens")
        tokens = [np.frombuffer(packed[int(k)].as_py(), dtype=np.uint64) for k in first]
        every = np.arange(len(vid))
        left, right = (every, every) if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        a, b = verified(tokens, left, right) if len(left) and len(right) else (every[:0], every[:0])
        a, b = forest(vid[a], vid[b])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    packed = texts.mapInArrow(sets, "vid long, tasks array<struct<task: string, side: int>>, tokens binary")
    dealt = packed.select("vid", "tokens", F.explode("tasks").alias("t")).select("vid", "tokens", F.col("t.task").alias("task"), F.col("t.side").alias("side"))
    return materialize(dealt.groupBy("task").applyInArrow(check, "a long, b long"), "similar")


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    facts = materialize(_facts(rows), "shingle-facts")
    documents = facts.filter("token is null").select("doc_id", "n", "node", "twin")
    # A prefix holds about 0.35 of a set's tokens.
    buckets = max(8, partitions(spark), int(0.35 * (documents.agg(F.sum("n")).first()[0] or 0)) // ENTRIES_AT_ONCE)
    links = materialize(_candidates(rows.filter("doc_id is not null"), _frequent(facts), buckets), "candidates")
    same = documents.filter("node is not null and doc_id is not null").groupBy("node", "twin").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies"))
    nodes = materialize(same.withColumn("vid", F.monotonically_increasing_id()), "nodes")
    clustered = materialize(connected_components(links).withColumnRenamed("component", "cluster").join(nodes, "node").select(*NODE, "n", "cluster"), "clustered")
    tasks, large = _first_tasks(clustered)
    found = _verify(tasks, rows)
    if large.limit(1).count():
        joined = connected_components(found).withColumnRenamed("node", "vid")
        apart = materialize(large.join(joined, "vid", "left").withColumn("component", F.coalesce("component", "vid")), "apart")
        found = found.union(_verify(_second_tasks(apart), rows))
    reached = connected_components(found).withColumnRenamed("node", "vid").join(nodes.select("vid", "node", "twin", "doc_id"), "vid")
    least = materialize(reached.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    by_node = reached.select("node", "twin", "component").join(least, "component").select("node", "twin", "component_id")
    classes = materialize(nodes.join(by_node, ["node", "twin"], "left").filter("copies > 1 or component_id is not null").select("node", "twin", F.coalesce("component_id", "doc_id").alias("component_id")), "classes")
    return documents.join(classes, ["node", "twin"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
