"""Repeated byte strings, by blockwise suffix sorting with a difference cover.

Removed is every byte that a string of ``LENGTH`` bytes covers which starts
anywhere else as well.  The work is cut so that only text that may repeat is
ever sorted, and no task holds more than its share of it:

1. Every ``LENGTH``-byte string holds an anchor, the least hash of its
   ``GRAM``-byte pieces, which its content alone decides.  The starts of one
   anchor form a run, and the run's text is its context.  Anchors that occur
   once cannot repeat.  Equal contexts (by two independent 64-bit hashes of
   their bytes) are one context with a weight: if it is above one, all starts
   of its run repeat.
2. Contexts of an anchor that has several, one of each kind, are gathered by
   anchor, in as many buckets as the bytes of these contexts ask for (they are
   known by then).  Each task takes whole anchors, about ``SORTED_BYTES`` of text
   at a time, so the sorter's memory does not grow with a bucket, and sorts their
   suffixes, one bucket of leading bytes after another; suffixes
   that tie on the cover's period are ordered by the ranks of a
   difference-cover sample, computed beforehand, so a tie of any depth costs one
   look-up.  Neighbours whose ``LENGTH`` bytes agree repeat.
3. Anchors of very many texts (at a common passage's edge every context differs,
   so their contexts would meet in one task) are known from a count beforehand,
   at most ``MOST_HOT`` of them, and are split: each start goes by itself, dealt
   by both hashes of its string, equal ones as one with a weight.

Texts with equal bytes are one text with a weight, and equal contexts are
added up inside each task before anything is shuffled.

Defined results: null counts as empty; texts shorter than ``LENGTH`` keep all;
matches never cross documents; repeated rows are copies of each other; an empty
table gives an empty one; columns other than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1
STARTS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 400_000
LEAST_HOT = 512
MOST_HOT = 1 << 22
BUCKET_BYTES = 48 << 20
#: Text of the contexts that go to one task, and that are sorted at a time: whole anchors, so up to one anchor's text more.
TASK_BYTES = 24 << 20
SORTED_BYTES = 2 << 20
PERIOD = 32
SUFFIXES_AT_ONCE = 1 << 18
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Packed rows: places fit 32 bits (a text is one Arrow string), runs have WINDOW starts at most, weights above two count as two.
ROW = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("twin", "<u8"), ("key", "<i8"), ("lo", "<i4"), ("span", "u1"), ("off", "u1"), ("weight", "u1")])
START = np.dtype([("string", "<u8"), ("twin", "<u8"), ("key", "<i8"), ("lo", "<i4"), ("weight", "u1")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C[1]
    return h ^ (h >> np.uint64(29))


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of strings twice as long."""
    return _mix(h[:-width] * _C[0] + h[width:])


POWERS = np.cumprod(np.full(STARTS_AT_ONCE + LENGTH, np.uint64(0xD1342543DE82EF95)))


class Hashes:
    """Hashes of the GRAM- and 128-byte strings at every place of a block of bytes."""

    def __init__(self, block: np.ndarray):
        h, width = _mix((block.astype(np.uint64) + np.uint64(1)) * _C[2]), 1
        while width < 128:
            if width == GRAM:
                self.gram = h
            h, width = _doubled(h, width), 2 * width
        self.long = h
        # Sums of bytes by powers of an odd number, for a second hash that shares nothing with the first.
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((block.astype(np.uint64) + np.uint64(7)) * POWERS[: len(block)])])

    def spans(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``lo``, ``size`` of them (from 128 to 384)."""
        end = lo + size - 128
        return _mix(_mix(self.long[lo] * _C[0] + self.long[np.minimum(lo + 128, end)]) * _C[0] + self.long[end] + size.astype(np.uint64) * _C[2])


    def twins(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The second hash of the same bytes: their sum, moved to a common power."""
        return _mix((self.sums[lo + size] - self.sums[lo]) * POWERS[len(POWERS) - 1 - lo] + size.astype(np.uint64))


def anchors(gram: np.ndarray, starts: int) -> np.ndarray:
    """For each start, the place of the least gram in its window, the leftmost of equals."""
    place = np.arange(len(gram), dtype=np.uint64)
    low = (gram & np.uint64(~((1 << 20) - 1) & 0xFFFFFFFFFFFFFFFF)) | place
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: starts], low[WINDOW - width : WINDOW - width + starts])
    return (low & np.uint64((1 << 20) - 1)).astype(np.int64)


def runs_of(data: bytes) -> Iterator[tuple[Hashes, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of a block, its place, first and last start of each run, their anchor), places within the block."""
    whole = np.frombuffer(data, dtype=np.uint8)
    for begin in range(0, len(whole) - LENGTH + 1, STARTS_AT_ONCE):
        block = whole[begin : begin + STARTS_AT_ONCE + LENGTH - 1]
        hashes = Hashes(block)
        anchor = anchors(hashes.gram, len(block) - LENGTH + 1)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:] - 1, len(anchor) - 1)
        yield hashes, begin, first, last, anchor[first]


# -- suffix sorting inside a task -----------------------------------------


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences are all residues: found greedily, checked by construction."""
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max(range(period), key=lambda c: (len({(c - d) % period for d in cover} & missing) + len({(d - c) % period for d in cover} & missing), -c))
        cover.append(best)
        missing -= {(a - b) % period for a in cover for b in cover}
    return np.array(sorted(set(cover)))


COVER = difference_cover(PERIOD)
#: For residues r and s, the least step after which both lie in the cover.
STEP = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in set(COVER.tolist()) and (s + d) % PERIOD in set(COVER.tolist())) for s in range(PERIOD)] for r in range(PERIOD)])


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows by columns, equal rows alike."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class SuffixSorter:
    """Order of chosen suffixes of a text, with the ranks of its difference-cover sample."""

    def __init__(self, text: bytes, depth: int = LENGTH):
        raw = np.frombuffer(text + bytes(depth + 2 * PERIOD), dtype=np.uint8)
        self.size = len(text)
        # Eight bytes from each place as one big-endian number.
        word = raw[: len(raw) - 7].astype(np.uint64)
        for k in range(1, 8):
            word = (word << np.uint64(8)) | raw[k : len(raw) - 7 + k]
        self.word = word
        self._rank_sample(depth)

    def _rank_sample(self, depth: int) -> None:
        places = np.arange(self.size)
        sample = places[np.isin(places % PERIOD, COVER)]
        rank = _dense(*[self.word[sample + 8 * k] for k in range(PERIOD // 8)])
        # The sample is closed under steps of one period, so ranks double in depth.
        self.rank = np.full(self.size + 8 * depth, -1, np.int64)
        self.rank[sample] = rank
        reach = PERIOD
        while reach < depth:
            rank = _dense(rank, self.rank[sample + reach])
            self.rank[sample] = rank
            reach *= 2

    def less(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether suffix p comes before q, for suffixes that agree on one period."""
        step = STEP[p % PERIOD, q % PERIOD]
        return self.rank[p + step] < self.rank[q + step]

    def _settle(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sort within groups of suffixes that tie on one period: a bitonic network for all groups of a size class."""
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        for bits in range(1, int(size.max(initial=1) - 1).bit_length() + 1):
            wide = 1 << bits
            mine = np.flatnonzero((size > wide // 2) & (size <= wide))
            for some in np.array_split(mine, max(1, len(mine) * wide // SUFFIXES_AT_ONCE)):
                if not len(some):
                    continue
                col = np.arange(wide)
                there = col[None] < size[some][:, None]
                grid = np.where(there, order[np.minimum(start[some][:, None] + col[None], len(order) - 1)], -1)
                block = 2
                while block <= wide:
                    gap = block // 2
                    while gap:
                        a = col[(col & gap) == 0]
                        b = a | gap
                        x, y = grid[:, a], grid[:, b]
                        # Missing places (-1) count as largest.
                        swap = np.where(y < 0, False, np.where(x < 0, True, self.less(np.maximum(y, 0), np.maximum(x, 0))))
                        down = ((a & block) != 0)[None] & (block < wide)
                        back = np.where(x < 0, False, np.where(y < 0, True, self.less(np.maximum(x, 0), np.maximum(y, 0))))
                        swap = np.where(down, back, swap)
                        grid[:, a], grid[:, b] = np.where(swap, y, x), np.where(swap, x, y)
                        gap //= 2
                    block *= 2
                order[(start[some][:, None] + col[None])[there]] = grid[there]
        return order

    def buckets(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The starts in suffix order, bucket after bucket of leading bytes; a bucket's text is sorted alone."""
        lead = (self.word[starts] >> np.uint64(48)).astype(np.int64)
        starts = starts[np.argsort(lead, kind="stable")]
        edge = np.cumsum(np.bincount(lead, minlength=1 << 16))
        begin = 0
        while begin < len(starts):
            end = int(edge[min(np.searchsorted(edge, begin + SUFFIXES_AT_ONCE), len(edge) - 1)])
            end = end if end > begin else len(starts)
            part = starts[begin:end]
            words = [self.word[part + 8 * k] for k in range(PERIOD // 8)]
            order = np.lexsort(words[::-1])
            part = part[order]
            new = np.zeros(len(part), dtype=bool)
            for w in words:
                s = w[order]
                new[1:] |= s[1:] != s[:-1]
            yield self._settle(part, np.cumsum(new))
            begin = end

    def repeated(self, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """The starts whose ``length`` bytes another one of them has too."""
        found = []
        for order in self.buckets(starts):
            a, b = order[:-1], order[1:]
            same = np.ones(len(a), dtype=bool)
            for at in [*range(0, length - 7, 8), length - 8]:
                live = np.flatnonzero(same)
                same[live] = self.word[a[live] + at] == self.word[b[live] + at]
            found.append(np.union1d(a[same], b[same]))
        return np.concatenate(found) if found else starts[:0]


def _ranges(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, lo, span) of runs of consecutive places of one key."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    if not len(key):
        return key, place, place
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] > place[:-1] + 1)]))
    stop = np.append(start[1:], len(key)) - 1
    return key[start], place[start], place[stop] - place[start]


# -- the job --------------------------------------------------------------


def _by_weight(rows: np.ndarray, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by the named fields, and the weight of each one's group of equals."""
    rows = rows[np.lexsort([rows[n] for n in reversed(names)])]
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    new = np.zeros(len(rows), dtype=bool)
    for n in names:
        new[1:] |= rows[n][1:] != rows[n][:-1]
    group = np.cumsum(new)
    return rows, np.bincount(group, weights=rows["weight"])[group].astype(np.int64)


class _Chunk:
    """Rows of some documents, added up before they leave the task."""

    def __init__(self, hot: np.ndarray, buckets: int):
        self.hot, self.buckets = hot, buckets
        self.rows: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.weight: dict[int, int] = {}
        self.size = 0

    def add(self, key: int, data: bytes) -> None:
        self.weight[key] = self.weight.get(key, 0) + 1
        if self.weight[key] > 1:
            return
        for hashes, begin, first, last, anchor in runs_of(data):
            rows = np.zeros(len(first), ROW)
            rows["anchor"], rows["key"], rows["lo"], rows["span"], rows["off"] = hashes.gram[anchor], key, begin + first, last - first, anchor - first
            rows["context"] = _mix(hashes.spans(first, last - first + LENGTH) + (anchor - first).astype(np.uint64) * _C[0])
            rows["twin"] = hashes.twins(first, last - first + LENGTH)
            if len(self.hot):
                hot = self.hot[np.minimum(np.searchsorted(self.hot, rows["anchor"]), len(self.hot) - 1)] == rows["anchor"]
                if hot.any():
                    count = last[hot] - first[hot] + 1
                    place = np.repeat(first[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    starts = np.zeros(len(place), START)
                    size = np.full(len(place), LENGTH)
                    starts["string"], starts["twin"], starts["key"], starts["lo"] = hashes.spans(place, size), hashes.twins(place, size), key, begin + place
                    self.starts.append(starts)
                    self.size += len(starts)
                    rows = rows[~hot]
            self.rows.append(rows)
            self.size += len(rows)

    def flush(self) -> pa.RecordBatch:
        """Ranges already known to repeat, and the rest by bucket; one row of each kind of context or string leaves."""
        known, packed = [], []
        copied = np.array([k for k, w in self.weight.items() if w > 1], np.int64)
        for kind, parts, dtype, names in ((0, self.rows, ROW, ("anchor", "context", "twin")), (1, self.starts, START, ("string", "twin"))):
            rows = np.concatenate(parts) if parts else np.zeros(0, dtype)
            rows["weight"] = 1 + np.isin(rows["key"], copied)
            rows, weight = _by_weight(rows, names)
            again = rows[weight > 1]
            known.append((again["key"], again["lo"], again["span"].astype(np.int64) if kind == 0 else np.zeros(len(again), np.int64)))
            one = np.ones(len(rows), dtype=bool)
            one[1:] = np.logical_or.reduce([rows[n][1:] != rows[n][:-1] for n in names])
            rows, weight = rows[one], weight[one]
            rows["weight"] = np.minimum(weight, 2)
            bucket = ((rows[names[0]] >> np.uint64(24)) % np.uint64(self.buckets)).astype(np.int64)
            rows, bucket = rows[np.argsort(bucket, kind="stable")], np.sort(bucket)
            some, cut = np.unique(bucket, return_index=True)
            edge = [*cut.tolist(), len(rows)]
            packed += [(kind, k, rows[a:b].tobytes()) for k, a, b in zip(some.tolist(), edge, edge[1:], strict=False)]
        place = np.concatenate([lo for _, lo, _ in known]), np.concatenate([s for _, _, s in known])
        out = [*_merged(np.concatenate([k for k, _, _ in known]), *place)]
        n = len(out[0])
        self.rows, self.starts, self.weight, self.size = [], [], {}, 0
        return pa.RecordBatch.from_arrays(
            [pa.array([*out[0].tolist(), *[None] * len(packed)], pa.int64()), pa.array([*out[1].tolist(), *[None] * len(packed)], pa.int64()), pa.array([*out[2].tolist(), *[None] * len(packed)], pa.int64()), pa.array([None] * n + [p[0] for p in packed], pa.int32()), pa.array([None] * n + [p[1] for p in packed], pa.int32()), pa.array([None] * n + [p[2] for p in packed], pa.binary())],
            names=["key", "lo", "span", "kind", "bucket", "packed"],
        )


def _merged(key: np.ndarray, lo: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts of each key, adjacent ones joined."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], (lo + span)[order]
    if not len(key):
        return key, lo, hi
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] > hi[:-1] + 1)]))
    return key[start], lo[start], np.maximum.reduceat(hi, start) - lo[start]


def _hot_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors of more than LEAST_HOT texts and of a 1 / MOST_HOT share of all: at most MOST_HOT of them, from counts over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, size, seen = [], 0, 0, set()

        def repeats() -> pa.RecordBatch:
            anchor, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            some = count > 1
            return pa.RecordBatch.from_arrays([pa.array([*anchor[some].view(np.int64).tolist(), None], pa.int64()), pa.array([*count[some].tolist(), total], pa.int64())], names=["anchor", "n"])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                for hashes, _, _, _, anchor in runs_of(data.as_py() or b""):
                    # A text counts an anchor once.
                    held.append(np.unique(hashes.gram[anchor]))
                    size += len(held[-1])
                    total += len(held[-1])
                if size >= ROWS_AT_ONCE:
                    yield repeats()
                    held, total, size, seen = [], 0, 0, set()
        yield repeats()

    counts = materialize(rows.select("key", "data").mapInArrow(run, "anchor long, n long"), "anchor-counts")
    total = counts.filter("anchor is null").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_HOT, total // MOST_HOT)
    hot = counts.filter("anchor is not null").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
    return np.sort(hot["anchor"].to_numpy(np.int64).view(np.uint64))


def _judge(table: pa.Table) -> pa.Table:
    """Contexts of one bucket: ranges that repeat wholly, and one context of each other kind to be sorted."""
    rows = np.frombuffer(b"".join(table.column("packed").to_pylist()), dtype=ROW)
    names = ("anchor", "context", "twin")
    rows, weight = _by_weight(rows, names)
    whole = rows[weight > 1]
    one = np.ones(len(rows), dtype=bool)
    one[1:] = np.logical_or.reduce([rows[n][1:] != rows[n][:-1] for n in names])
    kinds = rows[one]
    group = np.cumsum(np.concatenate([[True], kinds["anchor"][1:] != kinds["anchor"][:-1]])) if len(kinds) else np.zeros(0, int)
    asked = kinds[np.bincount(group)[group] > 1] if len(kinds) else kinds
    n = len(whole)
    return pa.table({
        "key": pa.array(np.concatenate([whole["key"], asked["key"]])), "lo": pa.array(np.concatenate([whole["lo"], asked["lo"]]).astype(np.int64)), "span": pa.array(np.concatenate([whole["span"], asked["span"]]).astype(np.int64)),
        "anchor": pa.array([*[None] * n, *asked["anchor"].view(np.int64).tolist()], pa.int64()),
    })


def _count_strings(table: pa.Table) -> pa.Table:
    """Starts of hot anchors in one bucket of string hashes: ranges of those that occur again."""
    rows, weight = _by_weight(np.frombuffer(b"".join(table.column("packed").to_pylist()), dtype=START), ("string", "twin"))
    rows = rows[weight > 1]
    key, lo, span = _ranges(rows["key"], rows["lo"])
    return pa.table({"key": pa.array(key, pa.int64()), "lo": pa.array(lo, pa.int64()), "span": pa.array(span, pa.int64())})


def _sort_contexts(table: pa.Table) -> pa.Table:
    """Ranges of starts in one bucket's contexts that repeat, by suffix sorting, some anchors at a time."""
    facts = np.column_stack([table.column(c).to_numpy() for c in ("anchor", "key", "lo", "span")])
    # The same context may have come more than once (copies of a text): it counts once.  In order of anchors.
    _, one = np.unique(facts, axis=0, return_index=True)
    anchor, key, lo, span = facts[one].T
    texts = table.column("text")
    edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])) if len(anchor) else np.zeros(1, int)
    size = np.concatenate([[0], np.cumsum(span + LENGTH)])[edges]
    found, at = [], 0
    while at < len(edges) - 1:
        # Whole anchors: what repeats has one anchor, so nothing is lost between slices.
        end = max(at + 1, int(np.searchsorted(size, size[at] + SORTED_BYTES, "right")) - 1)
        own = slice(int(edges[at]), int(edges[end]))
        found.append(_sorted_slice([texts[int(k)].as_py() for k in one[own]], key[own], lo[own], span[own]))
        at = end
    k, start, length = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table({"key": pa.array(k, pa.int64()), "lo": pa.array(start, pa.int64()), "span": pa.array(length, pa.int64())})


def _sorted_slice(pieces: list[bytes], key: np.ndarray, lo: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), span + 1)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
    again = np.sort(SuffixSorter(b"".join(pieces)).repeated(at[owner] + inside))
    own = np.searchsorted(at, again, "right") - 1
    return _ranges(key[own], lo[own] + again - at[own])


def repeated_starts(rows: DataFrame) -> DataFrame:
    """(key, lo, span): ranges of starts whose string starts elsewhere too, for rows (key, data) with equal keys for equal texts."""
    spark = rows.sparkSession
    long_rows = rows.filter(F.octet_length("data") >= LENGTH)
    # A run of about WINDOW / 2 starts is one packed row.
    size = long_rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(8, partitions(spark), 2 * ROW.itemsize * size // WINDOW // BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(_hot_anchors(long_rows))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(shared.value, buckets)
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(key, data.as_py())
                if chunk.size >= ROWS_AT_ONCE:
                    yield chunk.flush()
        yield chunk.flush()

    first = materialize(long_rows.select("key", "data").mapInArrow(collect, "key long, lo long, span long, kind int, bucket int, packed binary"), "anchors")
    judged = materialize(first.filter("kind = 0").select("bucket", "packed").groupBy("bucket").applyInArrow(_judge, "key long, lo long, span long, anchor long"), "contexts")
    strings = first.filter("kind = 1").select("bucket", "packed").groupBy("bucket").applyInArrow(_count_strings, "key long, lo long, span long")
    to_sort = judged.filter("anchor is not null")
    bytes_asked = to_sort.agg(F.sum(F.col("span") + LENGTH)).first()[0] or 0
    tasks = max(8, partitions(spark), -(-bytes_asked // TASK_BYTES))
    asked = materialize(to_sort.groupBy("key").agg(F.collect_list(F.struct("lo", "span", "anchor")).alias("asked")), "asked")
    # One text of each key, found by its least row id: copies carry no text of their own.
    texts = asked.join(rows.groupBy("key").agg(F.min("row_id").alias("row_id")), "key")
    texts = materialize(texts, "asked-texts").join(rows.select("row_id", "data", F.col("key").alias("own")), "row_id").filter("key = own")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, asked_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = data.as_py()
                anchors = np.array([a["anchor"] for a in asked_], dtype=np.int64)
                bucket = (_mix(anchors.view(np.uint64)) % np.uint64(tasks)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(anchors), pa.array([key] * len(asked_), pa.int64()), pa.array([a["lo"] for a in asked_], pa.int64()), pa.array([a["span"] for a in asked_], pa.int64()), pa.array([raw[a["lo"] : a["lo"] + a["span"] + LENGTH] for a in asked_], pa.binary())],
                    names=["bucket", "anchor", "key", "lo", "span", "text"],
                )

    contexts = texts.select("key", "asked", "data").mapInArrow(cut, "bucket int, anchor long, key long, lo long, span long, text binary")
    sorted_ = contexts.groupBy("bucket").applyInArrow(_sort_contexts, "key long, lo long, span long")
    known = first.filter("kind is null").select("key", "lo", "span").union(judged.filter("anchor is null").select("key", "lo", "span"))
    return known.union(strings).union(sorted_)


def removed_ranges(starts: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the strings at these starts cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["lo"] + s["span"] + LENGTH) for s in starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, min(hi, size)) for lo, hi in out]


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and spans of every row."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), data.alias("data")).withColumns({"key": F.xxhash64("data", F.octet_length("data")), "row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))})
    found = materialize(repeated_starts(rows).groupBy("key").agg(F.collect_set(F.struct("lo", "span")).alias("starts")), "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for data_, starts in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = data_.as_py()
                own = removed_ranges(starts or [], len(raw))
                edges = [0, *[e for r in own for e in r], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in own])
            size = pa.array([len(d.as_py()) for d in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "spans"])

    kind = dict(rows.dtypes)["doc_id"]
    joined = rows.select("key", "doc_id", "data").join(found, "key", "left").select("doc_id", "data", "starts")
    out = joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept", "spans")


def digest_of(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
