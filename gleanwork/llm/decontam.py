"""Benchmark decontamination by embedded edit distance.

Items and documents are rows of words (lower case, letters and digits only; in
scripts written without blanks every character is a word).  A document holds an
item if some stretch of it is within ``floor(0.25 n)`` word edits of the item's
n words.

1. The q-gram lemma bounds where that can be: a stretch within k edits keeps
   at least ``(n - q + 1) - k q`` of the item's word q-grams near one diagonal.
2. Windows of the item's size around such diagonals, and the items, go through
   CGK random walks, which map edit distance to Hamming distance; repeated
   bit sampling of the embeddings makes LSH keys, ``KEYS_A_WALK`` of each walk.
   Whether a walk's pointer moves on is a hash of walk, step and word, so no
   table grows with the vocabulary.  For items of each size class walks are
   added until stretches with as many edits as allowed share a key at the
   target rate, over ``TRIALS`` simulated edits however few the items are; an
   index that cannot reach it is an error.  Items of every length have keys, one
   word too; before its start and behind its end a text goes on with unknown
   words, so windows that an end cuts are no case of their own.
3. Windows that share a key with the item are verified by exact edit distance.
   Items of up to three words must be there exactly.

Items are dealt by hash into blocks of about ``BLOCK_WORDS`` words; Spark tasks
build each block's index and write it to the shared folder, a file for each.
Documents are read once: a task numbers the words of ``CHARS_AT_ONCE``
characters of texts and takes one block's index after another, back and forth,
so its memory depends on neither table and a single block is loaded once.

Defined results: null or empty texts hold nothing and null or empty items are
in no text; an item found several times in a document is one row, with its best
place (the first of equals); repeated rows of documents give repeated rows,
repeated items as well; an empty table on either side gives no match;
``contaminated`` keeps all columns and replaces one of that name.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BLOCK_WORDS = 200_000
CHARS_AT_ONCE = 16 << 20
CELLS_AT_ONCE = 1 << 21
LEAST_WORDS = 1
SAMPLED = 2
KEYS_A_WALK = 8
MOST_WALKS = 512
TRIALS = 4096
TRIAL_WORDS = 2_000_000
_MIX = np.array([0x9E3779B97F4A7C15 - (1 << 64), 0xBF58476D1CE4E5B9 - (1 << 64), 0x94D049BB133111EB - (1 << 64)], dtype=np.int64)
#: Chinese, Japanese, Thai, Lao, Burmese and Khmer letters and signs.
_NO_BLANKS = "\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u103f\u1050-\u108f\u1780-\u17d3"
_WORD = re.compile(rf"[{_NO_BLANKS}]|[^\W_{_NO_BLANKS}]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def most_edits(n: int) -> int:
    return n // 4


def size_class(n: int) -> int:
    """Items of one class share their number of walks: lengths within a factor of 2 ** 0.25."""
    return int(4 * np.log2(n))


def gram_size(n: int) -> tuple[int, int]:
    """(q, how many q-grams must stay) for items of n words: the largest q up to 3 with a useful bound."""
    k = most_edits(n)
    for q in (3, 2, 1):
        if (stay := n - q + 1 - k * q) >= 1:
            return q, stay
    raise ValueError(n)


def best_stretch(item: np.ndarray, zone: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``zone`` nearest to ``item``, by exact dynamic programming."""
    m = len(zone)
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    step = np.arange(m + 1)
    for k, word in enumerate(item, 1):
        change = np.concatenate([[k], cost[:-1] + (zone != word)])
        skip = cost + 1
        take = change <= skip
        take[0] = False
        low = np.where(take, change, skip)
        came = np.where(take, np.concatenate([[0], origin[:-1]]), origin)
        # Insertions run along the row: the least of low - position so far.
        best = np.minimum.accumulate(low - step)
        first = np.maximum.accumulate(np.where(low - step == best, step, 0))
        cost, origin = best + step, came[first]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


@dataclass
class ItemIndex:
    ids: list[int]
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    target: float = 0.995
    seed: int = 7
    walks: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.sizes = sorted({len(i) for i in self.items})
        self.mix = rng.integers(1, 1 << 62, size=3, dtype=np.int64) * 2 + 1
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in (1, 2, 3):
            rows = [(n, j) for n, i in enumerate(self.items) if gram_size(len(i))[0] == q for j in range(len(i) - q + 1)]
            if rows:
                keys = np.concatenate([self._gram_keys(i, q) for i in self.items if gram_size(len(i))[0] == q])
                order = np.argsort(keys, kind="stable")
                owner, offset = np.array(rows).T
                present = np.zeros(1 << 20, dtype=bool)
                present[keys.view(np.uint64) >> np.uint64(44)] = True
                self.grams[q] = keys[order], owner[order], offset[order], present
        by_class: dict[int, list[np.ndarray]] = {}
        for item in self.items:
            by_class.setdefault(size_class(len(item)), []).append(item)
        self.walks = {c: self._needed(items, rng) for c, items in sorted(by_class.items())}
        self.slots = np.zeros(len(self.items), np.int64)
        self.item_codes: dict[int, list[np.ndarray]] = {}
        for size in self.sizes:
            alike = [k for k, i in enumerate(self.items) if len(i) == size]
            self.slots[alike] = np.arange(len(alike))
            stacked = np.stack([self.items[k] for k in alike])
            self.item_codes[size] = [self.codes(stacked, walk) for walk in range(self.walks[size_class(size)])]

    def _gram_keys(self, words: np.ndarray, q: int) -> np.ndarray:
        n = len(words) - q + 1
        with np.errstate(over="ignore"):
            return reduce(np.add, (words[j : j + n] * self.mix[j] for j in range(q))) if n > 0 else np.zeros(0, np.int64)

    def codes(self, windows: np.ndarray, walk: int) -> np.ndarray:
        """LSH keys (windows x KEYS_A_WALK) of windows of one size: a CGK walk, then sampled symbols."""
        count, n = windows.shape
        padded = np.hstack([windows, np.full((count, 1), len(self.vocabulary) + 1, windows.dtype)])
        rows, out = np.arange(count), np.zeros((count, KEYS_A_WALK), np.int64)
        spots = np.sort(np.random.default_rng((self.seed, n, walk)).integers(0, 2 * n, size=(KEYS_A_WALK, SAMPLED)), axis=1)
        at = np.zeros(count, np.int64)
        for step in range(int(spots.max()) + 1):
            symbol = padded[rows, at]
            for k in np.nonzero(spots == step)[0]:
                out[:, k] = out[:, k] * 1_000_003 + symbol + 1
            at = np.minimum(at + _moves(symbol, walk, step), n)
        return out

    def _keyed(self, doc: np.ndarray, zones: list[tuple[int, int, int]]) -> np.ndarray:
        """Which zones (item, first and last start) have a window that shares a key with their item."""
        hit = np.zeros(len(zones), dtype=bool)
        items, lows, highs = np.array(zones, np.int64).reshape(-1, 3).T
        lengths = np.array([len(self.items[n]) for n in items], np.int64)
        for size in np.unique(lengths):
            beyond = np.zeros(size, doc.dtype)
            padded = np.concatenate([beyond, doc, beyond])
            every = np.flatnonzero(lengths == size)
            cells = np.cumsum((highs - lows + 1)[every] * size) // CELLS_AT_ONCE
            for first, last in _runs(cells):
                own = every[first:last]
                count = highs[own] - lows[own] + 1
                zone = np.repeat(own, count)
                starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lows[own], count)
                windows = padded[size + starts[:, None] + np.arange(size)]
                for walk, codes in enumerate(self.item_codes[int(size)]):
                    shared = (self.codes(windows, walk) == codes[self.slots[items[zone]]]).any(axis=1)
                    hit[zone[shared]] = True
                    # A zone that shares a key by now needs no further walk.
                    left = ~hit[zone]
                    zone, windows = zone[left], windows[left]
                    if not len(zone):
                        break
        return hit

    def _needed(self, items: list[np.ndarray], rng: np.random.Generator) -> int:
        """Walks after which simulated stretches with the most edits allowed share a key, at the target rate."""
        trials = max(256, min(TRIALS, TRIAL_WORDS // max(map(len, items))))
        each = max(1, trials // len(items))
        drawn = items[:: max(1, len(items) // trials)]
        changed = [np.stack([_edited(item, most_edits(len(item)), len(self.vocabulary), rng) for _ in range(each)]) for item in drawn]
        total, recall = sum(map(len, changed)), 0.0
        for walk in range(MOST_WALKS):
            # Copies that share a key by now need no further walk.
            changed = [c[~(self.codes(c, walk) == self.codes(i[None, :], walk)).any(axis=1)] if len(c) else c for c, i in zip(changed, drawn, strict=True)]
            recall = 1 - sum(map(len, changed)) / total
            if recall >= self.target:
                return walk + 1
        raise ValueError(f"items of {min(map(len, items))} to {max(map(len, items))} words reach a recall of {recall:.3f} only")

    def symbols(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def _diagonals(self, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first and last diagonal) where enough q-grams of the item lie close together."""
        for q, (keys, owner, offset, present) in self.grams.items():
            own = self._gram_keys(doc, q)
            where = np.flatnonzero(present[own.view(np.uint64) >> np.uint64(44)]) if len(own) else own
            if not len(where):
                continue
            left = np.searchsorted(keys, own[where], "left")
            count = np.searchsorted(keys, own[where], "right") - left
            at = np.repeat(where, count)
            entry = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item, diagonal = owner[entry], at - offset[entry]
            order = np.lexsort((diagonal, item))
            item, diagonal = item[order], diagonal[order]
            for first, last in _runs(item):
                k, (_, stay) = most_edits(len(self.items[item[first]])), gram_size(len(self.items[item[first]]))
                d = diagonal[first:last]
                # Grams kept through k edits lie on diagonals at most k apart.
                ahead = np.searchsorted(d, d + k, "right") - np.arange(len(d))
                good = np.flatnonzero(ahead >= stay)
                if len(good):
                    for a, b in _runs(np.cumsum(np.diff(d[good], prepend=d[good[0]]) > k)):
                        yield int(item[first]), int(d[good[a]]), int(d[good[b - 1]]) + k

    def find(self, words: list[str]) -> list[tuple[int, int, int, int, float]]:
        """(item id, start, end, edits, similarity) of each item that a document holds; places count words."""
        return self.find_numbered(self.symbols(words))

    def find_numbered(self, doc: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """As ``find``, of a document whose words are symbols of this index."""
        if not len(doc) or not self.items:
            return []
        zones = []
        for n, first, last in self._diagonals(doc):
            k = most_edits(len(self.items[n]))
            # All diagonals are below -k: less than n - k words of the item are in the text.
            if last >= 0:
                zones.append((n, max(first - k, 1 - len(self.items[n])), min(last + k, len(doc) - 1)))
        best: dict[int, tuple[int, int, int]] = {}
        for (n, low, high), keyed in zip(zones, self._keyed(doc, zones), strict=True):
            if not keyed or n in best and not best[n][0]:
                continue
            item = self.items[n]
            k = most_edits(len(item))
            low = max(0, low)
            edits, start, end = best_stretch(item, doc[low : high + len(item) + k])
            if edits <= k and (n not in best or edits < best[n][0]):
                best[n] = edits, low + start, low + end
        return [(self.ids[n], s, e, d, 1 - d / len(self.items[n])) for n, (d, s, e) in sorted(best.items())]


def _moves(symbol: np.ndarray, walk: int, step: int) -> np.ndarray:
    """The random bit of each word at a walk's step."""
    h = (symbol * _MIX[0] + np.int64((walk << 32) + step)) * _MIX[1]
    h = (h ^ (h >> 29)) * _MIX[2]
    return (h >> 61) & 1


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if not len(values):
        return
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True)


def _edited(item: np.ndarray, edits: int, vocabulary: int, rng: np.random.Generator) -> np.ndarray:
    """The item after random substitutions, deletions and insertions, cut or filled to its size."""
    words = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(words))))
        if kind == 0:
            words[at] = int(rng.integers(vocabulary + 1))
        elif kind == 1 and len(words) > 1:
            words.pop(at)
        else:
            words.insert(at, int(rng.integers(vocabulary + 1)))
    return np.array((words + rng.integers(0, vocabulary + 1, size=len(item)).tolist())[: len(item)], dtype=np.int64)


def build_index(items: list[tuple[int, str | None]]) -> ItemIndex:
    """Index of (id, text) items; symbol 0 stands for every word that no item has."""
    kept = [(i, w) for i, t in items if len(w := words_of(t)) >= LEAST_WORDS]
    vocabulary: dict[str, int] = {}
    for _, words in kept:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    return ItemIndex([i for i, _ in kept], [np.array([vocabulary[w] for w in words], np.int64) for _, words in kept], vocabulary)


MATCH_SCHEMA = "doc_id long, item_id long, word_start long, word_end long, edits long, similarity double"


def _index_files(items: DataFrame) -> list[str]:
    """Files with the blocks' indexes, built by tasks and written to the shared folder; ``items`` has (i, t)."""
    rows = items.filter("i is not null and t is not null")
    # Characters bound words from above; scripts without blanks have as many of both.
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (5 * BLOCK_WORDS)))

    def build(table: pa.Table) -> pa.Table:
        index = build_index(sorted(zip(table.column("i").to_pylist(), table.column("t").to_pylist(), strict=True)))
        return pa.table({"index": pa.array([pickle.dumps(index)], pa.large_binary())}).cast(pa.schema([("index", pa.binary())]))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    return sorted(materialize(dealt.groupBy("block").applyInArrow(build, "index binary"), "item-indexes", maxRecordsPerFile=1).inputFiles())


@lru_cache(maxsize=1)
def _loaded(path: str) -> ItemIndex | None:
    """A block's index; files of tasks without a block have none."""
    from pyarrow import parquet
    from pyarrow.fs import FileSystem

    fs, place = FileSystem.from_uri(path)
    blobs = parquet.read_table(place, filesystem=fs, columns=["index"]).column("index").to_pylist()
    return pickle.loads(blobs[0]) if blobs else None


def _numbered(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """(all words once, each text as their numbers)."""
    known: dict[str, int] = {}
    rows = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)) for words in map(words_of, texts)]
    return list(known), rows


def _groups(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches, or slices of large ones, together until they have ``CHARS_AT_ONCE`` bytes of text or one row."""
    group: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(text)], np.int64)
        at = np.cumsum(lengths) + size
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(at, CHARS_AT_ONCE, "right")), start + (not group))
            group.append(batch.slice(start, stop - start))
            if stop < batch.num_rows:
                yield group
                group, at = [], at - at[stop - 1] if stop else at
            start = stop
        size = int(at[-1]) if batch.num_rows else size
    if group:
        yield group


def _found(files: list[str], batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """Batches with what each of their texts holds; texts together meet one block after another, back and forth."""
    order = files
    for group in _groups(batches, text):
        known, rows = _numbered([t for b in group for t in b.column(text).to_pylist()])
        found: list[list[tuple]] = [[] for _ in rows]
        for path in order:
            if (index := _loaded(path)) is not None:
                symbols = index.symbols(known)
                for own, row in zip(found, rows, strict=True):
                    own += index.find_numbered(symbols[row])
        order = order[::-1]
        start = 0
        for batch in group:
            yield batch, found[start : start + batch.num_rows]
            start += batch.num_rows


def matches(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds, over whole texts."""
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    files = _index_files(benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in _found(files, batches, 1):
            found = [(d, *m) for d, own in zip(batch.column(0).to_pylist(), held, strict=True) for m in own]
            columns = list(zip(*found, strict=True)) or [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(columns)], names=[f.split()[0] for f in MATCH_SCHEMA.split(", ")])

    return rows.mapInArrow(run, MATCH_SCHEMA)


def contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` plus boolean ``contaminated``: the text holds some benchmark item.  No document is shuffled."""
    files = _index_files(benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")))
    kept = [c for c in documents.columns if c.lower() != "contaminated"]
    source = documents.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__gw_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in _found(files, batches, len(kept)):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([bool(own) for own in held], pa.bool_())], names=[*kept, "contaminated"])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in kept] + [T.StructField("contaminated", T.BooleanType())]))
