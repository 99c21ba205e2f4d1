"""Quality rules: fixed counts of a text, and boosted trees over its statistics.

Statistics are counted for many texts at once, from the bytes of a batch and
from the numbers of its words and lines; whole texts count.  The trees are
grown in numpy on histograms with the logistic loss.  Features named in
``MONOTONE`` may only lower (-1) the score as they grow: a split must order its
two values that way, and each side is bounded by the middle between them, so
no tree, and so no sum of trees, turns back.  All trees lie in flat arrays
(feature, threshold, left, right, value) in which a leaf leads to itself, so a
batch is scored by as many array lookups as a tree is deep.

Fitting uses a bounded sample of labelled rows (``per_class`` of each class,
drawn by hash); their statistics, not their texts, reach the driver.  A quarter
of them is kept from growing and sets the score below which a text is rejected:
the middle of the widest gap among the scores at which at most ``spare`` of the
good ones go.

Defined results: null and empty texts have no words, fail the base rule and
are not kept; rows without label or text are not learned from, and of several
labels of one document the smallest counts; with one class only, what passes
the base rule is kept; repeated rows get equal results; an empty table gives
an empty one; columns named as the new ones are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import draw

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "capitals", "digits", "loud_marks", "distinct_words", "ended_lines", "line_words")
#: Direction in which the score may move as the feature grows.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1, "loud_marks": -1}
WINDOW = 5
BYTES_AT_ONCE = 4 << 20

_SPACE, _SYMBOL, _UPPER, _LETTER, _DIGIT, _LOUD, _LEAD = range(7)
_CLASS = np.zeros((7, 256), dtype=np.uint8)
for _k, _chars in ((_SPACE, b" \t\n\x0b\x0c\r"), (_SYMBOL, b"#*$%&|<>"), (_UPPER, bytes(range(65, 91))), (_LETTER, bytes([*range(65, 91), *range(97, 123)])), (_DIGIT, b"0123456789"), (_LOUD, b"!?"), (_LEAD, bytes([*range(0x80), *range(0xC0, 256)]))):
    _CLASS[_k, list(_chars)] = 1


def _repeated(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks words in windows of WINDOW words that occur twice or more in their text."""
    marked = np.zeros(len(ids), dtype=bool)
    last = len(ids) - WINDOW + 1
    if last < 1:
        return marked

    def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pd.factorize(a * (int(b.max()) + 1) + b)[0]

    two = numbered(ids[:-1], ids[1:])
    five = numbered(numbered(two[: last + 1], two[2 : last + 3])[:last], ids[WINDOW - 1 :])
    inside = np.flatnonzero(text[:last] == text[WINDOW - 1 :])
    if not len(inside):
        return marked
    keys = numbered(five[inside], text[inside])
    twice = inside[np.bincount(keys)[keys] > 1]
    for k in range(WINDOW):
        marked[twice + k] = True
    return marked


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(COUNTS as integers, FEATURES as doubles), a row for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy()
    raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-8"), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)])

    def total(flags: np.ndarray) -> np.ndarray:
        """Sums of ``flags`` over the bytes of each text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[start[1:]] - sums[start[:-1]]

    of = {k: total(_CLASS[k][raw]) for k in (_SYMBOL, _UPPER, _LETTER, _DIGIT, _LOUD)}
    chars = total(_CLASS[_LEAD][raw] & (1 - _CLASS[_SPACE][raw]))

    def parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return lists.flatten(), pc.list_parent_indices(lists).to_numpy()

    words, of_word = parts(pc.ascii_split_whitespace(texts))
    real = pc.greater(pc.binary_length(words), 0)
    words, of_word = words.filter(real), of_word[real.to_numpy(zero_copy_only=False)]
    n_words = np.bincount(of_word, minlength=n)
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    del words
    repeats = np.bincount(of_word, weights=_repeated(ids, of_word), minlength=n).astype(np.int64)

    def distinct(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
        return np.bincount(pd.unique(codes * n + text) % n if len(codes) else codes, minlength=n)

    lines, of_line = parts(pc.split_pattern(texts, "\n"))
    said = pc.invert(pc.or_(pc.equal(pc.binary_length(lines), 0), pc.ascii_is_space(lines)))
    lines, of_line = lines.filter(said), of_line[said.to_numpy(zero_copy_only=False)]
    n_lines = np.bincount(of_line, minlength=n)
    dup = n_lines - distinct(lines.dictionary_encode().indices.to_numpy().astype(np.int64), of_line)
    ended = np.bincount(of_line, weights=pc.match_substring_regex(lines, r"[.!?][ \t\v\f\r]*$").to_numpy(zero_copy_only=False), minlength=n)

    counts = np.stack([n_words, chars, of[_SYMBOL], dup, repeats], axis=1)
    w, c, ln = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    features = [np.log1p(n_words), chars / w, of[_SYMBOL] / c, dup / ln, repeats / w, of[_UPPER] / np.maximum(of[_LETTER], 1), of[_DIGIT] / c, of[_LOUD] / w, distinct(ids, of_word) / w, ended / ln, n_words / ln]
    return counts, np.stack(features, axis=1)


def in_bounded_runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``statistics`` of consecutive slices of at most BYTES_AT_ONCE bytes, or of one text."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + BYTES_AT_ONCE, side="right")) - 1)
        yield statistics(texts.slice(at, end - at))
        at = end


@dataclass
class Trees:
    """Boosted trees as flat node arrays; ``root`` has the first node of each tree, ``depth`` is that of the deepest."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float
    cut: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row of ``x``."""
        node = np.repeat(self.root[None], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


class _Grower:
    """Grows one tree at a time on rows whose features are numbered by quantile bins."""

    def __init__(self, x: np.ndarray, bins: int, depth: int, ridge: float, least: float):
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
        # Row <= edge k  <=>  bin <= k
        self.binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(self.edges, x.T, strict=True)], axis=1)
        self.bins, self.depth, self.ridge, self.least = bins, depth, ridge, least
        self.nodes: list[list] = []
        self.way = np.array([MONOTONE.get(f, 0) for f in FEATURES[: x.shape[1]]])

    def _best(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        """(gain, feature, bin, value left, value right) of the best allowed split."""
        best = (1e-9, None, None, 0.0, 0.0)
        whole_g, whole_h = g[rows].sum(), h[rows].sum()

        def value(gs, hs):
            return np.clip(-gs / (hs + self.ridge), low, high)

        def worth(gs, hs, v):
            return -(gs * v + 0.5 * (hs + self.ridge) * v * v)

        before = worth(whole_g, whole_h, value(whole_g, whole_h))
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            b = self.binned[rows, f]
            gl = np.cumsum(np.bincount(b, weights=g[rows], minlength=len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, weights=h[rows], minlength=len(edges) + 1))[:-1]
            gr, hr = whole_g - gl, whole_h - hl
            vl, vr = value(gl, hl), value(gr, hr)
            gain = worth(gl, hl, vl) + worth(gr, hr, vr) - before
            gain[(hl < self.least) | (hr < self.least) | (self.way[f] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        return best

    def grow(self, g: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """Adds a tree for these gradients; returns what it adds to each row."""
        out = np.zeros(len(g))

        def leaf(rows, v):
            k = len(self.nodes)
            self.nodes.append([0, np.inf, k, k, rate * v])
            out[rows] = rate * v
            return k

        def node(rows, depth, low, high, v):
            _, f, k, vl, vr = self._best(rows, g, h, low, high) if depth else (0, None, None, 0, 0)
            if f is None:
                return leaf(rows, v)
            here = len(self.nodes)
            self.nodes.append([f, self.edges[f][k], 0, 0, 0.0])
            down = self.binned[rows, f] <= k
            middle, way = (vl + vr) / 2, self.way[f]
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(way)]
            self.nodes[here][2] = node(rows[down], depth - 1, *bounds[0], vl)
            self.nodes[here][3] = node(rows[~down], depth - 1, *bounds[1], vr)
            return here

        everyone = np.arange(len(g))
        node(everyone, self.depth, -np.inf, np.inf, float(-g.sum() / (h.sum() + self.ridge)))
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0, spare: float = 0.002) -> Trees:
    """Boosted trees for the probability of label 1; every fourth row only sets the cut."""
    if not len(y) or y.min() == y.max():
        empty = np.zeros(1)
        return Trees(np.zeros(1, dtype=int), empty, np.zeros(1, dtype=int), np.zeros(1, dtype=int), empty, np.zeros(1, dtype=int), 0, 0.0, 0.0)
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[~aside])) < 2 or not (y[aside] == 1).any():
        aside[:] = False
    grown, target = x[~aside], y[~aside]
    # Classes weigh alike, however the sample is made up.
    weight = np.where(target == 1, 0.5 / (target == 1).mean(), 0.5 / (target == 0).mean())
    grower = _Grower(grown, bins, depth, ridge, least)
    margin, root = np.zeros(len(target)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        root.append(len(grower.nodes))
        margin += grower.grow(weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6), rate)
    f, t, left, right, v = (np.array(c) for c in zip(*grower.nodes, strict=True))
    model = Trees(f.astype(int), t.astype(float), left.astype(int), right.astype(int), v.astype(float), np.array(root), depth, 0.0)
    model.cut = _cut(model.scores(x[aside] if aside.any() else x), y[aside] if aside.any() else y, spare)
    return model


def _cut(score: np.ndarray, y: np.ndarray, spare: float) -> float:
    """The middle of the widest gap between neighbouring scores, among cuts that lose at most ``spare`` of the good rows."""
    good = np.sort(score[y == 1])
    most = good[int(spare * len(good))]
    below = np.unique(np.append(score[score <= most], 0.0))
    gaps = np.diff(below)
    return float(below[gaps.argmax()] + gaps.max() / 2) if len(gaps) else 0.0


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = 4000) -> Trees:
    """Learn from the labelled rows of ``documents``; at most ``per_class`` rows of each class.

    The drawn labels (at most about 2.4 ``per_class`` rows) are broadcast to
    find their texts.
    """
    marks = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = F.broadcast(draw(marks, "y", counts, per_class, ["k"]))
    rows = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t is not null").join(drawn, "k").select("y", "__gw_draw", "t")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, x in in_bounded_runs(batch.column(2))]
            x = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in x.T)], names=["y", "d", *FEATURES])

    got = rows.mapInArrow(extract, ", ".join(["y int", "d double", *(f"{f} double" for f in FEATURES)])).toPandas()
    got = got.sort_values(["d", "y", *FEATURES]).groupby("y").head(per_class)
    return train(got[list(FEATURES)].to_numpy(dtype=float), got["y"].to_numpy())


def judge(df: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``df`` plus COUNTS, base_failed, score (probability of good quality) and kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    own = [c for c in df.columns if c.lower() not in {f.name for f in new}]
    source = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").alias("__gw_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for counts, x in in_bounded_runs(batch.column(len(own))):
                failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
                score = shared.value.scores(x)
                made = [*(pa.array(c, pa.int64()) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= shared.value.cut))]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(x)) for c in batch.columns[: len(own)]), *made], names=[*own, *(f.name for f in new)])
                at += len(x)

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in own] + new))
