"""Convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its
first 4, 5, 6 and 7 letters.  Filters of widths 1, 2 and 3 run over the whole
text; each keeps its largest response, and a linear layer on these gives the
logit.  Because every filter is linear before its maximum, a word's share in
all filters is computed once per word and then only looked up and added.

Thresholds are calibrated by language: a small word model guesses the language
from the text, each language has the threshold with the best F1, and logits are
shifted so that every threshold lies at score 0.7.  The word model counts the
words of every text with a language; thresholds come from the logits of every
labelled text, told apart to 1 / ``STEPS``, where those that the filters were
not trained on stand for all of their class.  Both are grouped counts.

The gradient steps of embeddings and filters see a bounded draw of labelled
rows (``per_class`` of each class, by hash), of which hashed word ids reach the
driver.  Defined results: null
and empty texts have no words and get the score of an empty text; rows without
label or text are not learned from; with one class only, the score is 0 or 1;
repeated rows get equal scores; an empty table gives an empty one, and columns
named as the new ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .langid import draw

BUCKETS = 1 << 15
PARTS = 5
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 12
CUT = 0.7
CACHE_WORDS = 200_000
WORDS_AT_ONCE = 1 << 15
REACH = max(WIDTHS) - 1
#: Stands between texts; words hold no blanks.
BLANK = " "
LEAST_RESPONSE = -1e6
#: Logits are counted in steps of 1 / STEPS, from -FURTHEST to FURTHEST.
STEPS = 256
FURTHEST = 60
AT_CUT = float(np.log(CUT / (1 - CUT)))
_JUNK = re.compile(r"[\W_]+")


def word_parts(word: str) -> tuple[int, ...]:
    """Hash buckets of the word and of its first 4, 5, 6 and 7 letters (all of a shorter word)."""
    word = _JUNK.sub("", word)
    return tuple(zlib.crc32(p.encode("utf-8")) % BUCKETS for p in (word, "4" + word[:4], "5" + word[:5], "6" + word[:6], "7" + word[:7]))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


@dataclass
class ToxicityModel:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray  # FILTERS for each width
    out: np.ndarray
    out_bias: float
    languages: list[str]
    word_language: np.ndarray  # BUCKETS x languages, log shares
    shift: np.ndarray  # logit shift of each language, the last for texts without words
    constant: float | None = None
    trained_on: list[int] | None = None  # places of the documents that the filters were trained on

    def __post_init__(self):
        self._row: dict[str, int] = {}
        self._table: list[np.ndarray] = []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _shares(self, parts: np.ndarray) -> np.ndarray:
        """What each word adds to the filters at each offset, and to the languages."""
        e = self.embedding[parts].sum(axis=1)
        return np.hstack([*[e @ f[j] for f in self.filters for j in range(len(f))], self.word_language[parts[:, 0]]]).astype(np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self._row) > CACHE_WORDS:
            self._row.clear()
            self._table = []
        fresh = list({w for w in words if w not in self._row})
        if fresh or not self._table:
            made = self._shares(np.array([word_parts(w) for w in fresh] or np.zeros((0, PARTS)), dtype=np.int64).reshape(-1, PARTS))
            blank = [k for k, w in enumerate(fresh) if w is BLANK]
            made[blank], made[blank, : made.shape[1] - len(self.languages)] = 0, 4 * LEAST_RESPONSE
            start = len(self._row)
            self._row.update((w, start + k) for k, w in enumerate(fresh))
            if not self._table:
                self._table = [np.zeros((2 * CACHE_WORDS, made.shape[1]), dtype=np.float32)]
            if start + len(made) > len(self._table[0]):
                self._table[0] = np.vstack([self._table[0], np.zeros((start + len(made), made.shape[1]), dtype=np.float32)])
            self._table[0][start : start + len(made)] = made
        return np.fromiter(map(self._row.__getitem__, words), dtype=np.int64, count=len(words))

    def _pooled(self, words: list[str], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in each of some texts, and the sums of their language shares.

        ``words`` holds the texts one after another, each followed by blanks
        that no filter likes, so that no window reaches from one into the next.
        """
        rows = self._rows(words)
        x = self._table[0][rows]
        top = np.empty((len(start), FILTERS * len(WIDTHS)), dtype=np.float32)
        at = 0
        for k, width in enumerate(WIDTHS):
            r = x[: len(x) - width + 1, at : at + FILTERS]
            for j in range(1, width):
                r = r + x[j : len(x) - width + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            top[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(r, start, axis=0)
            at += width * FILTERS
        return top, np.add.reduceat(x[:, at:], start, axis=0).astype(np.float64) if self.languages else np.zeros((len(start), 0))

    def scores(self, texts: list[str | None]) -> list[tuple[float, str | None]]:
        """(score, guessed language) of each text."""
        if self.constant is not None:
            return [(self.constant, None)] * len(texts)
        logit, best = self.logits(texts)
        z = np.clip(logit + self.shift[best], -500, 500)
        return [(p, self.languages[b] if b >= 0 else None) for p, b in zip((1 / (1 + np.exp(-z))).tolist(), best.tolist(), strict=True)]

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logit without shift and place of the guessed language (-1: none) of each text; many texts are pooled together, long ones in blocks."""
        size = FILTERS * len(WIDTHS)
        top, tongue = np.full((len(texts), size), -np.inf, np.float32), np.zeros((len(texts), len(self.languages)))
        some = np.zeros(len(texts), dtype=bool)
        held: list[str] = []
        owner: list[int] = []
        start: list[int] = []

        def flush() -> None:
            found, shares = self._pooled(held, np.array(start))
            for k, t, s in zip(owner, found, shares, strict=True):
                top[k] = np.maximum(top[k], t)
                tongue[k] += s
            held.clear(), owner.clear(), start.clear()

        for k, text in enumerate(texts):
            words = words_of(text)
            some[k] = bool(words)
            for at in range(0, len(words), WORDS_AT_ONCE):
                # A block repeats the last words of the one before, whose windows end at its start; languages count them once.
                part = words[max(0, at - REACH) : at + WORDS_AT_ONCE]
                start.append(len(held))
                owner.append(k)
                held += part + [BLANK] * REACH
                if at:
                    tongue[k] -= self._table_of(part[:REACH])
                if len(held) >= WORDS_AT_ONCE:
                    flush()
        if held:
            flush()
        best = np.where(some, tongue.argmax(axis=1), -1) if self.languages else np.full(len(texts), -1)
        # Without words nothing is pooled: the bias of the last layer alone.
        hidden = np.maximum(np.where(top > LEAST_RESPONSE, top + self.bias, 0), 0)
        return (hidden @ self.out + self.out_bias).astype(np.float64), best

    def _table_of(self, words: list[str]) -> np.ndarray:
        rows = self._rows(words)
        return self._table[0][rows][:, -len(self.languages) :].sum(axis=0) if self.languages else np.zeros(0)

    def score(self, text: str | None) -> tuple[float, str | None]:
        return self.scores([text])[0]


def _forward(docs: list[np.ndarray], e: np.ndarray, filters, bias):
    """Hidden layer of a few documents, with the winning positions and the words' embeddings."""
    hidden, where, embedded = [], [], []
    for parts in docs:
        x = e[parts].sum(axis=1)
        embedded.append(x)
        tops, spots = [], []
        for k, f in enumerate(filters):
            n = len(x) - len(f) + 1
            if n > 0:
                r = sum(x[j : j + n] @ f[j] for j in range(len(f)))
                spot = r.argmax(axis=0)
                tops.append(r[spot, np.arange(FILTERS)] + bias[k * FILTERS : (k + 1) * FILTERS])
                spots.append(spot)
            else:
                tops.append(np.zeros(FILTERS, np.float32))
                spots.append(np.full(FILTERS, -1))
        hidden.append(np.concatenate(tops))
        where.append(np.concatenate(spots))
    return np.array(hidden), np.array(where), embedded


def train(docs: list[np.ndarray], y: np.ndarray, tongues: list[str | None], epochs: int = 6, batch: int = 32, rate: float = 0.02, seed: int = 0) -> ToxicityModel:
    """Fit on documents given as word-part buckets (words x PARTS) with labels 0/1 and language names."""
    rng = np.random.default_rng(seed)
    names = sorted({t for t in tongues if t})
    e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, out, out_bias = np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0.5, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0
    model = ToxicityModel(e, filters, bias, out, out_bias, names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names) + 1))
    if not len(y) or y.min() == y.max():
        model.constant = float(y[0]) if len(y) else 0.0
        return model
    used = [k for k, d in enumerate(docs) if len(d)]
    order = rng.permutation(used)
    kept_for_thresholds = set(order[: len(order) // 5].tolist())
    fitted = [k for k in used if k not in kept_for_thresholds]
    model.trained_on = fitted

    # Start: one dimension holds the log odds of a bucket's presence in either class.
    seen = np.ones((2, BUCKETS))
    for k in fitted:
        seen[int(y[k]), np.unique(docs[k])] += 1
    share = seen / (np.bincount(y[fitted].astype(int), minlength=2)[:, None] + 2)
    e[:, 0] = np.clip(np.log(share[1] / share[0]), -2, 4) * 0.25
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5

    spread = np.full(BUCKETS, 1e-6, np.float32)
    dense = [*filters, bias, out]
    m, v, step = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], 0
    weight = np.where(y == 1, 0.5 / max(1e-9, y[fitted].mean()), 0.5 / max(1e-9, 1 - y[fitted].mean()))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fitted), max(1, len(fitted) // batch)):
            raw, where, embedded = _forward([docs[k] for k in part], e, filters, bias)
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + out_bias, -30, 30)))
            d = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
            back = d[:, None] * out[None] * (raw > 0) * (where >= 0)
            grads = [np.zeros_like(f) for f in filters]
            touched, pulls = [], []
            for i, k in enumerate(part):
                for g, f in enumerate(filters):
                    cut = slice(g * FILTERS, (g + 1) * FILTERS)
                    delta, spots = back[i, cut], where[i, cut]
                    if not delta.any():
                        continue
                    for j in range(len(f)):
                        at = np.maximum(spots, 0) + j
                        at = np.minimum(at, len(embedded[i]) - 1)
                        grads[g][j] += embedded[i][at].T * delta[None]
                        touched.append(docs[k][at])
                        pulls.append((f[j] * delta[None]).T)
            step += 1
            for k, (value, grad) in enumerate(zip(dense, [*grads, back.sum(axis=0), hidden.T @ d + 1e-4 * out], strict=True)):
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                value -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
            out_bias -= 5 * rate * float(d.sum())
            if touched:
                at, pull = np.concatenate(touched), np.concatenate(pulls)
                size = (pull * pull).mean(axis=1)
                np.add.at(spread, at.ravel(), np.repeat(size, PARTS))
                np.add.at(e, at.ravel(), np.repeat(-rate * pull, PARTS, axis=0) / np.sqrt(spread[at.ravel()])[:, None])
    model.out_bias = float(out_bias)

    counts = np.full((BUCKETS, len(names)), 0.5)
    for k, t in enumerate(tongues):
        if t:
            np.add.at(counts[:, names.index(t)], docs[k][:, 0], 1)
    model.word_language = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    _calibrate(model, docs, y, sorted(kept_for_thresholds), fitted)
    return model


def _calibrate(model: ToxicityModel, docs, y, aside: list[int], fitted: list[int]) -> None:
    """The threshold of best F1 of each guessed language (midway between neighbours) becomes score CUT."""
    def judged(ks):
        raw, _, _ = _forward([docs[k] for k in ks], model.embedding, model.filters, model.bias)
        z = np.maximum(raw, 0) @ model.out + model.out_bias
        tongue = np.array([model.word_language[docs[k][:, 0]].sum(axis=0).argmax() if model.languages else -1 for k in ks])
        return z, tongue, y[ks]

    z, tongue, label = judged(aside) if aside else judged(fitted)
    both, both_tongue, both_label = (np.concatenate(p) for p in zip((z, tongue, label), judged(fitted), strict=True))
    base = _best_threshold(z, label) if label.min() != label.max() else _best_threshold(both, both_label)
    for k in range(len(model.languages)):
        mine, of = tongue == k, label[tongue == k]
        t = base
        if of.sum() >= 8 and len(of) - of.sum() >= 8:
            t = _best_threshold(z[mine], of)
        elif both_label[both_tongue == k].sum() >= 8:
            t = _best_threshold(both[both_tongue == k], both_label[both_tongue == k])
        model.shift[k] = AT_CUT - t
    model.shift[-1] = AT_CUT - max(base, model.out_bias + 1)


def _best_threshold(z: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(-z, kind="stable")
    zs, ls = z[order], label[order]
    hits = np.cumsum(ls)
    f1 = 2 * hits / (np.arange(1, len(ls) + 1) + max(1, ls.sum()))
    f1[:-1][zs[:-1] == zs[1:]] = -1
    k = int(f1.argmax())
    return float((zs[k] + zs[k + 1]) / 2) if k + 1 < len(zs) else float(zs[k]) - 1.0


def _marks(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(k, y) of each labelled document; of several labels the largest counts."""
    return labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", lang: str | None = "lang", per_class: int = 1000) -> tuple[ToxicityModel, DataFrame]:
    """A model whose thresholds are those of the drawn rows, and (k, trained) with the keys that its filters were trained on.

    The drawn labels (at most about 2.4 ``per_class`` rows) are broadcast to
    find their texts.
    """
    marks = _marks(labels, key, label)
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = F.broadcast(draw(marks, "y", counts, per_class, ["k"]))
    rows = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t is not null").join(drawn, "k").select("y", "__gw_draw", "k", "t")
    kind = rows.schema["k"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array([word_parts(w) for w in words_of(t)], dtype="<u2").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], names=["y", "d", "k", "p"])

    got = rows.mapInArrow(extract, f"y int, d double, k {kind}, p binary").toPandas().sort_values(["y", "d", "p"]).groupby("y").head(per_class)
    docs = [np.frombuffer(p, dtype="<u2").reshape(-1, PARTS).astype(np.int64) for p in got["p"]]
    model = train(docs, got["y"].to_numpy(), [None] * len(docs))
    keys = got["k"].tolist()
    trained = documents.sparkSession.createDataFrame([(keys[i], True) for i in sorted({keys[i]: i for i in model.trained_on or []}.values())], T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("trained", T.BooleanType())]))
    if lang and model.constant is None:
        _learn_languages(model, documents.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")))
    model.trained_on = None
    return model, trained


def _learn_languages(model: ToxicityModel, documents: DataFrame) -> None:
    """The word model of the languages, from all words of all rows (t, l)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for t, tongue in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.setdefault(tongue, Counter()).update(words_of(t))
            for tongue, words in seen.items():
                n = np.zeros(BUCKETS, np.int64)
                spots = [zlib.crc32(_JUNK.sub("", w).encode("utf-8")) % BUCKETS for w in words]
                np.add.at(n, np.array(spots, dtype=np.int64), np.fromiter(words.values(), np.int64, len(words)))
                at = n.nonzero()[0]
                yield pa.RecordBatch.from_arrays([pa.array([tongue] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["l", "b", "n"])

    counted = documents.filter("t is not null and l is not null and l <> ''").mapInArrow(tally, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    model.languages = sorted(set(counted["l"]))
    counts = np.full((BUCKETS, len(model.languages)), 0.5)
    counts[counted["b"].to_numpy(np.int64), np.searchsorted(model.languages, counted["l"].to_numpy(str)) if len(counted) else []] += counted["n"].to_numpy(np.float64)
    model.word_language = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    model.shift = np.full(len(model.languages) + 1, model.shift[-1])
    model.__post_init__()


def calibrate(model: ToxicityModel, judged: DataFrame, labels: DataFrame, trained: DataFrame, key: str = "doc_id", label: str = "toxic") -> None:
    """Set the thresholds from ``judged`` (key, logit, tongue: all texts with their logits): what reaches the driver is a count for each step of the logits.

    Rows that the filters were trained on have logits that are too good, so the
    others of their class and language stand for them; only where these are too
    few all are taken as they are.
    """
    if model.constant is not None:
        return
    rows = judged.select(F.col(f"`{key}`").alias("k"), "logit", "tongue").filter("tongue >= 0" if model.languages else "true").join(_marks(labels, key, label), "k").join(F.broadcast(trained), "k", "left")
    step = F.floor(F.greatest(F.least("logit", F.lit(float(FURTHEST))), F.lit(float(-FURTHEST))) * STEPS).cast("int")
    found = rows.groupBy("tongue", step.alias("step"), "y", F.col("trained").isNotNull().alias("trained")).agg(F.count("*").alias("n")).toPandas()
    n = np.zeros((len(model.languages) + 1, 2, 2, 2 * FURTHEST * STEPS + 1))
    np.add.at(n, tuple(found[c].to_numpy(np.int64) for c in ("tongue", "y", "trained")) + (found["step"].to_numpy(np.int64) + FURTHEST * STEPS,), found["n"].to_numpy(np.float64))

    def threshold(mine: np.ndarray, least: int) -> float | None:
        """``mine``: label x trained x step."""
        every, aside = mine.sum(axis=(1, 2)), mine[:, 0].sum(axis=1)
        if aside.min() >= least:
            return _best_step(mine[:, 0] * (every / aside)[:, None])
        return _best_step(mine.sum(axis=1)) if every[1] >= least else None

    base = threshold(n.sum(axis=0), 1)
    if base is None:
        return
    for k in range(len(model.languages)):
        t = threshold(n[k], 8)
        model.shift[k] = AT_CUT - (base if t is None else t)
    model.shift[-1] = AT_CUT - (max(base, model.out_bias + 1) if model.languages else base)


def _best_step(counts: np.ndarray) -> float:
    """The logit with the best F1, midway between the steps that it parts; ``counts``: label x step."""
    at = counts.sum(axis=0).nonzero()[0][::-1]
    hits, seen = np.cumsum(counts[1, at]), np.cumsum(counts[:, at].sum(axis=0))
    k = int((2 * hits / (seen + max(1, hits[-1]))).argmax())
    low = at[k] / STEPS - FURTHEST
    return float((low + (at[k + 1] + 1) / STEPS - FURTHEST) / 2) if k + 1 < len(at) else float(low) - 1.0


def logits(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df``, the logit of each text without shift and the place of its guessed language (-1: none)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = keep or []
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__gw_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            z, tongue = shared.value.logits(texts) if shared.value.constant is None else (np.zeros(len(texts)), np.full(len(texts), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(z, pa.float64()), pa.array(tongue, pa.int32())], names=[*kept, "logit", "tongue"])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in kept] + [T.StructField("logit", T.DoubleType()), T.StructField("tongue", T.IntegerType())]))


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", lang: str | None = "lang", per_class: int = 1000) -> ToxicityModel:
    """Learn from the labelled rows of ``documents``; gradient steps see at most ``per_class`` rows of each class, thresholds all rows."""
    model, trained = learn(documents, labels, text, key, label, lang, per_class)
    calibrate(model, logits(documents.filter(F.col(f"`{text}`").isNotNull()), model, text, [key]), labels, trained, key, label)
    return model


def classify(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` plus score, predicted (score >= 0.7) and text_language, the guess that chose the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("text_language", T.StringType())]
    kept = [c for c in df.columns if c.lower() not in {f.name for f in new}]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__gw_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores(batch.column(len(kept)).to_pylist())
            made = [pa.array([f[0] for f in found], pa.float64()), pa.array([int(f[0] >= CUT) for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *[f.name for f in new]])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in kept] + new))


def fit_and_classify(df: DataFrame, known: Column, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", lang: str | None = "lang", per_class: int = 1000) -> DataFrame:
    """``fit`` on the rows where ``known`` holds, then key, ``known``, score and predicted of all rows: each text is judged once for both."""
    rows = df.withColumn("__gw_known", known)
    model, trained = learn(rows.filter("__gw_known"), labels, text, key, label, lang, per_class)
    judged = materialize(logits(rows, model, text, [key, "__gw_known"]), "toxicity")
    calibrate(model, judged.filter("__gw_known"), labels, trained, key, label)
    shift = F.element_at(F.array(*[F.lit(float(x)) for x in model.shift]), F.when(F.col("tongue") < 0, -1).otherwise(F.col("tongue") + 1))
    score = F.lit(model.constant) if model.constant is not None else 1 / (1 + F.exp(-F.greatest(F.least(F.col("logit") + shift, F.lit(500.0)), F.lit(-500.0))))
    return judged.select(key, F.col("__gw_known").alias("known"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
