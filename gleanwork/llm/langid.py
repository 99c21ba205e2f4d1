"""Language identification by error-correcting output codes.

Each language gets a codeword; each column of the code is one binary
classifier (logistic regression on hashed byte 1- to 3-grams of the whole
text).  A text takes the language whose codeword has the least loss, every
bit weighted by how well it was learned; texts whose two best codewords lie
close together are flagged ambiguous.

Fitting uses a bounded sample: at most ``per_language`` labelled rows of each
language, drawn by hash, whose feature counts (not texts) reach the driver.
Prediction reads whole texts in blocks and needs the text alone.

Defined results: null texts and texts without a letter are ``und`` with score
0; rows without a language are not learned from; with no labelled row at all
every text is ``und``.  Repeated rows get equal answers; an empty table gives
an empty one, and columns named as the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 13
BLOCK = 1 << 20
UNKNOWN = "und"
#: A letter by its Unicode category: number signs and digits in circles are none.
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, other ASCII as blanks; bytes of other letters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte 1-, 2- and 3-grams of the whole text, in blocks of bounded size."""
    raw = (" " + text + " ").encode("utf-8").translate(_FOLD)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, max(1, len(raw) - 2), BLOCK):
        b = np.frombuffer(raw, dtype=np.uint8, offset=start, count=min(BLOCK + 2, len(raw) - start)).astype(np.uint32)
        two = (b[:-1] << np.uint32(8)) | b[1:]
        three = (two[:-1] << np.uint32(8)) | b[2:]
        n = len(three)
        for gram in (b[:n] + np.uint32(7), two[:n] + np.uint32(1 << 25), three):
            hashed = (gram * np.uint32(0x9E3779B1)) >> np.uint32(19)
            total += np.bincount(hashed, minlength=BUCKETS)
    return total


def features(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def code_matrix(n: int, seed: int = 0) -> np.ndarray:
    """n codewords of +1/-1: every two-sided split for up to 6 languages, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.zeros(len(splits)), bits]).astype(np.float32) * 2 - 1
    rng, length, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, length))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        least = ((length - code @ code.T) / 2 + np.eye(n) * length).min()
        if least > apart:
            best, apart = code, least
    return best.astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    margin: float = 0.1
    bits_right: list[float] = field(default_factory=list)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, score from 0 to 1, ambiguous) of each text."""
        for start in range(0, len(texts), 128):
            part = texts[start : start + 128]
            known = [k for k, t in enumerate(part) if t and self.languages and _LETTER.search(t)]
            answers: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(part)
            if known:
                x = features(np.stack([ngram_counts(part[k]) for k in known]))
                margins = x @ self.weights + self.bias
                loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.bit_weight
                share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                top = share[np.arange(len(known)), best]
                second = np.partition(share, -2, axis=1)[:, -2] if len(self.languages) > 1 else np.zeros(len(known))
                for k, b, p, q in zip(known, best.tolist(), top.tolist(), second.tolist(), strict=True):
                    answers[k] = (self.languages[b], min(1.0, p), p - q < self.margin)
            yield from answers


def train(counts: np.ndarray, languages: list[str], steps: int = 300, rate: float = 0.2) -> LanguageModel:
    """Fit one logistic classifier for each code bit, all together, with Adam."""
    names = sorted(set(languages))
    code = code_matrix(len(names))
    if not names:
        return LanguageModel([], code, np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    y = np.array([names.index(v) for v in languages])
    x, target = features(counts), code[y]
    row = (1.0 / np.bincount(y, minlength=len(names)))[y][:, None] / len(names)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        pull = (-target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * row).astype(np.float32)
        for k, (value, grad) in enumerate(((w, x.T @ pull + 1e-5 * w), (b, pull.sum(axis=0)))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    right = ((x @ w + b) * target > 0).mean(axis=0)
    weight = np.clip(2 * right - 1, 0.05, 1)
    return LanguageModel(names, code, w, b, (weight / weight.sum() * len(weight)).astype(np.float32), bits_right=right.tolist())


def draw(df: DataFrame, label: str, counts: dict, bound: int, key: list[str]) -> DataFrame:
    """About 1.2 ``bound`` rows of each label at most, by a hash of ``key``; its value is column __gw_draw."""
    spot = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    share = reduce(lambda c, v: c.when(F.col(label) == v, F.lit(min(1.0, 1.2 * bound / counts[v]))), counts, F.when(F.lit(False), 0.0))
    return df.withColumn("__gw_draw", spot).filter(F.col("__gw_draw") < share)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 250) -> LanguageModel:
    """Learn from rows of ``labelled`` with text and language; at most ``per_language`` rows of each."""
    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"), F.col(f"`{key}`").alias("k")).filter("t is not null and l is not null and l <> 'und'")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(l, d, ngram_counts(t)) for l, d, t in zip(*(batch.column(c).to_pylist() for c in ("l", "__gw_draw", "t")), strict=True) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.float64()), pa.array([np.minimum(k[2], 65535).astype("<u2").tobytes() for k in kept], pa.binary())], names=["l", "d", "c"])

    drawn = draw(rows, "l", counts, per_language, ["k"]).select("l", "__gw_draw", "t").mapInArrow(extract, "l string, d double, c binary").toPandas()
    drawn = drawn.sort_values(["l", "d", "c"]).groupby("l").head(per_language)
    counted = np.stack([np.frombuffer(c, dtype="<u2") for c in drawn["c"]]) if len(drawn) else np.zeros((0, BUCKETS))
    return train(counted, drawn["l"].tolist())


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` plus lang_pred, score and ambiguous (columns of these names are replaced)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    kept = [c for c in df.columns if c.lower() not in {f.name for f in new}]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__gw_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.predict(batch.column(len(kept)).to_pylist()))
            made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *[f.name for f in new]])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in kept] + new))

