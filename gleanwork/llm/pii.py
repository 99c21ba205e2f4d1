"""Personal data: fixed patterns, plus a character BiLSTM with CRF transitions.

The base spans (email, ip, card, phone) come from fixed patterns and always
stay.  A small bidirectional LSTM over character classes with a linear-chain
CRF on top is trained in numpy from labelled spans: base matches in a bounded
sample of texts, and the same spans disguised as people write them ("name at
host dot org", 10[.]0[.]0[.]1, other separators, a missing plus), which the
patterns do not know.

Every character of every text is decoded: texts are cut into overlapping
windows and decoded by Viterbi, some windows at a time whatever a text's length.
Reconciling is global: each character takes its tag from the window in which it
lies furthest from an edge, and runs of one kind become spans over the document,
whatever windows they crossed.  Model spans that touch no base span, are sure
enough and have the shape and digits of their kind are added.

Defined results: null counts as empty, empty text has no spans; offsets are
code points, end exclusive; repeated rows get equal spans; of model spans that
overlap the first stays; without any base span in the sample there is no model
and nothing is added; an empty table gives an empty one; columns named as the
new ones are replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits can only begin a match at its first digit, hence the look-behind: no quadratic retries.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TRIGGER = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in reversed(digits)]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at-signs: the local part is the whole run before one."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind as listed, then start; matches that fail their check are dropped."""
    spans: list[Span] = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append(("phone", *m.span()))
    return spans


# -- the model -----------------------------------------------------------

WINDOW, STRIDE = 96, 72
EDGE = (WINDOW - STRIDE) // 2
WINDOWS_AT_ONCE = 2048
DISGUISES = 4
HIDDEN, DIM = 12, 8
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_SHOWN = "@.-+()_%/:,=\"#[]"
_CUES = "adot"
CLASSES = 8 + len(_SHOWN) + len(_CUES)


def _ascii_class(c: int) -> int:
    """Controls, digits, other lower case, upper case, blanks, line ends and rarer signs are classes; so is each shown sign and each letter of "at" and "dot"."""
    ch = chr(c)
    if ch in _SHOWN:
        return 8 + _SHOWN.index(ch)
    if ch.lower() in _CUES:
        return 8 + len(_SHOWN) + _CUES.index(ch.lower())
    if ch.isdigit():
        return 1
    if ch.isalpha():
        return 2 if ch.islower() else 3
    return 5 if c == 32 else 6 if ch in "\t\n\r" else 0 if c < 32 else 7


_ASCII = np.array([_ascii_class(c) for c in range(128)], dtype=np.uint8)


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], np.uint8(4))


def windows_of(size: int) -> range:
    """Starts of overlapping windows over a text; the last one reaches its end."""
    return range(0, max(1, size - WINDOW + STRIDE), STRIDE)


def owned(start: int, size: int) -> tuple[int, int]:
    """The characters that lie deeper in the window at ``start`` than in its neighbours."""
    return start + EDGE if start else 0, start + EDGE + STRIDE if start + WINDOW < size else size


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): a squashing function that costs a division; its slope is (1 - |soft|) squared."""
    return x / (1 + np.abs(x))


class Tagger:
    """Embedding, two LSTMs, linear emissions and CRF; parameters in a dict of float32 arrays, gates in the order input, forget, output, cell."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        p = {"emb": rng.normal(0, 0.5, (CLASSES, DIM)), "out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for side in ("f", "b"):
            p |= {f"wx{side}": rng.normal(0, 0.4, (4, DIM, HIDDEN)), f"wh{side}": rng.normal(0, 0.25, (4, HIDDEN, HIDDEN)), f"bias{side}": np.array([[0.0], [1.5], [0.0], [0.0]]) + np.zeros((4, HIDDEN))}
        # An inside tag only follows its own begin or inside.
        for k in range(len(KINDS)):
            allowed = {1 + 2 * k, 2 + 2 * k}
            p["trans"][[t for t in range(TAGS) if t not in allowed], 2 + 2 * k] = -1e4
            p["first"][2 + 2 * k] = -1e4
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _lstm(self, x: np.ndarray, side: str, scores: np.ndarray, trace: list | None = None) -> None:
        """Add one direction's share to the scores (length x windows x TAGS); ``trace`` gets what the gradients need."""
        # What a character adds to the gates depends on its class alone.
        table = (np.einsum("cd,kdh->kch", self.p["emb"], self.p["wx" + side]) + self.p["bias" + side][:, None]).astype(np.float32)
        length, n = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        z, part = np.empty((4, n, HIDDEN), np.float32), np.empty((4, n, HIDDEN), np.float32)
        out = self.p["out"][:HIDDEN] if side == "f" else self.p["out"][HIDDEN:]
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            np.take(table, x[t], axis=1, out=z, mode="clip")
            z += np.matmul(h, self.p["wh" + side], out=part)
            np.abs(z, out=part)
            part += 1
            z /= part
            z[:3] += 1
            z[:3] *= 0.5
            if trace is not None:
                trace.append((t, z.copy(), c.copy(), h.copy()))
            c *= z[1]
            c += np.multiply(z[0], z[3], out=part[0])
            np.abs(c, out=part[0])
            part[0] += 1
            h = c / part[0]
            if trace is not None:
                trace[-1] += (h, h * z[2])
            h = h * z[2]
            scores[t] += h @ out

    def emissions(self, x: np.ndarray, traces: tuple[list, list] | None = None) -> np.ndarray:
        """Scores (windows x length x TAGS, in memory length first); ``x`` is windows x length."""
        place = np.ascontiguousarray(x.T).astype(np.intp)
        scores = np.zeros((*place.shape, TAGS), np.float32) + self.p["out_b"]
        self._lstm(place, "f", scores, traces and traces[0])
        self._lstm(place, "b", scores, traces and traces[1])
        return scores.transpose(1, 0, 2)

    def _back(self, side: str, x: np.ndarray, trace: list, dh_all: np.ndarray, grads: dict) -> None:
        n = x.shape[1]
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        on_table = np.zeros((4, CLASSES, HIDDEN), np.float32)
        for t, z, before, prior, squashed, _ in reversed(trace):
            i, f, o, g = z
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - np.abs(squashed)) ** 2
            slope = 0.5 * (1 - np.abs(2 * z[:3] - 1)) ** 2
            dz = np.stack([dc * g * slope[0], dc * before * slope[1], dh * squashed * slope[2], dc * i * (1 - np.abs(g)) ** 2])
            grads["wh" + side] += prior.T @ dz
            for k in range(4):
                np.add.at(on_table[k], x[t], dz[k])
            dh, dc = np.matmul(dz, self.p["wh" + side].transpose(0, 2, 1)).sum(axis=0), dc * f
        grads["bias" + side] += on_table.sum(axis=1)
        grads["wx" + side] += np.einsum("cd,kch->kdh", self.p["emb"], on_table)
        grads["emb"] += np.einsum("kch,kdh->cd", on_table, self.p["wx" + side])

    def _forward_backward(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward scores, and the log partition."""
        n, length, _ = em.shape
        a, b = np.empty_like(em), np.zeros_like(em)
        a[:, 0] = em[:, 0] + self.p["first"]
        for t in range(1, length):
            a[:, t] = em[:, t] + _logsum(a[:, t - 1, :, None] + self.p["trans"][None], 1)
        for t in range(length - 2, -1, -1):
            b[:, t] = _logsum(self.p["trans"][None] + (em[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        return a, b, _logsum(a[:, -1], 1)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tags ``y`` and its gradients."""
        traces: tuple[list, list] = ([], [])
        em = self.emissions(x, traces)
        a, b, z = self._forward_backward(em)
        n, length, _ = em.shape
        rows = np.arange(n)
        d = np.exp(a + b - z[:, None, None])
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        score = em[rows, 0, y[:, 0]] + self.p["first"][y[:, 0]]
        for t in range(1, length):
            pair = np.exp(a[:, t - 1, :, None] + self.p["trans"][None] + (em[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            grads["trans"] += pair.sum(axis=0)
            np.add.at(grads["trans"], (y[:, t - 1], y[:, t]), -1)
            score = score + em[rows, t, y[:, t]] + self.p["trans"][y[:, t - 1], y[:, t]]
        d[rows[:, None], np.arange(length)[None], y] -= 1
        grads["first"] += d[:, 0].sum(axis=0)
        d = d.transpose(1, 0, 2)
        for k, trace in enumerate(traces):
            for t, *_, h in trace:
                grads["out"][k * HIDDEN : (k + 1) * HIDDEN] += h.T @ d[t]
        grads["out_b"] += d.sum(axis=(0, 1))
        dh = d @ self.p["out"].T
        place = np.ascontiguousarray(x.T).astype(np.intp)
        self._back("f", place, traces[0], dh[:, :, :HIDDEN], grads)
        self._back("b", place, traces[1], dh[:, :, HIDDEN:], grads)
        return float((z - score).mean()), {k: g / n for k, g in grads.items()}

    def _certainly_outside(self, em: np.ndarray) -> np.ndarray:
        """Windows whose best path is outside throughout.

        Whatever its kinds, a span gains over the outside path no more than
        the best begin, the best insides and the best transitions together; where
        no such span gains anything, none is on the best path.
        """
        trans, first = self.p["trans"], self.p["first"]
        still = trans[0, 0]
        each = em.transpose(1, 0, 2)
        begin = reduce(np.maximum, (each[:, :, k] for k in range(1, TAGS, 2))) - each[:, :, 0]
        inside = reduce(np.maximum, (each[:, :, k] for k in range(2, TAGS, 2))) - each[:, :, 0]
        enter, leave = trans[0, 1::2].max() - still, trans[1:, 0].max() - still
        follow, again = trans[1:, 2::2].max() - still, trans[1:, 1::2].max() - still
        held = begin[0] + (first[1::2].max() - first[0])
        top = held + leave
        for t in range(1, len(each)):
            held = np.maximum(begin[t] + np.maximum(enter, held + again), held + follow + inside[t])
            top = np.maximum(top, held + (leave if t + 1 < len(each) else 0))
        return top < 0

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of windows, and each tag's marginal probability (1 where a window is outside for certain)."""
        em = self.emissions(x)
        tags, sure = np.zeros(x.shape, np.uint8), np.ones(x.shape, np.float32)
        some = np.flatnonzero(~self._certainly_outside(em))
        if len(some):
            em = np.ascontiguousarray(em[some])
            best, came = em[:, 0] + self.p["first"], np.zeros(em.shape, np.int64)
            for t in range(1, em.shape[1]):
                options = best[:, :, None] + self.p["trans"][None]
                came[:, t] = options.argmax(axis=1)
                best = options.max(axis=1) + em[:, t]
            path = np.empty(em.shape[:2], np.int64)
            path[:, -1] = best.argmax(axis=1)
            for t in range(em.shape[1] - 1, 0, -1):
                path[:, t - 1] = came[np.arange(len(some)), t, path[:, t]]
            tags[some] = path
            marked = np.flatnonzero(path.any(axis=1))
            a, b, z = self._forward_backward(em[marked])
            sure[some[marked]] = np.take_along_axis(np.exp(a + b - z[:, None, None]), path[marked][:, :, None], axis=2)[:, :, 0]
        return tags, sure


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 48, rate: float = 0.02, seed: int = 0) -> Tagger:
    """Adam over shuffled batches, the rate falling to a tenth."""
    tagger, rng = Tagger(seed), np.random.default_rng(seed)
    per_epoch = max(1, len(x) // batch)
    epochs = -(-steps // per_epoch)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(w) for k, w in tagger.p.items()}
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), per_epoch):
            if not len(part):
                continue
            _, grads = tagger.step(x[part], y[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                tagger.p[k] -= rate * (1 - 0.9 * step / (epochs * per_epoch)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return tagger


# -- labelled spans ------------------------------------------------------


def disguised(kind: str, piece: str, rng: random.Random) -> str:
    """A span as people write it who avoid the plain form: spelt-out signs, other separators, a missing plus."""
    digits = "".join(_DIGITS.findall(piece))
    if kind == "email":
        name, _, domain = piece.partition("@")
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" @ ", "."), (" @ ", " . ")])
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return piece.replace(".", rng.choice(["[.]", "(.)", " . ", "[dot]"]))
    if kind == "card":
        return rng.choice([".", "/", "_", " - ", "  "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    bare = piece.lstrip("+").strip()
    sign = rng.choice([".", "-", " ", "/"])
    return rng.choice([f"00{bare}", f"00 {bare}", f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", sign.join([digits[:3], digits[3:6], digits[6:]]), f"0{digits[:3]}{sign}{digits[3:6]}{sign}{digits[6:]}"])


def harmless(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    n = rng.randrange
    return rng.choice([f"{1950 + n(90)}-{1 + n(12):02d}-{1 + n(28):02d} {n(24):02d}:{n(60):02d}:{n(60):02d}", f"{1 + n(28):02d}.{1 + n(12):02d}.{1950 + n(90)}", f"v{n(9)}.{n(30)}.{n(99)}", f"${n(999)},{n(999):03d}.{n(99):02d}", f"ISBN {n(9)}-{n(9999):04d}-{n(9999):04d}-{n(9)}", f"{n(10**12)}", f"@{rng.choice(['home', 'work', 'noon'])}", f"meet at {rng.choice(['noon', 'home'])} dot", f"pp. {n(300)}-{n(900)}", f"{n(99)} x {n(99)} x {n(99)}"])


def labelled_windows(text: str, seed: int = 0, most: int = 24) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(group, classes, tags) of windows of a text: 0 with its spans, 1 with its spans disguised (in ``DISGUISES`` ways), 2 without any; at most ``most`` of each."""
    rng = random.Random(seed)
    base = sorted({(s, e, kind) for kind, s, e in base_spans(text)})
    spans = [b for n, b in enumerate(base) if not n or b[0] >= base[n - 1][1]]
    # A plain span is seen at as many offsets as it has disguises.
    forms = [(0, text, spans)]
    for _ in range(DISGUISES if spans else 0):
        parts, marks, at, size = [], [], 0, 0
        for s, e, kind in spans:
            piece = disguised(kind, text[s:e], rng)
            parts += [text[at:s], piece]
            size += s - at
            marks.append((size, size + len(piece), kind))
            size, at = size + len(piece), e
        forms.append((1, "".join([*parts, text[at:]]), marks))
    out = []
    for group, own, chosen in forms:
        classes, tags = char_classes(own), np.zeros(len(own), np.uint8)
        for s, e, kind in reversed(chosen):
            k = KINDS.index(kind)
            tags[s:e], tags[s] = 2 + 2 * k, 1 + 2 * k
        for s, e, _ in chosen[:most]:
            for _ in range(1 if group else DISGUISES):
                out.append((group, *_cut(classes, tags, s - rng.randrange(max(1, WINDOW - min(WINDOW, e - s) + 1)))))
    # Places without spans: some anywhere, some around numbers, some with harmless numbers put in.
    tags = np.zeros(len(text), np.uint8)
    for s, e, _ in base:
        tags[s:e] = 1
    places = [m.start() for m in _TRIGGER.finditer(text)]
    for s in [*[rng.randrange(max(1, len(text))) for _ in range(3)], *(rng.sample(places, min(len(places), 5)))]:
        x, y = _cut(char_classes(text), tags, s - rng.randrange(WINDOW))
        if not y.any():
            out.append((2, x, y))
            cut = max(0, min(len(text) - 1, s))
            own = text[max(0, cut - 60) : cut] + " " + harmless(rng) + " " + text[cut : cut + 60]
            if not base_spans(own) and not tags[max(0, cut - 60) : cut + 60].any():
                out.append((2, *_cut(char_classes(own), np.zeros(len(own), np.uint8), rng.randrange(30))))
    return out


def _cut(classes: np.ndarray, tags: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    start = max(0, min(start, len(classes) - WINDOW))
    x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.uint8)
    n = len(classes[start : start + WINDOW])
    x[:n], y[:n] = classes[start : start + WINDOW], tags[start : start + WINDOW]
    # A span cut by the window's left edge begins there.
    if y[0] and y[0] % 2 == 0:
        y[0] -= 1
    return x, y


# -- decoding ------------------------------------------------------------

_AT = r"(?:@|[\[(]\s?at\s?[\])]|\sat\s)"
_DOT = r"(?:\.|[\[(]\s?dot\s?[\])]|\sdot\s)"
#: What an added span must look like, disguised or not; numbers must pass their kind's check as well.
_SHAPES = {
    "email": re.compile(rf"(?i)[a-z0-9._%+-]+\s?{_AT}\s?[a-z0-9-]+(?:\s?{_DOT}\s?[a-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\s?(?:[\[(](?:\.|dot)[\])]|\.)\s?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"[0-9](?:[ ._/,:-]{0,3}[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9][0-9 ()./-]+[0-9]"),
}


@dataclass
class PiiModel:
    tagger: Tagger | None
    sure: float = 0.9

    def added(self, texts: list[str]) -> list[list[Span]]:
        """Spans that the tagger proposes for each text, before comparison with base spans; whole texts, some windows at a time."""
        found: list[list[Span]] = [[] for _ in texts]
        if self.tagger is None:
            return found
        x, place = np.zeros((WINDOWS_AT_ONCE, WINDOW), np.uint8), []
        pending: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def flush(current: int) -> None:
            tags, sure = self.tagger.decode(x[: len(place)])
            for n in np.flatnonzero(tags.any(axis=1)).tolist():
                k, w = place[n]
                tag, belief = pending[k]
                a, b = owned(w, len(tag))
                tag[a:b], belief[a:b] = tags[n, a - w : b - w], sure[n, a - w : b - w]
            place.clear()
            for k in [k for k in pending if k != current]:
                found[k] = self._runs(*pending.pop(k))

        for k, text in enumerate(texts):
            classes = char_classes(text)
            pending[k] = np.zeros(len(text), np.uint8), np.zeros(len(text), np.float32)
            for w in windows_of(len(text)) if text else ():
                if len(place) == WINDOWS_AT_ONCE:
                    flush(k)
                piece = classes[w : w + WINDOW]
                x[len(place), : len(piece)], x[len(place), len(piece) :] = piece, 0
                place.append((k, w))
        if place:
            flush(-1)
        return found

    def _runs(self, tag: np.ndarray, belief: np.ndarray) -> list[Span]:
        """Spans of a text's tags: each run of one kind that the model is sure of, whatever windows it crosses."""
        spans, marked = [], np.flatnonzero(tag)
        for run in np.split(marked, np.flatnonzero(np.diff(marked) > 1) + 1) if len(marked) else ():
            kind = (tag[run] - 1) // 2
            edges = [0, *(np.flatnonzero((np.diff(kind) != 0) | (tag[run][1:] % 2 == 1)) + 1).tolist(), len(run)]
            for a, b in zip(edges, edges[1:], strict=False):
                if belief[run[a:b]].mean() >= self.sure:
                    spans.append((KINDS[int(kind[a])], int(run[a]), int(run[b - 1]) + 1))
        return spans

    def spans(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text."""
        whole = [t or "" for t in texts]
        out = []
        for text, more in zip(whole, self.added(whole), strict=True):
            base = base_spans(text)
            new: list[Span] = []
            for span in filter(None, (_settled(text, s) for s in more)):
                if not any(span[1] < e and b < span[2] for _, b, e in [*base, *new]):
                    new.append(span)
            out.append((base, sorted({*base, *new}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
        return out


def _settled(text: str, span: Span) -> Span | None:
    """The stretch at a proposed span that looks like its kind and passes its check, else None; edges may move by three characters."""
    kind, s, e = span
    low, high = max(0, s - 3), min(len(text), e + 3)
    for m in _SHAPES[kind].finditer(text[low:high]):
        a, b = low + m.start(), low + m.end()
        if 2 * (min(b, e) - max(a, s)) < e - s or (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and kind != "email"):
            continue
        parts = _DIGITS.findall(m.group())
        size = sum(map(len, parts))
        if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in parts)) or (kind == "card" and 13 <= size <= 19 and luhn("".join(parts))) or (kind == "phone" and 9 <= size <= 15 and (len(parts) > 2 or parts[0].startswith("0"))):
            return kind, a, b
    return None


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", sample_documents: int = 4000, max_windows: int = 1500, windows_per_document: int = 24) -> PiiModel:
    """Train on windows of at most about ``sample_documents`` texts drawn by hash.

    All three bounds are of the training sample alone: of a text at most
    ``windows_per_document`` windows with spans, as many with disguised ones,
    and a few without; of all at most ``max_windows``.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t is not null")
    share = min(1.0, sample_documents / max(1, df.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("k", F.lit(29)), F.lit(1 << 30)) < share * (1 << 30))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(g, x.tobytes() + y.tobytes()) for t in batch.column(0).to_pylist() for g, x, y in labelled_windows(t, zlib.crc32(t.encode("utf-8", "surrogatepass")), windows_per_document)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in made], pa.int32()), pa.array([w for _, w in made], pa.binary())], names=["g", "w"])

    got = drawn.select("t").mapInArrow(extract, "g int, w binary").distinct().select("g", "w", F.crc32("w").alias("o"))
    kept = [r for g in range(3) for r in got.filter(F.col("g") == g).orderBy("o", "w").limit(max_windows // 3).collect()]
    if not any(r["g"] == 0 for r in kept):
        return PiiModel(None)
    groups = [[np.frombuffer(bytes(r["w"]), dtype=np.uint8).reshape(2, WINDOW) for r in kept if r["g"] == g] for g in range(3)]
    # Each group weighs about as much as the largest.
    used = np.stack([w for own in groups for w in own * (max(map(len, groups)) // max(1, len(own)))]).astype(np.int64)
    return PiiModel(train(used[:, 0], used[:, 1]))


def find(df: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``df`` plus base_spans and spans, both array<struct<kind, start, end>>, of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ("base_spans", "spans")
    kept = [c for c in df.columns if c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__gw_text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = shared.value.spans(batch.column(len(kept)).to_pylist())
            made = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b[k]] for b in both], arrow) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *names])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in kept] + [T.StructField(n, span) for n in names]))


def redact(df: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; overlapping spans count as one, named by the first."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            cleaned = [t if t is None else _replaced(t, spans) for t, (_, spans) in zip(texts, shared.value.spans(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cleaned, pa.string()) if k == place else c for k, c in enumerate(batch.columns)], names=names)

    return df.mapInArrow(run, df.schema)


def _replaced(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for kind, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(parts) + text[at:]
