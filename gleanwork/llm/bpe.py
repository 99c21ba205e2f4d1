"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols.  Leaf ``i`` of the tree holds ``rank << 32 | i``
for the pair that starts at symbol ``i`` (or ``NONE`` if that pair is not in
the merge table), and every inner node holds the smaller child, so the root is
the leftmost pair of lowest rank.  A merge changes three leaves; each change
walks one leaf-to-root path.  Words of up to 65 symbols are processed many at
a time, one numpy row per word; longer words run the same tree alone, so one
word of a million letters costs n log n and not n squared.

The vocabulary is a public ``tokenizers`` JSON file (BPE over byte symbols
with an end-of-word suffix); its path is a parameter.  It is read once on the
driver and broadcast: its size is that of the file.

Defined results: null text counts as empty, empty text has no tokens; repeated
rows give equal results; an empty table gives an empty one; extra columns stay
untouched, but for those with the name of a new column, which it replaces.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = np.int64(1) << np.int64(62)
SHIFT = 32
LONGEST_ROW = 64
CACHE_ENTRIES = 400_000
DOCS_AT_ONCE = 256

#: White space as the vocabulary's normalizer has it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{SPACE}]+")
#: Characters that str.split() takes for white space and the normalizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free one from 256 up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in stand_in:
            stand_in[b] = chr(256 + len(stand_in) - len(kept))
    return [stand_in[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.token_of = {i: t for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in data["added_tokens"] if a["special"]}
        self.token_of.update({i: t for t, i in self.special.items()})
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._pieces = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        alphabet = byte_alphabet()
        self._plain = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self._final = np.array([vocab[c + suffix] for c in alphabet], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self._merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = (left << 20) | right
        order = np.argsort(key, kind="stable")
        self._pair_key, self._pair_rank = key[order], order.astype(np.int64)
        # The same merges as a plain table, for words that are merged alone.
        self._rank_of = dict(zip(self._pair_key.tolist(), self._pair_rank.tolist(), strict=True))
        self._words: dict[str, tuple[bytes, str]] = {}
        self._chunk_ids: dict[str, bytes] = {}
        self._chunk_text: dict[str, str] = {}

    # -- merging ---------------------------------------------------------

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tree keys of the pairs (a, b) that start at ``at``; NONE where b < 0 or no merge exists."""
        key = (a << 20) | np.maximum(b, 0)
        place = np.minimum(np.searchsorted(self._pair_key, key), len(self._pair_key) - 1)
        known = (self._pair_key[place] == key) & (a >= 0) & (b >= 0)
        return np.where(known, (self._pair_rank[place] << SHIFT) | at, NONE)

    def _merge_rows(self, symbols: np.ndarray, leaves: int) -> np.ndarray:
        """Merge every row of ``symbols`` (n x (leaves + 1), padded with -1) to its end; returns it, dead symbols -1."""
        n = len(symbols)
        width = leaves + 1
        # One spare column on the right stands for "no symbol"; index -1 reaches it too.
        sym = np.full((n, width + 1), -1, dtype=np.int64)
        sym[:, :width] = symbols
        step = np.arange(width + 1, dtype=np.int64)
        after = np.broadcast_to(np.minimum(step + 1, width), (n, width + 1)).copy()
        before = np.broadcast_to(np.where(step > 0, step - 1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        tree[:, leaves:] = self._leaf(sym[:, :leaves], sym[:, 1:width], step[:leaves])
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        rows = np.arange(n)
        root = 1
        while True:
            top = tree[rows, root]
            live = top < NONE
            if not live.all():
                rows, top = rows[live], top[live]
            if not len(rows):
                return sym[:, :width]
            at = top & ((1 << SHIFT) - 1)
            new = self._merged[top >> SHIFT]
            gone = after[rows, at]
            follow, lead = after[rows, gone], before[rows, at]
            sym[rows, at], sym[rows, gone] = new, -1
            after[rows, at] = follow
            before[rows, follow] = at
            self._set(tree, leaves, rows, gone, np.full(len(rows), NONE))
            self._set(tree, leaves, rows, at, self._leaf(new, sym[rows, follow], at))
            has = lead < width
            self._set(tree, leaves, rows[has], lead[has], self._leaf(sym[rows[has], lead[has]], new[has], lead[has]))

    @staticmethod
    def _set(tree: np.ndarray, leaves: int, rows: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
        """Point update: write leaves, then renew the nodes on the way to the root."""
        inside = leaf < leaves
        if not inside.all():
            rows, leaf, key = rows[inside], leaf[inside], key[inside]
        node = leaf + leaves
        tree[rows, node] = key
        node >>= 1
        for _ in range(leaves.bit_length() - 1):
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same tree for one long word, in plain lists."""
        n = len(symbols)
        leaves = 1 << (n - 2).bit_length()
        sym = [*symbols, -1]
        after, before = [*range(1, n + 1), n], [n, *range(n)]
        none = int(NONE)
        initial = self._leaf(np.array(symbols[:-1]), np.array(symbols[1:]), np.arange(n - 1))
        tree = [none] * leaves + initial.tolist() + [none] * (leaves - n + 1)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        key_at = self._rank_of

        def put(leaf: int) -> None:
            a, b = sym[leaf], sym[after[leaf]]
            rank = key_at.get((a << 20) | b, -1) if a >= 0 and b >= 0 else -1
            node = leaf + leaves
            tree[node] = none if rank < 0 else (rank << SHIFT) | leaf
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            rank, at = tree[1] >> SHIFT, tree[1] & ((1 << SHIFT) - 1)
            gone = after[at]
            sym[at], sym[gone] = int(self._merged[rank]), -1
            after[at] = after[gone]
            before[after[gone]] = at
            if gone < n - 1:
                put(gone)
            if at < n - 1:
                put(at)
            if before[at] < n:
                put(before[at])
        return [s for s in sym if s >= 0]

    def encode_words(self, words: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each pre-token, merged together by size class."""
        out: list[tuple[bytes, str]] = [(b"", "")] * len(words)
        raws = [w.encode("utf-8") for w in words]
        size = np.array([len(r) for r in raws], dtype=np.int64)
        leaves = 1
        while True:
            of_class = np.flatnonzero((size > 1) & (size - 1 <= leaves) & (size - 1 > leaves // 2)) if leaves > 1 else np.flatnonzero(size <= 2)
            for start in range(0, len(of_class), 8192):
                part = of_class[start : start + 8192]
                self._encode_rows(part, [raws[k] for k in part.tolist()], size[part], leaves, out)
            if leaves == LONGEST_ROW:
                break
            leaves *= 2
        for k in np.flatnonzero(size - 1 > LONGEST_ROW).tolist():
            b = np.frombuffer(raws[k], dtype=np.uint8)
            ids = self._merge_long([*self._plain[b[:-1]].tolist(), int(self._final[b[-1]])])
            out[k] = (np.array(ids, dtype="<u4").tobytes(), self.decode(ids))
        return out

    def _encode_rows(self, members: np.ndarray, raws: list[bytes], size: np.ndarray, leaves: int, out: list[tuple[bytes, str]]) -> None:
        flat = np.frombuffer(b"".join(raws), dtype=np.uint8)
        rows = np.full((len(raws), leaves + 1), -1, dtype=np.int64)
        row = np.repeat(np.arange(len(raws)), size)
        end = np.cumsum(size)
        rows[row, np.arange(len(flat)) - np.repeat(end - size, size)] = self._plain[flat]
        rows[np.arange(len(raws)), size - 1] = self._final[flat[end - 1]]
        rows = self._merge_rows(rows, leaves)
        alive = rows >= 0
        ids = rows[alive]
        raw, tokens = ids.astype("<u4").tobytes(), [self.token_of[i] for i in ids.tolist()]
        stop = np.cumsum(alive.sum(axis=1)).tolist()
        start = 0
        for k, e in zip(members.tolist(), stop, strict=True):
            out[k] = (raw[4 * start : 4 * e], " ".join(tokens[start:e]))
            start = e

    # -- texts -----------------------------------------------------------

    @staticmethod
    def normalize(text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma stays a plain one)."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _chunks(self, text: str) -> list[str]:
        """White-space-free pieces; no token crosses white space."""
        text = self.normalize(text)
        if _NOT_SPACE.search(text):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def _segments(self, text: str) -> list[list[str] | int]:
        """Chunk lists, and the ids of special tokens between them."""
        if self._special_split is None or "<|" not in text:
            return [self._chunks(text)]
        return [self.special[p] if p in self.special else self._chunks(p) for p in self._special_split.split(text) if p]

    def _learn(self, chunks: set[str]) -> None:
        """Make sure that every chunk is in the chunk caches."""
        missing = [c for c in chunks if c not in self._chunk_ids]
        pieces = [self._pieces.findall(c) for c in missing]
        fresh = list({w for p in pieces for w in p if w not in self._words})
        self._words.update(zip(fresh, self.encode_words(fresh), strict=True))
        for chunk, words in zip(missing, pieces, strict=True):
            if len(words) == 1:
                self._chunk_ids[chunk], self._chunk_text[chunk] = self._words[words[0]]
            else:
                known = [self._words[w] for w in words]
                self._chunk_ids[chunk] = b"".join([k[0] for k in known])
                self._chunk_text[chunk] = " ".join([k[1] for k in known])

    def encode_many(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        for start in range(0, len(texts), DOCS_AT_ONCE):
            part = [self._segments(t or "") for t in texts[start : start + DOCS_AT_ONCE]]
            if len(self._chunk_ids) > CACHE_ENTRIES or len(self._words) > CACHE_ENTRIES:
                self._chunk_ids.clear(), self._chunk_text.clear(), self._words.clear()
            self._learn({c for doc in part for s in doc if isinstance(s, list) for c in s})
            ids, text = self._chunk_ids.__getitem__, self._chunk_text.__getitem__
            for doc in part:
                yield (
                    b"".join(b"".join(map(ids, s)) if isinstance(s, list) else s.to_bytes(4, "little") for s in doc),
                    " ".join(t for t in (" ".join(map(text, s)) if isinstance(s, list) else self.token_of[s] for s in doc) if t),
                )

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by blanks (the file names no decoder); ids without a token are left out."""
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)


@lru_cache(maxsize=2)
def _bpe(spec: str) -> WordBpe:
    return WordBpe(spec)


def _spec(df: DataFrame, vocabulary: str | None):
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _with(df: DataFrame, columns: list[T.StructField], text: str, make) -> DataFrame:
    """``df`` plus ``columns`` (replacing any of the same names); ``make`` yields their tuples for a list of texts."""
    names = {c.name.lower() for c in columns}
    kept = [c for c in df.columns if c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__gw_text"))
    schema = T.StructType([source.schema[c] for c in kept] + columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(make(batch.column(len(kept)).to_pylist()))
            new = list(zip(*made, strict=True)) if made else [[] for _ in columns]
            arrays = [pa.array(v, type=t) for v, t in zip(new, _arrow_types(columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, *[c.name for c in columns]])

    return source.mapInArrow(run, schema)


def _arrow_types(columns: list[T.StructField]) -> list[pa.DataType]:
    known = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return [known[c.dataType.simpleString()] for c in columns]


def encode(df: DataFrame, text: str = "text", vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` plus ``ids`` array<int>: the tokens of each whole text."""
    spec = _spec(df, vocabulary)

    def make(texts):
        for raw, _ in _bpe(spec.value).encode_many(texts):
            yield (np.frombuffer(raw, dtype="<u4").astype(np.int32),)

    return _with(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], text, make)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str | None = None, text: str = "decoded") -> DataFrame:
    """``df`` plus ``text``: the decoded string of each id list (null: empty)."""
    spec = _spec(df, vocabulary)

    def make(lists):
        for one in lists:
            yield (_bpe(spec.value).decode(one or []),)

    return _with(df, [T.StructField(text, T.StringType())], ids, make)


def token_digests(df: DataFrame, text: str = "text", vocabulary: str | None = None, ids: str | None = None) -> DataFrame:
    """``df`` plus n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass; with ``ids``, also the tokens under that name."""
    spec = _spec(df, vocabulary)

    def make(texts):
        for raw, decoded in _bpe(spec.value).encode_many(texts):
            own = (np.frombuffer(raw, dtype="<u4").astype(np.int32),) if ids else ()
            yield *own, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    columns = [T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []
    columns += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with(df, columns, text, make)
