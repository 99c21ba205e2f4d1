"""Quality rules: counts by brute force, trees that keep their directions, held-out labels."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanwork.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def counts(texts):
    return [tuple(int(v) for v in row) for c, _ in quality.in_bounded_runs(pa.array(texts, pa.string())) for row in c]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x1c\x85\xa0é#|语", max_size=60)), min_size=1, max_size=6))
def test_counts(texts):
    assert counts(texts) == [brute(t) for t in texts]


def test_counts_of_windows_within_texts_only(monkeypatch):
    texts = ["a b c d e", "a b c d e a b c d e", "a a a a a a", None, "", "x " * 9, "a b c d e f a b c d g", "p\nq\np\n \n \np "]
    assert counts(texts) == [brute(t) for t in texts]
    monkeypatch.setattr(quality, "BYTES_AT_ONCE", 7)
    assert counts(texts) == [brute(t) for t in texts]


def test_long_text():
    text = " ".join(f"w{i % 70000}" for i in range(200_000))
    assert counts([text, "short one"])[0] == brute(text)


def sample(n=800, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(quality.FEATURES)))
    k = quality.FEATURES.index("symbols")
    # The label rises with the symbols in part of the range: a free tree would follow.
    y = ((x[:, k] < 0.3) | (x[:, k] > 0.8)).astype(int)
    return x, y


def test_scores_only_fall_where_they_may_not_rise():
    x, y = sample()
    model = quality.train(x, y)
    grid = np.linspace(0, 1, 60)
    for name, way in quality.MONOTONE.items():
        k = quality.FEATURES.index(name)
        for row in x[:40]:
            line = np.repeat(row[None], len(grid), axis=0)
            line[:, k] = grid
            assert (way * np.diff(model.scores(line)) >= -1e-12).all()


def test_flat_arrays_equal_a_walk_down_each_tree():
    x, y = sample(300, 2)
    model = quality.train(x, y, trees=7, depth=4)

    def walk(row):
        total = model.base
        for node in model.root:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert model.scores(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r, labels[r.doc_id]) for r in queries.QUERIES["op12_quality_rules"](spark, sf).collect() if r.held_out and r.doc_id in labels and not r.base_failed]
    good, junk = [r for r, q in got if q == 1], [r for r, q in got if q == 0]
    assert len(junk) > 50 and sum(r.kept for r in good) >= 0.995 * len(good) and sum(not r.kept for r in junk) >= 0.95 * len(junk)


def test_registered_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op12_quality_rules"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {i: brute(t) for i, t in texts.items()} and len(got) == len(texts)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.base_failed or r.kept is False) for r in got)


def test_rows_without_text_labels_or_both_classes(spark):
    good = "one two three four five six seven eight nine ten eleven."
    docs = spark.createDataFrame([(1, good, "x", 0.5), (1, good, "x", 0.5), (None, good, "x", 0.5), (2, None, "x", 0.5), (3, "", "x", 0.5), (4, "a b", "x", 0.5)], "doc_id long, text string, kept string, c double")
    for labels in ([], [(1, 1)], [(1, None), (None, 1), (7, 0)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.judge(docs, model)
        assert got.columns == ["doc_id", "text", "c", *quality.COUNTS, "base_failed", "score", "kept"]
        assert sorted((r.doc_id or 0, r.kept) for r in got.collect()) == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, False)]
        assert quality.judge(docs.limit(0), model).count() == 0
