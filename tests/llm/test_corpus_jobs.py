"""Archives, near-duplicates, joins, decontamination, suffix sorting and the pipeline, against brute force."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gleanwork.llm import decontam, graph, ngram_join, pivot_index, suffix_dedup, warc
from gleanwork.llm.common import scratch_path


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, None)]
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == closure({x for l in real for x in l}, real)
    assert graph.connected_components(df.limit(0)).count() == 0


# -- WARC


def test_pages_through_archives(spark, sf_dir):
    rows = [(1, "http://a/x y", "same"), (5, "http://b", "same"), (3, None, "same"), (9, "http://c", None), (2, "http://d", ""), (7, "http://e", "é" * 5000), (None, "http://f", "lone"), (4, "u", "a\r\n\r\nWARC/1.1\r\nb\nhttp://x 1 2 3 4")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = {r.page_id: r for r in warc.pages_through_archives(df, scratch_path(spark, "t")).collect()}
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        first = top.get(h or "", i)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
    assert warc.pages_through_archives(df.limit(0), scratch_path(spark, "t")).count() == 0


def test_arc_versions_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 400)
    version = {v: warc.arc_version_block(v, "x.arc", "20260101000000") + warc.arc_record(v, "http://a b", "20260203040506", 8, b"hi\n\nthere", "x.arc", 0) for v in (1, 2)}
    for v, data in version.items():
        for packed in (data, zlib.compress(data, wbits=31)):
            ((got, _, _, fields, block),) = warc.parse_arc(packed)
            assert (got, fields["URL"], fields["Archive-length"]) == (v, "http://a%20b", str(len(block)))
            assert warc.split_http(block)[2] == b"hi\n\nthere"
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(version[1][:-6]))
    assert warc.warc_date("20260203040506") == "2026-02-03T04:05:06Z" and warc.warc_date("2026") == "2026-01-01T00:00:00Z"


def test_minimum_size_for_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.pages_through_archives(df, scratch_path(spark, "t"), least_bytes=4).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# -- embeddings


def test_pivot_index_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    rows = []
    for i in range(300):
        v = rng.normal(size=32) if i % 3 else centres[i % 12] + rng.normal(size=32) * rng.choice([0.05, 0.15, 0.25])
        rows.append((i, v.tolist(), int(i % 2)))
    rows += [(1000 + k, rows[0][1], 0) for k in range(40)]
    good = list(rows)
    rows += [(2000, None, 0), (2001, [0.0] * 32, 0), (2002, [float("nan")] * 32, 0), (2003, rows[0][1], None), (2004, [1.0, 2.0], 0), (2005, [None] * 32, 0), (2006, [float("inf")] * 32, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    x = pivot_index.unit_rows(np.array([r[1] for r in good]))
    label = np.array([r[2] for r in good])
    alike = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(alike, False)
    found = sum(got[r[0]].n_links for r in good)
    assert 0.9 * alike.sum() <= found <= alike.sum()
    assert all(got[r[0]].n_links <= n for r, n in zip(good, alike.sum(axis=1), strict=True))
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(2000, 2007))
    assert pivot_index.near_duplicates(df.limit(0)).count() == 0


def test_pivot_index_with_a_third_of_the_vectors_in_one_group(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=64)
    centre /= np.sqrt(centre @ centre)
    x = rng.normal(size=(9000, 64))
    x[::3] = centre + x[::3] * np.sqrt((1 / 0.96 - 1) / 64)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in pivot_index.near_duplicates(df).collect()}
    unit = pivot_index.unit_rows(x)
    alike = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert all(got[i] <= n for i, n in enumerate(alike.tolist()))
    assert sum(got.values()) >= 0.99 * alike.sum()


def test_descriptions_are_the_nearest_pivots_in_order(monkeypatch):
    monkeypatch.setattr(pivot_index, "CELLS_AT_ONCE", 50)
    rng = np.random.default_rng(4)
    x, pivots = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (17, 3)).astype(float)
    for take in (1, 5, 17, 30):
        expected = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, : min(take, 17)]
        assert (pivot_index.describe(x, pivots, take) == expected).all()


def test_registered_pivot_query_draws_pivots_at_every_size(spark, tmp_path, monkeypatch):
    from gleanwork.llm import queries

    drawn = []
    draw = pivot_index._draw
    monkeypatch.setattr(pivot_index, "_draw", lambda *a: drawn.append(len(made := draw(*a))) or made)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 64))
    x = centres[rng.integers(0, 150, 2600)] + rng.normal(size=(2600, 64)) * rng.choice([0.1, 0.2, 0.27], size=(2600, 1))
    for n in (1, 2, 60, 2600):
        spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x[:n])], "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = {r.vec_id: r.n_links for r in queries.QUERIES["op2_pivot_index"](spark, f"{tmp_path}/{n}").collect()}
        unit, label = pivot_index.unit_rows(x[:n].astype(np.float32)), np.arange(n) % 2
        alike = ((unit @ unit.T >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
        assert all(got[i] <= k for i, k in enumerate(alike.tolist()))
        assert sum(got.values()) == alike.sum() if n <= pivot_index.TRIALS else sum(got.values()) >= 0.98 * alike.sum()
    assert len(drawn) == 4 and min(drawn) >= 1


def test_pivot_index_where_all_vectors_are_near(spark):
    x = np.random.default_rng(3).normal(size=(60, 16)) * 0.01 + 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in pivot_index.near_duplicates(df).collect()} == {(59, 0)}


def test_pivot_index_of_mixed_lengths_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [2.0, 4.1], 0), (4, [1.0, 0.0, 0.0], 0), (5, [1.0, 0.01, 0.0], 0), (6, [5.0], 0), (7, [2.0], 0), (7, [0.0, 1.0, 0.0], 0), (7, [0.0, 1.0, 0.01], 0), (None, [1.0, 2.0], 0), (8, [], 0), (9, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, r[0], "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, cid long, near string, n_links int")
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in pivot_index.near_duplicates(df).collect())
    assert got == [(-1, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True), (9, 0, 9, True)]


def test_pivot_index_recall_against_brute_force_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 400)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(700, 48))
    x = centres[rng.integers(0, 700, 6000)] + rng.normal(size=(6000, 48)) * rng.choice([0.1, 0.2, 0.27], size=(6000, 1))
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert pivot_index.recall(df, every=20) >= 0.95


# -- n-gram join


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, closure(ids, links)


def edited_group(rng, base, count, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "short"), [(8, 4), (1024, 64)])
def test_ngram_join_against_brute_force(spark, monkeypatch, block, short):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 6)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    for size in (6, 12, 30, 80, 200):
        texts += edited_group(rng, [word() for _ in range(size)], 22, max(1, size // 30))
    passage = " ".join(word() for _ in range(40))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    texts += [None, "", " \n ", "A b", "a B", "a b c d", "x", "x y z é É q r", " ".join(["for"] * 3000), " ".join(["For"] * 900)]
    texts += [texts[0]] * 5
    rows = {i: t for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, "s", i) for i, t in rows.items()] + [(None, texts[0], "s", 1)], "doc_id long, text string, node string, n long")
    got = {r.doc_id: r for r in ngram_join.near_classes(df).collect()}
    sizes, classes = brute_classes(rows)
    assert got.pop(None).component_id is None
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == classes


def test_ngram_join_of_nothing_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (1, "other words in this row here")], "doc_id long, text string")
    assert [r.component_id for r in ngram_join.near_classes(df).collect()] == [1] * 4
    assert ngram_join.near_classes(df.limit(0)).count() == 0


def test_ngram_join_of_large_groups_that_hubs_do_not_reach(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    monkeypatch.setattr(ngram_join, "SHORT", 3)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 10**6)
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(30)]
    # A chain of texts each near to the next only, groups of near copies, and strangers, all with one passage.
    texts = [" ".join(passage + [f"c{k + j}" for j in range(60)]) for k in range(0, 120, 4)]
    for g in range(6):
        texts += edited_group(rng, passage + [f"g{g}w{k}" for k in range(40)], 14, 1)
    texts += [" ".join(passage + [f"s{n}w{k}" for k in range(rng.randrange(30, 60))]) for n in range(40)]
    rng.shuffle(texts)
    rows = dict(enumerate(texts))
    got = {r.doc_id: r.component_id for r in ngram_join.near_classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)[1]


def test_ngram_join_of_a_very_long_text(spark):
    words = [f"w{k}" for k in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[100_000:])), (4, "w1 w2 w3 w4 w5 w6")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (199_996, 1), 2: (190_996, 1), 3: (99_996, 3), 4: (2, 4)}


def test_signatures_are_shared_by_similar_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(3, 400))
        a = np.unique(rng.integers(1, 1 << 60, n, dtype=np.uint64))
        drop = rng.integers(0, ngram_join.most_missing(len(a)) // 2 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(1, 1 << 60, drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or (a.tolist() == b.tolist()):
            continue
        hot = np.sort(rng.permutation(np.union1d(a, b))[: int(rng.integers(0, len(a) + 1))])
        frequent = ngram_join.Frequent(hot, rng.permutation(len(hot)))
        (own, need), (other, wanted) = ngram_join.signatures(a, frequent), ngram_join.signatures(b, frequent)
        assert np.intersect1d(own, other).size >= min(need, wanted)


# -- decontamination


def brute_matches(texts, items):
    out = set()
    for d, t in texts.items():
        doc = decontam.words_of(t)
        for i, s in items.items():
            item = decontam.words_of(s)
            if len(item) < decontam.LEAST_WORDS:
                continue
            cost = [0] * (len(doc) + 1)
            for k, w in enumerate(item, 1):
                row = [k]
                for j, x in enumerate(doc, 1):
                    row.append(min(cost[j] + 1, row[-1] + 1, cost[j - 1] + (w != x)))
                cost = row
            if min(cost) <= decontam.most_edits(len(item)):
                out.add((d, i))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(200)}"
    items = {i: " ".join(word() for _ in range(rng.choice([4, 5, 6, 8, 13, 20, 38, 59]))) for i in range(40)}
    items |= {90: None, 91: "", 92: "one two"}
    texts = {}
    for d in range(150):
        own = [word() for _ in range(rng.randrange(0, 60))]
        if d % 2:
            copy = (items[rng.randrange(40)] or "").split()
            for _ in range(rng.randrange(0, len(copy) // 3 + 1)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], ["zz"], [copy[k], "yy"]])
            own = own + copy + [word() for _ in range(rng.randrange(20))]
        texts[d] = " ".join(own).title()
    texts |= {500: None, 501: "", 502: "one two"}
    docs = spark.createDataFrame(list(texts.items()) + [(None, items[0])], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()) + [(None, "a b c d e f g")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect() if r.doc_id is not None}
    truth = brute_matches(texts, items)
    assert not got - truth and len(got) >= 0.97 * len(truth)
    flagged = {r.doc_id for r in decontam.contaminated(docs, bench).collect() if r.contaminated}
    assert flagged == {d for d, _ in got} | {None}
    assert decontam.matches(docs.limit(0), bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_of_texts_that_begin_or_end_within_an_item(spark):
    items = {n: " ".join(f"w{n}x{k}" for k in range(n)) for n in (6, 15, 40)}
    texts = {}
    for n, item in items.items():
        words = item.split()
        for keep in range(1, n + 1):
            texts[len(texts)] = " ".join(words[-keep:])
            texts[len(texts)] = " ".join([*words[-keep:], *["other"] * 30])
            texts[len(texts)] = " ".join([*["other"] * 30, *words[:keep]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == brute_matches(texts, items)


def test_decontamination_by_short_items_and_scripts_without_blanks(spark):
    items = {1: "Xylophone", 2: "blue whale", 3: "who was first", 4: "where is the hotel", 5: "one small step for man", 6: "中国的首都是哪个城市", 7: "กรุงเทพ", 8: "日本"}
    texts = {1: "a xylophone", 2: "xylophones", 3: "the blue whale", 4: "blue or whale", 5: "Who was first?", 6: "who is first", 7: "so where is that hotel now", 8: "small step for man", 9: "one small step man", 10: "问题:中国的首都是那个城市?", 11: "ไปกรุงเทพมา", 12: "日本語", 13: "日 本", 14: "step", 15: "本日", 16: "the hotel"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(1, 1), (3, 2), (5, 3), (7, 4), (8, 5), (9, 5), (10, 6), (11, 7), (12, 8), (13, 8)}
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == found
    assert {r.doc_id for r in decontam.contaminated(docs, bench).collect() if r.contaminated} == {d for d, _ in found}


@pytest.mark.parametrize(("count", "size"), [(1, 4), (1, 5), (1, 6), (1, 13), (1, 40), (3, 40), (20, 25)])
def test_recall_on_planted_stretches_at_the_edit_limit(count, size):
    rng = random.Random(count * size)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(size))) for i in range(count)]
    index, found = decontam.build_index(items), 0
    for trial in range(300):
        words = items[trial % count][1].split()
        for _ in range(decontam.most_edits(size)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[f"w{rng.randrange(800)}"], [words[k], f"w{rng.randrange(800)}"], [] if len(words) > 1 else ["w"]])
        noise = [f"x{rng.randrange(300)}" for _ in range(120)]
        found += trial % count in {m[0] for m in index.find(noise[:60] + words + noise[60:])}
    assert found >= 0.98 * 300


def test_decontamination_in_many_blocks_with_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 8)
    items = {k: " ".join(f"item{k}word{j}" for j in range(7)) for k in range(30)}
    texts = {k: " ".join([*["filler"] * (60_000 if k == 3 else 40), items[k % 30]]) for k in range(60)}
    docs = spark.createDataFrame([(k, t, "x", True, 1) for k, t in texts.items()], "doc_id long, text string, item_id string, contaminated boolean, edits int")
    bench = spark.createDataFrame([(k, t, "y") for k, t in items.items()], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == {(k, k % 30) for k in texts}
    marked = decontam.contaminated(docs.union(docs.selectExpr("doc_id + 100", "'clean text'", "item_id", "contaminated", "edits")), bench)
    assert {r.doc_id for r in marked.collect() if r.contaminated} == set(texts) and "edits" in marked.columns


def test_all_candidates_share_a_key_with_their_item(monkeypatch):
    """Short items and windows at the ends of a text too: without keys nothing is found."""
    items = [(1, "blue"), (2, "blue whale"), (3, "where is the hotel"), (4, "one small step for a man")]
    index = decontam.build_index(items)
    text = "where is that hotel one small step for man blue whale".split()
    assert {m[0] for m in index.find(text)} == {1, 2, 3, 4}
    monkeypatch.setattr(decontam.ItemIndex, "_keyed", lambda self, doc, zones: [False] * len(zones))
    assert not index.find(text)


def test_zones_are_keyed_alike_however_many_go_together(monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 9, 30])))) for i in range(30)]
    index = decontam.build_index(items)
    text = [f"w{rng.randrange(60)}" for _ in range(500)] + " ".join(t for _, t in items[::3]).split()
    whole = index.find(text)
    monkeypatch.setattr(decontam, "CELLS_AT_ONCE", 1)
    assert index.find(text) == whole and {m[0] for m in whole} >= {i for i, _ in items[::3]}


@pytest.mark.parametrize("limit", [1, 7, 50, 10**6])
def test_texts_are_grouped_whole_and_in_order(monkeypatch, limit):
    monkeypatch.setattr(decontam, "CHARS_AT_ONCE", limit)
    texts = [None, "", "abc", "x" * 40, "", "defghij", None, "é" * 9, "kl"] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string())], names=["t"]) for a, b in ((0, 5), (5, 5), (5, 6), (6, 27))]
    groups = [[t for b in g for t in b.column(0).to_pylist()] for g in decontam._groups(iter(batches), 0)]
    assert [t for g in groups for t in g] == texts
    assert all(len(g) == 1 or sum(len((t or "").encode()) for t in g) <= limit for g in groups)
    assert limit < 10**6 or len(groups) == 1


def test_blocks_are_loaded_back_and_forth(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontam, "CHARS_AT_ONCE", 400)
    items = {k: " ".join(f"item{k}word{j}" for j in range(7)) for k in range(30)}
    files = decontam._index_files(spark.createDataFrame(list(items.items()), "i long, t string"))
    held = [f for f in files if decontam._loaded(f) is not None]
    assert len(held) > 3
    batch = pa.RecordBatch.from_arrays([pa.array([items[k] for k in range(30)])], names=["t"])
    groups = len(list(decontam._groups(iter([batch]), 0)))
    decontam._loaded.cache_clear()
    found = [own for _, rows in decontam._found(held, iter([batch]), 0) for own in rows]
    assert [[m[0] for m in own] for own in found] == [[k] for k in range(30)]
    assert decontam._loaded.cache_info().misses == len(held) + (groups - 1) * (len(held) - 1)
    decontam._loaded.cache_clear()
    list(decontam._found(held[:1], iter([batch]), 0))
    assert decontam._loaded.cache_info().misses == 1


# -- suffixes


def brute_removed(texts):
    raw = {i: (t or "").encode() for i, t in texts}
    starts = collections.Counter(b[p : p + 200] for _, t in texts for b in [(t or "").encode()] for p in range(len(b) - 199))
    out = {}
    for i, b in raw.items():
        keep = [True] * len(b)
        for p in range(len(b) - 199):
            if starts[b[p : p + 200]] > 1:
                keep[p : p + 200] = [False] * 200
        spans = sum(not k and (n == 0 or keep[n - 1]) for n, k in enumerate(keep))
        out[i] = (len(b), keep.count(False), spans, bytes(c for c, k in zip(b, keep, strict=True) if k))
    return out


@pytest.mark.parametrize("hot", [3, 10**6])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", hot)
    monkeypatch.setattr(suffix_dedup, "STARTS_AT_ONCE", 700)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdeé fgh") for _ in range(n))
    shared = [noise(n) for n in (150, 199, 200, 230, 600)]
    texts = [noise(rng.randrange(400)) + rng.choice(shared) + noise(rng.randrange(300)) for _ in range(40)]
    texts += [noise(100) + shared[4][: rng.randrange(150, 600)] + noise(100) for _ in range(20)]
    texts += [None, "", "short", "short", "ab" * 400, "for " * 300, "x" * 200, "x" * 199, "y" * 201, texts[0], texts[0]]
    rows = list(enumerate(texts)) + [(900, texts[5])]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = suffix_dedup.remove_repeats(df).collect()
    truth = brute_removed(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == truth[r.doc_id], r.doc_id
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_order_with_long_ties():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(400)) + b"a" * 700 + b"xyz" * 300
    text += text[100:900]
    starts = np.arange(len(text) - 200)
    order = np.concatenate(list(suffix_dedup.SuffixSorter(text).buckets(starts)))
    assert sorted(order.tolist()) == starts.tolist()
    cut = [text[p : p + 200] for p in order.tolist()]
    assert cut == sorted(cut)
    d = suffix_dedup.COVER
    assert {(int(a) - int(b)) % suffix_dedup.PERIOD for a in d for b in d} == set(range(suffix_dedup.PERIOD))


# -- pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    base = " ".join(f"word{k} of the text" for k in range(20))
    item = "what is the name of the river that runs through the old town"
    rows = [(1, base + " mail me@x.org", "en", "s", 1), (2, base + " mail you@x.org", "en", "s", 1), (3, "12345 %%%", "en", "s", 1), (4, "some words before " + item + " and after", "en", "s", 1), (5, None, "en", "s", None), (6, "Der Hund und die Katze gehen nach Hause und schlafen", "de", "s", 1), (7, "the dog and the cat go home and sleep", None, "s", 1)]
    rows += [(10 + k, f"the people of this place and that other number{k} with it for you are not in the list", "en", "s", 1) for k in range(20)]
    rows += [(40 + k, f"die Leute und der Ort mit nummer{k} das ist nicht ein anderes wir sind auf dem Weg", "de", "s", 1) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1, 6, 7} <= out.keys() and not {2, 3, 4, 5} & out.keys()
    assert len(corpus_pipeline.STAGES) == 5
    step = corpus_pipeline.personal_data(spark, docs.filter("doc_id = 1"), str(tmp_path)).first()
    assert step.text.endswith("[EMAIL]") and step.n_chars == len(step.text)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_archives_of_other_writers_and_of_tasks_that_ran_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x"), (3, "http://c", "y")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/arc"
    first, second = warc.write_arc(df, folder), warc.write_arc(df, folder)
    assert first.join(second, "archive").count() == 0
    assert sorted(r.page_id for r in warc.read_arc(spark, folder, second).collect()) == [1, 2, 3]
    assert sorted(r.page_id for r in warc.read_arc(spark, folder).collect()) == [1, 1, 2, 2, 3, 3]


def test_suffix_dedup_of_variants_in_slices_of_anchors(spark, monkeypatch):
    """Half of all text stands in two slightly different forms; contexts are sorted a few anchors at a time."""
    sorted_bytes = []
    whole = suffix_dedup._sorted_slice
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 3000)
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, rng.integers(3, 9), dtype=np.uint8)).decode() for _ in range(300)]
    texts = []
    for _ in range(12):
        own = [words[k] for k in rng.integers(0, len(words), 400)]
        other = list(own)
        for k in rng.integers(0, len(own), 6):
            other[k] = "changed"
        texts += [" ".join(own), " ".join(other), " ".join(words[k] for k in rng.integers(0, len(words), 400))]
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    truth = brute_removed(docs)
    assert got == {i: tuple(truth[i]) for i, _ in docs} and sum(n for _, n, _, _ in got.values()) > 20_000

    # The slices of one table, measured: none holds more than the bound and one anchor's contexts.
    monkeypatch.setattr(suffix_dedup, "_sorted_slice", lambda pieces, *facts: sorted_bytes.append(sum(map(len, pieces))) or whole(pieces, *facts))
    n = 400
    pieces = [bytes(rng.integers(97, 123, 240, dtype=np.uint8)) for _ in range(n)]
    table = pa.table({"anchor": pa.array(np.arange(n) // 2 - n), "key": pa.array(np.arange(n)), "lo": pa.array(np.zeros(n, np.int64)), "span": pa.array(np.full(n, 40)), "text": pa.array(pieces)})
    assert suffix_dedup._sort_contexts(table).num_rows == 0 and suffix_dedup._sort_contexts(table.slice(0, 0)).num_rows == 0
    assert sum(sorted_bytes) == 240 * n and max(sorted_bytes) <= 3000 + 480
