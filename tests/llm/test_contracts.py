"""Every registered query of the numbered operators: its columns and rows, against brute force on the smallest tables."""

import base64
import binascii
import hashlib

import numpy as np
import pytest

from gleanwork.llm import decontam, licenses, queries
from gleanwork.llm.common import release, shared_dir

from .test_corpus_jobs import brute_classes, brute_matches, brute_removed, closure

COLUMNS = {
    "op1_arc_to_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op2_pivot_index": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_license_scan": {"doc_id": "bigint", "license": "string", "dice": "double"},
    "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_decontamination": {"doc_id": "bigint", "item_id": "bigint", "edits": "bigint"},
    "op6_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_centroid_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op12_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op13_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
}


def test_every_number_has_its_query():
    assert list(queries.QUERIES) == list(COLUMNS) and set(queries.ORACLE) <= set(COLUMNS)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def got(spark, sf_dir):
    known = {}

    def run(name):
        if name not in known:
            df = queries.QUERIES[name](spark, sf_dir)
            assert COLUMNS[name].items() <= dict(df.dtypes).items()
            known[name] = df.collect()
        return known[name]

    return run


def test_op1(spark, sf_dir, got):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    top = {}
    for i, raw in pages.items():
        top[raw] = max(top.get(raw, i), i)
    expected = {i: (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if top[raw] == i else "revisit", None if top[raw] == i else top[raw]) for i, raw in pages.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got("op1_arc_to_warc")} == expected


def test_op2(spark, sf_dir, got):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    label = np.array([r.label for r in rows])
    alike = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(rows), dtype=bool)
    ids = [r.vec_id for r in rows]
    root = closure(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(alike), strict=True)])
    expected = {i: (int(n), root[i], root[i] == i) for i, n in zip(ids, alike.sum(axis=1), strict=True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got("op2_pivot_index")} == expected


def test_op3(texts, got):
    matcher = licenses.LicenseMatcher()
    expected = {(i, name): dice for i, t in texts.items() for name, dice, _, _ in matcher.identify(t)}
    assert {(r.doc_id, r.license): r.dice for r in got("op3_license_scan")} == pytest.approx(expected)


def test_op4(texts, got):
    from tokenizers import Tokenizer

    from gleanwork.llm import bpe

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation(), lib.no_padding()
    for r in got("op4_bpe"):
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert len(got("op4_bpe")) == len(texts)


def test_op5(spark, sf_dir, texts, got):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    short = {i: t for i, t in texts.items() if len(decontam.words_of(t)) < 1500}
    found = {(r.doc_id, r.item_id) for r in got("op5_decontamination") if r.doc_id in short}
    truth = brute_matches(short, items)
    assert not found - truth and len(found) >= 0.99 * len(truth)


def test_op7(texts, got):
    sizes, classes = brute_classes(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got("op7_ngram_join")} == {i: (sizes[i], classes[i]) for i in texts}


def test_op8_and_op10_hold_out_by_id(spark, sf_dir, texts, got):
    languages = {r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").distinct().collect()}
    for name in ("op8_language_id", "op10_toxicity"):
        rows = got(name)
        assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
        assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in got("op8_language_id")} <= languages | {"und"}
    assert all(r.predicted == (r.score >= 0.7) for r in got("op10_toxicity"))


def test_op9(texts, got):
    truth = brute_removed(list(texts.items()))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got("op9_suffix_dedup")} == {i: (*truth[i][:3], hashlib.sha256(truth[i][3]).hexdigest()) for i in texts}


def test_shared_folder_is_never_guessed_on_a_cluster(spark, monkeypatch):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: Elsewhere)

        conf = {}

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            class Nothing:
                isDefined = staticmethod(lambda: False)  # noqa: N815

            return Nothing

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)


def test_released_tables_are_gone(spark):
    import os

    from gleanwork.llm.common import materialize

    df = materialize(spark.range(3).toDF("x"), "gone")
    path = df.gleanwork_path.removeprefix("file://")
    assert os.path.isdir(path)
    release(df)
    assert not os.path.exists(path)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
