"""Outcomes of runs: hand-made cases beyond those of the registered queries."""

import datetime

import pytest
from pyspark.sql import functions as F

from gleanwork.operators import articles, outcomes, posts


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_models_may_be_in_both_sets(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", True), ("c", False), (None, True)], "model string, ok boolean")
    got = {r["model"]: (r["successes"], r["failures"], r["state"]) for r in outcomes.model_sets(rows, "model", F.col("ok")).collect()}
    assert got == {"a": (1, 1, "BOTH"), "b": (1, 0, "SUCCESS"), "c": (0, 1, "FAILED")}
    assert outcomes.model_sets(rows.limit(0), "model", F.col("ok")).count() == 0


def test_first_provider_that_did_not_fail(spark):
    rows = [("q1", 1, "x", None, "down"), ("q1", 2, "y", "Y", None), ("q1", 3, "z", "Z", None), ("q2", 1, "y", None, "slow"), ("q2", 2, "x", None, "down"), ("q3", 1, "other", "O", None), ("q4", 1, "x", None, None), ("q5", 2, "x", "late", None), ("q5", 1, "x", None, "first")]
    table = spark.createDataFrame(rows, "q string, n int, provider string, result string, error string")
    got = {r["q"]: (r["provider"], r["result"], r["errors"], r["state"]) for r in outcomes.first_answers(table, "q", "n", ["x", "y", "z"]).collect()}
    assert got == {
        "q1": ("y", "Y", "x: down", "ANSWERED"), "q2": (None, None, "x: down; y: slow", "FAILED"),
        "q4": ("x", None, "", "ANSWERED"), "q5": (None, None, "x: first", "FAILED"),
    }


def test_reconciliation(spark):
    posts_made = [("p1", "u", "once", at(5)), ("p2", "u", "often", at(5)), ("p3", "u", "often", at(9)), (None, "u", "nameless", at(9)), ("p4", "u", "timeless", None), ("p5", "u", None, at(9)), ("p6", "u", "tie", at(5)), ("p7", "u", "tie", at(5))]
    posts_made += [(f"h{k}", "u", "hot", at(k % 50)) for k in range(3000)]
    asked = [(1, "once", at(5)), (2, "once", at(6)), (3, "often", at(1)), (4, "often", at(6)), (5, "nameless", at(1)), (6, "timeless", at(1)), (7, None, at(1)), (8, "once", None), (9, "tie", at(5)), (10, "hot", at(49)), (11, "hot", at(50))]
    p = spark.createDataFrame(posts_made, "external_id string, url string, text string, created_at timestamp")
    a = spark.createDataFrame(asked, "id long, text string, started_at timestamp")
    got = {r["id"]: (r["state"], r["external_id"]) for r in outcomes.reconciled(a, p, ["id"]).collect()}
    assert got == {
        1: ("MATCH", "p1"), 2: ("NONE", None), 3: ("AMBIGUOUS", None), 4: ("MATCH", "p3"), 5: ("NONE", None), 6: ("NONE", None),
        7: ("NONE", None), 8: ("INVALID", None), 9: ("AMBIGUOUS", None), 10: ("AMBIGUOUS", None), 11: ("NONE", None),
    }
    assert {r["state"] for r in outcomes.reconciled(a, p.limit(0), ["id"]).collect()} == {"NONE", "INVALID"}


def test_hot_texts_are_cut_before_the_shuffle(spark):
    p = spark.range(100).selectExpr("string(id) external_id", "'u' url", "if(id > 3, 'hot', 'x' || id) text", "timestamp_seconds(id) created_at")
    plan = outcomes.reconciled(p.selectExpr("external_id id", "text", "created_at started_at"), p, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize(("size", "limit", "pages", "n"), [(5, 12, 2, 10), (5, 12, 3, 12), (20, 12, 1, 12), (1, 1, 1, 1), (50, 100, 2, 30)])
def test_caps_of_pages_and_items(spark, size, limit, pages, n):
    got = outcomes.paged(spark.range(30).withColumn("k", F.lit("one")), ["k"], ["id"], size, limit, pages).orderBy("id").collect()
    assert [(r["id"], r["page"]) for r in got] == [(k, k // size) for k in range(n)]
    with pytest.raises(ValueError):
        outcomes.paged(spark.range(3), ["id"], ["id"], 0)


def test_lists_and_links(spark):
    rows = spark.createDataFrame([(["a", "b", "a"], ["b", "a"]), (None, []), (["a", None], ["a"]), (["a"], ["b", ""])], "a array<string>, b array<string>")
    got = rows.select(outcomes.same_members(F.col("a"), F.col("b")).alias("s"), outcomes.all_members(F.col("a"), F.col("b")).alias("u")).collect()
    assert [(r["s"], r["u"]) for r in got] == [(True, ["a", "b"]), (True, []), (True, ["a"]), (False, ["a", "b"])]
    ids = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    assert {r["id"] for r in outcomes.unlinked(ids, spark.createDataFrame([(1,), (1,), (None,)], "id long"), "id").collect()} == {2, None}


def test_last_times(spark):
    rows = spark.createDataFrame([("a", "PUBLISHED", at(1)), ("a", "published", at(3)), ("a", "FAILED", at(9)), ("b", "FAILED", at(1)), ("c", "published", None)], "platform string, status string, published_at timestamp")
    assert [(r["platform"], r["last_published_at"]) for r in outcomes.last_published(rows, ["platform"]).collect()] == [("a", at(3))]


def test_metadata_falls_back_by_name(spark):
    pages = [
        (1, '<html lang="fr"><head><title> T &amp; t </title><meta name="twitter:title" content=""><meta property="article:author" content="Desk"></head><body>x</body></html>', "old"),
        (2, '<title>T</title><meta property="og:title" content="Shared"><meta name="author" content="Ann"><meta property="article:author" content="Desk"><link rel="canonical" href=" https://a.example/x ">', "old"),
        (3, None, "old"),
        (4, "", "old"),
    ]
    found = articles.page_metadata(spark.createDataFrame(pages, "page_id long, html string, Title string"))
    assert found.columns == ["page_id", "title", "author", "published", "canonical", "language"]
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {1: ("T & t", "Desk", None, None, "fr"), 2: ("Shared", "Ann", None, "https://a.example/x", None), 3: (None,) * 5, 4: (None,) * 5}


def test_repetitive_sentences(spark):
    rows = [(1, "Rain hit the northern valley towns. The northern valley towns were hit by rain. Markets rose."), (2, None), (3, ""), (4, "The. The. The.")]
    got = posts.repetitive_sentences(spark.createDataFrame(rows, "id long, body string"), ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1)]
