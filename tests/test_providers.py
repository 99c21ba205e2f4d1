"""The provider source: order, caps, failures as rows, streams that go on after a restart."""

import json

import pytest

from gleanwork.sources import providers

FETCH = "tests.provider_pages:fetch"


def test_each_provider_is_a_task_and_fails_alone(spark):
    items, failed = providers.scan(spark, FETCH, ["b", "broken", "a", "empty", "loop", "b"])
    assert items.rdd.getNumPartitions() == 5
    got = items.orderBy("provider_rank", "position").collect()
    ids = {p: [json.loads(r.item)["id"] for r in got if r.provider == p] for p in ("b", "broken", "a", "loop")}
    assert ids["b"] == [f"b{p}-{k}" for p in range(2) for k in range(4)] and ids["a"] == [f"a{p}-{k}" for p in range(3) for k in range(4)]
    assert ids["broken"] == [f"broken0-{k}" for k in range(4)] and [r.provider for r in got][:8] == ["b"] * 8
    assert {(r.provider, r.page, r.error) for r in failed.collect()} == {("broken", 1, "ConnectionError: no answer"), ("loop", 2, "cursor 1 was given before")}


@pytest.mark.parametrize(("max_pages", "max_items", "n"), [(2, None, 8), (None, 6, 6), (1, 3, 3), (None, None, 200), (5, 1000, 20)])
def test_caps_on_pages_and_items(spark, max_pages, max_items, n):
    items, failed = providers.scan(spark, FETCH, ["long"], max_pages, max_items)
    got = items.collect()
    assert len(got) == n and failed.count() == 0 and sorted(r.position for r in got) == list(range(n))
    assert max(r.page for r in got) == (n - 1) // 4


def test_items_of_any_shape():
    rows = list(providers.pages(lambda p, c: (["text", {"url": "u"}, {"url": "u", "x": 1}, 5], None), "p", 0))
    assert [r[4] for r in rows] == ["text", '{"url": "u"}', "5"]
    assert len(list(providers.pages(lambda p, c: (["same", "same"], None), "p", 0, dedupe=False))) == 2


def test_a_stream_reads_a_page_a_trigger_and_goes_on(spark, tmp_path):
    source = providers.stream(spark, FETCH, ["a", "broken", "b"])

    def run(batches):
        query = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            for _ in range(600):
                done = [p for p in query.recentProgress if p["numInputRows"] > 0]
                if len(done) >= batches or query.exception():
                    break
                query.awaitTermination(0.2)
        finally:
            query.stop()
        assert query.exception() is None

    run(1)
    first = {(r.provider, r.page) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("a", 0) in first
    run(1)
    run(1)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.provider, r.page) for r in got} == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("broken", 0), ("broken", 1)}
    assert [r.error for r in got if r.error] == ["ConnectionError: no answer"]
    assert len([r for r in got if r.provider == "a"]) == len({(r.page, r.position) for r in got if r.provider == "a"}) == 14
