"""The upsert table: streams, restarts, partial columns, compaction."""

import os

import pytest

from gleanwork.streaming import jobs, upserts

SCHEMA = "id long, v string, at int"


@pytest.fixture
def table(spark, tmp_path):
    return upserts.UpsertTable(spark, f"file://{tmp_path}/table", SCHEMA, ["id"], buckets=4)


def state(table, **kw):
    return {r.id: (r.v, r["at"]) for r in table.read(**kw).collect()}


def landed(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark, table, tmp_path):
    batches = [[(i, f"{k}-{i}", k) for i in range(k, k + 4)] for k in range(3)]
    landed(spark, f"{tmp_path}/in", *batches)
    stream = jobs.landing(spark, f"{tmp_path}/in", SCHEMA, files_at_once=1)
    upserts.upsert_stream(stream, table, f"{tmp_path}/c").awaitTermination()
    got = state(table)
    assert got.keys() == set(range(6)) and all(v == f"{at}-{i}" for i, (v, at) in got.items())
    assert got[0] == ("0-0", 0) and got[5] == ("2-5", 2)


def test_a_stream_with_a_new_checkpoint_loses_nothing(spark, table, tmp_path):
    for k in range(2):
        landed(spark, f"{tmp_path}/in{k}", [(k, f"stream {k}", k)])
        upserts.upsert_stream(jobs.landing(spark, f"{tmp_path}/in{k}", SCHEMA), table, f"{tmp_path}/c{k}").awaitTermination()
    assert state(table) == {0: ("stream 0", 0), 1: ("stream 1", 1)}
    # The same checkpoint goes on where it stopped.
    landed(spark, f"{tmp_path}/in1", [(0, "later", 9)])
    upserts.upsert_stream(jobs.landing(spark, f"{tmp_path}/in1", SCHEMA), table, f"{tmp_path}/c1").awaitTermination()
    assert state(table)[0] == ("later", 9) and [e["batch"] for e in table._log()] == [0, 0, 1]


def test_a_repeated_batch_changes_nothing(spark, table):
    assert table.apply(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0, "s")
    assert not table.apply(spark.createDataFrame([(1, "b", 2)], SCHEMA), 0, "s")
    assert table.apply(spark.createDataFrame([(1, "c", 3)], SCHEMA), 0, "t") and state(table) == {1: ("c", 3)}


def test_partial_columns_nulls_and_order_in_a_batch(spark, table):
    table.apply(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], SCHEMA), 0)
    table.apply(spark.createDataFrame([(1, None), (3, "new")], "id long, v string"), 1)
    table.apply(spark.createDataFrame([(2, 5, 1), (2, 4, 2), (None, 7, 0)], "id long, at int, seq int"), 2, order=["seq"])
    assert state(table) == {1: (None, 1), 2: ("b", 4), 3: ("new", None), None: ("n", 7)}
    assert state(table, version=0) == {1: ("a", 1), 2: ("b", 2), None: ("n", 0)}
    assert state(table, where={"id": 2}) == {2: ("b", 4)} and state(table, where={"id": None}) == {None: ("n", 7)}


def test_only_touched_buckets_are_written_and_compacted(spark, table, tmp_path):
    table.apply(spark.createDataFrame([(i, "base", 0) for i in range(200)], SCHEMA), 0)
    for k in range(1, 5):
        table.apply(spark.createDataFrame([(7, f"v{k}", k)], SCHEMA), k)
    log = table._log()
    assert [len(e["buckets"]) for e in log] == [4, 1, 1, 1, 1]
    before = state(table)
    assert table.compact(deltas=3) == log[1]["buckets"] and table.compact(deltas=3) == []
    assert state(table) == before and before[7] == ("v4", 4) and len(before) == 200
    # The first folder still holds the other buckets; the deltas are gone.
    gone = table.vacuum()
    assert sorted(gone) == sorted(e["data"] for e in log[1:]) and state(table) == before
    assert len(os.listdir(f"{tmp_path}/table/data")) == 2


def test_what_is_committed_during_a_compaction_stays(spark, table, monkeypatch):
    for k in range(3):
        table.apply(spark.createDataFrame([(1, f"v{k}", k)], SCHEMA), k)
    write = table._write

    def interrupted(rows):
        monkeypatch.setattr(table, "_write", write)
        made = write(rows)
        table.apply(spark.createDataFrame([(1, "meanwhile", 8), (2, "two", 2)], SCHEMA), 3)
        return made

    monkeypatch.setattr(table, "_write", interrupted)
    table.compact(deltas=1)
    assert state(table) == {1: ("meanwhile", 8), 2: ("two", 2)}


def test_two_writers_never_share_a_version(spark, table):
    table.apply(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0, "s")
    with pytest.raises(upserts.Conflict):
        table._commit(0, {"kind": "delta", "stream": "x", "batch": 0, "data": "none", "buckets": [0]})
    assert state(table) == {1: ("a", 1)}


def test_empty_table_and_empty_batch(spark, table):
    assert state(table) == {} and table.compact() == [] and table.vacuum() == []
    assert table.apply(spark.createDataFrame([], SCHEMA), 0) and state(table) == {}
