"""Bucketed tables: what is written, what readers see."""

import json

import pytest

from verdigris.sources.bucketed import BucketedTable
from verdigris.streaming.incremental import ingest_buckets

SCHEMA = "k int, v string, n int"


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_changes_write_touched_buckets_alone(spark, tmp_path):
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 16)
    with pytest.raises(ValueError):
        table.read()
    base = [(i, f"v{i}", i) for i in range(300)] + [(None, "no key", 0)]
    assert len(table.upsert(frame(base))) == 16
    first = table.version()
    reader = table.read()
    touched = table.upsert(frame([(7, None, 1), (999, "new", 2)]), ["v"])
    assert 1 <= len(touched) <= 2
    v = table.version()
    assert {b for b in v["parts"] if v["parts"][b] != first["parts"].get(b)} == {str(b) for b in touched}
    new = {p for p in v["parts"].values()} - set(first["parts"].values())
    assert len(new) == 1 and len(list((tmp_path / "t" / new.pop()).glob("bucket=*"))) == len(touched)  # no other file was written
    want = sorted([(i, f"v{i}", i) if i != 7 else (7, "v7", 1) for i in range(300)] + [(999, "new", 2)])
    assert sorted(tuple(r) for r in table.read().where("k IS NOT NULL").collect()) == want
    assert len(reader.collect()) == 301 and sorted(r.k for r in reader.collect() if r.k is not None) == list(range(300))  # the version that it opened
    assert table.delete(spark.createDataFrame([(i,) for i in range(300)], "k int").unionByName(spark.createDataFrame([(999,)], "k int")))
    assert [tuple(r) for r in table.read().collect()] == [(None, "no key", 0)]  # a null key is no key to delete by
    assert table.delete(spark.createDataFrame([], "k int")) == []
    gone = table.vacuum(kept=1)
    assert gone and table.read().count() == 1


def test_of_two_changes_the_slower_fails(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.upsert(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    seen = table.version()
    table.folder.publish("version-000000000002.json", json.dumps(seen | {"number": 2}))
    table.version = lambda: seen  # it read the table before the other's change
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(1, "lost", 1)], SCHEMA))
    assert rows(BucketedTable(spark, str(tmp_path / "t"), ["k"])) == [(1, "a", 1)]


def test_streams_and_repeated_deliveries(spark, tmp_path):
    inbox, table = tmp_path / "in", BucketedTable(spark, str(tmp_path / "t"), ["k"], 8)
    inbox.mkdir()
    run = lambda: ingest_buckets(spark, str(inbox), SCHEMA, table, str(tmp_path / "check"), "n").awaitTermination(120)
    (inbox / "1.json").write_text("\n".join(json.dumps(x) for x in [{"k": 1, "v": "a", "n": 1}, {"k": 1, "v": "b", "n": 2}, {"k": 2, "v": "c", "n": 1}]))
    run()
    (inbox / "2.json").write_text(json.dumps({"k": 2, "v": "d", "n": 2}))
    run()
    run()
    assert rows(table) == [(1, "b", 2), (2, "d", 2)] and table.version()["number"] == 2
    assert table.upsert(spark.createDataFrame([(9, "again", 1)], SCHEMA), stream=str(tmp_path / "check"), batch=1) == []
