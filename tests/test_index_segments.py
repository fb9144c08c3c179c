"""An index of segments against a fresh build after each change."""

import json
import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators.index_segments import Folder, SegmentedIndex
from verdigris.operators.lexical_index import build_index, open_index
from verdigris.streaming.incremental import index_arrivals

WORDS = "ore of the hill with a view from la mode".split()
SCHEMA = "id long, text string"


def some_text(rng):
    return rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))]) if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))


def shown(index):
    """All that searches read, in a fixed order."""
    postings = sorted((r.token, r.id, tuple(r.positions), r.tf, r.length) for r in index.postings.collect())
    total = index.totals.first()
    return postings, sorted(map(tuple, index.terms.select("token", "df", "tf").collect())), sorted(map(tuple, index.texts.select("id", "length").collect())), total.n, round(total.mean or 0, 9), round(total.mean_idf or 0, 9)


def fresh(spark, rows, path):
    build_index(spark.createDataFrame(rows, SCHEMA), "id", "text", path)
    return open_index(spark, path)


def test_updates_equal_fresh_builds(spark, tmp_path):
    rng, index = random.Random(9), SegmentedIndex(spark, str(tmp_path / "index"), most=3)
    texts = {i: some_text(rng) for i in range(60)}
    index.update(spark.createDataFrame(list(texts.items()), SCHEMA), "id")
    for turn in range(4):
        before = dict(texts)
        for i in rng.sample(sorted(texts), 12):
            if rng.random() < 0.4:
                del texts[i]
            else:
                texts[i] = some_text(rng)
        texts |= {100 * (turn + 1) + i: some_text(rng) for i in range(5)}
        told = index.update(spark.createDataFrame(list(texts.items()), SCHEMA), "id")
        same = lambda i: (before[i] or "") == (texts[i] or "")  # noqa: B023, E731
        changed = [i for i in texts if i in before and not same(i)]
        assert told == {"added": 5, "changed": len(changed), "removed": len(before.keys() - texts.keys())}
        # No unchanged text was tokenised: the commit's segment holds the new and changed texts alone.
        v = index.version()
        if len(v.segments) > 1 and v.segments[-1][2] < 50:
            assert v.segments[-1][2] in (5 + len(changed), *[s[2] for s in v.segments])
        assert len(v.segments) <= 3
        assert shown(index.open()) == shown(fresh(spark, list(texts.items()), str(tmp_path / f"fresh{turn}")))
    want = fresh(spark, list(texts.items()), str(tmp_path / "last"))
    for q in ("ore AND hill", "NOT ore", '"of the"', "with near/2 from"):
        assert sorted(index.open().matching(q).collect()) == sorted(want.matching(q).collect())
    shape = lambda rows: sorted((r.q, r["rank"], r.id, r.score) for r in rows.collect())
    assert shape(index.open().bm25({"a": ["ore", "la"], "b": ["zzz"]}, 7)) == shape(want.bm25({"a": ["ore", "la"], "b": ["zzz"]}, 7))
    index.merge(few=0)
    assert len(index.version().segments) == 1 and not index.version().graves and shown(index.open()) == shown(want)


def test_only_new_texts_are_tokenised(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    rows = [(i, f"text {i} of the hill") for i in range(30)]
    index.update(spark.createDataFrame(rows, SCHEMA), "id")
    assert index.update(spark.createDataFrame(rows, SCHEMA), "id") == {"added": 0, "changed": 0, "removed": 0}
    rows[3] = (3, "other")
    index.update(spark.createDataFrame(rows[:29] + [(99, "new")], SCHEMA), "id")
    v = index.version()
    last = spark.read.parquet(f"{index.folder.path}/{v.segments[-1][1]}/forward")
    assert sorted(r.id for r in last.collect()) == [3, 99]
    tokens = [n for n in index.folder.names() if n.startswith("segment")]
    assert len(tokens) == 2  # the update that changed nothing wrote none
    opened = index.open()
    plan = opened.of(["hill"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(token), EqualTo(token,hill)]") + plan.count("EqualTo(token,hill)") >= 2
    assert "regexp_extract_all" not in opened.bm25({"a": ["hill"]}, 3)._jdf.queryExecution().toString()


def test_versions_batches_and_vacuum(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        index.open()
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert index.apply(frame([(1, "a b"), (2, "b")]), None, "id", stream="s", batch=0)
    reader = index.open()
    assert not index.apply(frame([(1, "zzz")]), None, "id", stream="s", batch=0)  # delivered again
    assert index.apply(frame([(1, "c")]), frame([(2, "")]), "id", stream="s", batch=1)
    assert sorted(r.token for r in index.open().terms.collect()) == ["c"]
    assert sorted(r.token for r in reader.terms.collect()) == ["a", "b"]  # a reader keeps its version
    v = index.version()
    # Another commit that was faster: the slower one fails and what it wrote is no version's.
    folder = Folder(spark, index.folder.path)
    folder.publish(f"version-{v.number + 1:012d}.json", json.dumps({"number": v.number, "segments": v.segments, "graves": v.graves, "totals": v.totals, "batches": v.batches}))
    with pytest.raises(RuntimeError):
        index.apply(frame([(7, "lost")]), None, "id")
    assert sorted(r.id for r in index.open().texts.collect()) == [1]
    gone = index.vacuum(kept=1)
    assert gone and sorted(r.token for r in index.open().terms.collect()) == ["c"]


def test_an_empty_table_has_an_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.update(spark.createDataFrame([], SCHEMA), "id")
    assert index.open().totals.first().n == 0
    index.update(spark.createDataFrame([(1, "a"), (2, None)], SCHEMA), "id")
    index.update(spark.createDataFrame([], SCHEMA), "id")
    assert index.open().totals.first().n == 0 and index.open().terms.count() == 0


def test_streams_feed_the_index(spark, tmp_path):
    folder, index = tmp_path / "in", SegmentedIndex(spark, str(tmp_path / "index"))
    folder.mkdir()
    run = lambda: index_arrivals(spark, str(folder), "id long, text string, at long, gone boolean", index, str(tmp_path / "check"), "id", "text", "at", "gone").awaitTermination()
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in [{"id": 1, "text": "old", "at": 1, "gone": False}, {"id": 1, "text": "a b", "at": 2, "gone": False}, {"id": 2, "text": "b", "at": 1, "gone": False}]))
    run()
    (folder / "2.json").write_text(json.dumps({"id": 2, "text": None, "at": 3, "gone": True}))
    run()
    run()
    assert sorted(map(tuple, index.open().terms.select("token", "df").collect())) == [("a", 1), ("b", 1)]
    assert index.open().postings.agg(F.count("id")).first()[0] == 2


def test_the_first_update_joins_no_texts(spark, tmp_path, monkeypatch):
    plans, index = [], SegmentedIndex(spark, str(tmp_path / "index"))
    written = index._tokenised
    monkeypatch.setattr(index, "_tokenised", lambda folder, texts: (plans.append(texts._jdf.queryExecution().executedPlan().toString()), written(folder, texts))[1])
    rows = spark.createDataFrame([(i, f"ore {i}") for i in range(20)], SCHEMA)
    index.update(rows, "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.update(rows.where("id < 15").withColumn("text", F.when(F.col("id") == 3, "hill").otherwise(F.col("text"))), "id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plans[0]
    assert "SortMergeJoin" not in plans[1] and "ShuffledHashJoin" in plans[1]  # no text is sorted
    assert index.open().totals.first().n == 15


def test_terms_are_summed_from_ordered_postings(spark, tmp_path, monkeypatch):
    index, read = SegmentedIndex(spark, str(tmp_path / "index")), []
    table = index._table
    monkeypatch.setattr(index, "_table", lambda folder, name: (read.append(name), table(folder, name))[1])
    index.update(spark.createDataFrame([(1, "ore of ore"), (2, "of")], SCHEMA), "id")
    assert "postings" in read
    assert sorted(map(tuple, index.open().terms.select("token", "df", "tf").collect())) == [("of", 2, 2), ("ore", 1, 2)]
