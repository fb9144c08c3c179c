"""The stored vector index against exact searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import ranking
from verdigris.operators.vector_index import VectorIndex, vector_index_for

SCHEMA = "id long, v array<float>"


def made(kind, n=3000, width=22, seed=1):
    draw = np.random.default_rng(seed)
    if kind == "even":
        return draw.normal(size=(n, width))
    centres = draw.normal(size=(40, width))
    return centres[draw.integers(0, 40, n)] + 0.25 * draw.normal(size=(n, width))


def nearest(x, q, k):
    score = (x @ q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return set(np.argsort(-score, kind="stable")[:k].tolist())


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall_and_pruned_lists(spark, tmp_path, kind):
    x = made(kind).astype(np.float32)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "id", "v")
    _, probes, shortlist = index.settings()
    asked = made(kind, 40, seed=2)[:40] if kind == "even" else x[::80] + 0.05 * np.random.default_rng(3).normal(size=(38, x.shape[1]))
    found = index.search({str(i): q.tolist() for i, q in enumerate(asked)}, 10).collect()
    got = {}
    for r in found:
        got.setdefault(int(r.q), set()).add(r.id)
    recall = np.mean([len(got[i] & nearest(x.astype(float), q, 10)) / 10 for i, q in enumerate(asked)])
    print(kind, "probes", probes, "shortlist", shortlist, "recall", recall)
    assert recall >= 0.9 and all(len(s) == 10 for s in got.values())
    lists = len(index.settings()[0].centroids)
    if kind == "clustered":
        assert probes <= lists // 4 and shortlist <= 300
        one = index.search({"a": x[0].tolist()}, 10)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1]
        assert "ReadSchema: struct<id:bigint,codes:binary>" in plan  # the first read has no vectors


def test_exact_setting_inserts_and_deletes(spark, tmp_path):
    x = made("clustered", 300).astype(np.float32)
    frame = lambda ids: spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(frame(range(200)), "id", "v")
    index.insert(frame(range(150, 300)), "id", "v")
    assert index.living().count() == 300  # ids that were there stay as they were
    index.delete(spark.createDataFrame([(7,), (250,), (999,)], "id long"))
    assert {r.id for r in index.search({"a": x[7].tolist()}, 300, exact=True).collect()} == set(range(300)) - {7, 250}
    index.insert(frame([7]), "id", "v")
    index.delete(spark.createDataFrame([(8,)], "id long"))
    got = index.search({"a": x[7].tolist(), "b": x[8].tolist()}, 5, exact=True)
    alive = frame(sorted(set(range(300)) - {8, 250}))
    for q, i in (("a", 7), ("b", 8)):
        want = ranking.vector_topk(alive, x[i].tolist(), 5, "id", "v").orderBy("rank").collect()
        assert [(r.id, r.score) for r in got.where(F.col("q") == q).orderBy("rank").collect()] == [(r.id, r.score) for r in want]
        assert [r.id for r in index.search({q: x[i].tolist()}, 5, probes=10**6, shortlist=300).orderBy("rank").collect()] == [r.id for r in want]


def test_awkward_tables(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "empty"))
    index.build(spark.createDataFrame([], SCHEMA), "id", "v")
    assert index.search({"a": [1.0, 0.0]}, 3).count() == 0 and index.search({"a": [1.0, 0.0]}, 3, exact=True).count() == 0
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0])]
    few = VectorIndex(spark, str(tmp_path / "few"))
    few.build(spark.createDataFrame(rows, SCHEMA), "id", "v")
    assert [(r.id, r.rank) for r in few.search({"a": [2.0, 0.0]}, 9).collect()] == [(1, 1), (7, 2)]


def test_one_index_for_each_version(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], SCHEMA).write.parquet(path)
    first, again = (vector_index_for(spark.read.parquet(path), "id", "v", str(tmp_path)) for _ in range(2))
    assert first.path == again.path and again.built
