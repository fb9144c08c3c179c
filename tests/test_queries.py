"""Every registered query of the engine itself against its SQL in DuckDB; the others by what must hold for their rows."""

import duckdb
import pytest

from verdigris import catalogue

NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for path in data.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def shown(rows, columns):
    return sorted(repr([round(v, 6) + 0.0 if isinstance(v, float) else v for v in (row[c] for c in columns)]) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, sql, name):
    frame = catalogue.QUERIES[name](spark, str(data))
    rows, columns = [r.asDict() for r in frame.collect()], sorted(frame.columns)
    if name not in catalogue.ORACLES:
        assert rows
        return
    cursor = sql.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(names) == columns
    assert shown(rows, columns) == shown(want, columns)


def test_plans_push_down_and_stay_in_the_jvm(spark, data):
    plan = catalogue.QUERIES["registry_point_lookup"](spark, str(data))._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,37)" in plan and "EqualTo(o_custkey,37)" in plan
    for name in ("bm25_topk", "boolean_and", "phrase_search", "status_in_period", "name_match_score"):
        text = catalogue.QUERIES[name](spark, str(data))._jdf.queryExecution().toString()
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_reranking_brings_texts_to_sixty_rows(spark, data):
    from verdigris import catalogue

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["rerank_local"](spark, str(data))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # neither texts nor vectors are shuffled
