"""Searches by the index of names against scores of every name."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import registry
from verdigris.operators.name_index import begins, name_index_for, upper_bound
from verdigris.plans.registry_answers import answer, understand

WORDS = ["mineracao", "Mineração", "min", "ouro", "OURO", "our", "verde", "sa", "ltda", "do", "a1", "z", "ura", "pedra", "pedras", "q-x"]


@pytest.fixture(scope="module")
def companies(spark, tmp_path_factory):
    rng = random.Random(7)
    names = [None, "", "ltda sa", "ouro", "min ouro", *[" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(300)]]
    path = str(tmp_path_factory.mktemp("names") / "t")
    spark.createDataFrame([(f"{i:08d}", n) for i, n in enumerate(names)], "cnpj_basico string, razao_social string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("query", [["mine"], ["min", "our"], ["ura"], ["r"], ["our"], ["o"], ["pedrasx"], ["ro", "verd"], ["zz"], [], ["x"], ["ouro", "verde", "pedra"], ["ouro", "ouro"]])
def test_searches_equal_scores_of_all(companies, query):
    index = name_index_for(companies, "cnpj_basico", "razao_social")
    want = registry.name_search(companies, query, F.col("razao_social"), 1000, "cnpj_basico").select("cnpj_basico", "match").collect()
    assert [tuple(r) for r in index.search(query, 1000).collect()] == [tuple(r) for r in want]


def test_ranges_and_intersections(companies):
    index = name_index_for(companies, "cnpj_basico", "razao_social")
    tokens = {r.id: r.tokens for r in index.names.collect()}
    for words in (["min"], ["our", "p"], ["z", "a1", "verde"], ["none"]):
        want = {i for i, t in tokens.items() if all(any(c.startswith(w) for c in t) for w in words)}
        assert {r.id for r in index.with_all(words).collect()} == want
    assert {r.id for r in index.with_prefix("pedras").collect()} == {i for i, t in tokens.items() if any(c.startswith("pedras") for c in t)}
    plan = index.with_prefix("pedr")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,pedr)" in plan and "(token#" in plan and "< peds)" in plan
    for frame in (index.search(["pedr"], 5), index.with_all(["our", "p"])):
        assert "token" in frame._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1] and "regexp_extract_all" not in frame._jdf.queryExecution().toString()


def test_upper_bounds(spark):
    assert upper_bound("ab") == "ac" and upper_bound("a\U0010ffff") == "b" and upper_bound("\U0010ffff") is None
    rows = spark.createDataFrame([("a",), ("ab",), ("abz",), ("ac",), ("b",)], "t string")
    assert [r.t for r in rows.where(begins("t", "ab")).collect()] == ["ab", "abz"] and rows.where(begins("t", "")).count() == 5


def test_answers_use_the_index(spark, companies):
    empty = spark.createDataFrame([], "cnpj_cpf_do_socio string, nome_socio string, cnpj_basico string")
    index = name_index_for(companies, "cnpj_basico", "razao_social")
    question = understand('"pedras verde"')
    plain = answer(question, companies, None, empty, None, 7).select("cnpj_basico").collect()
    assert plain and sorted(plain) == sorted(answer(question, companies, None, empty, None, 7, index).select("cnpj_basico").collect())
