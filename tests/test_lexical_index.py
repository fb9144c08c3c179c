"""The persisted index against scans of token arrays."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions.text import spaced_tokens
from verdigris.operators import lexical, lexical_index, ranking
from verdigris.operators.lexical_index import build_index, index_for, input_version, open_index, own_words, postings_of, postings_of_texts
from verdigris.plans.boolean_query import compile_query, matches_nothing_held, words_in

TEXTS = [
    "the ore of the hill", "of the", "the of", "", None, "ore ore ore of ore", "hill with a view of the ore", "À la carte, à la mode", "with x from", "from x y with",
    "with x y z from", *[f"filler {i % 7} words of the text {i}" for i in range(60)],
]
QUERIES = ["the AND ore", "ore OR carte", "the NOT ore", "NOT the", "NOT the AND filler OR ore", '"of the"', '"la mode" OR hill', "with near/2 from", "with near/3 from", "the near/0 the", "NOT zzz", "zzz", "", "NOT \"of the\" AND words", "3 near/9 text"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "t")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(texts):
    return index_for(texts, "doc_id")


@pytest.mark.parametrize("query", QUERIES)
def test_queries_match_a_scan(texts, index, query):
    want = lexical.with_tokens(texts).where(compile_query(query, F.col("tokens"))).select("doc_id").collect()
    assert sorted(r.id for r in index.matching(query).collect()) == sorted(r.doc_id for r in want)


@pytest.mark.parametrize("queries, k", [({"a": ["ore", "the", "ore"]}, 5), ({"a": ["hill"], "b": ["zzz"], "c": ["filler", "of"]}, 9), ({"a": ["carte"]}, 200), ({"a": []}, 3)])
def test_ranks_match_a_scan(texts, index, queries, k):
    shown = lambda rows: sorted((r.q, r["rank"], r.i, r.score) for r in rows)
    got = shown(index.bm25(queries, k).withColumnRenamed("id", "i").collect())
    assert got == shown(ranking.bm25_many(texts, queries, k, "doc_id").withColumnRenamed("doc_id", "i").collect())


def test_phrases_are_counted(texts, index):
    words = ["of", "the"]
    n = F.size(lexical.phrase_starts(F.col("tokens"), words))
    want = {r.doc_id: r.n for r in lexical.with_tokens(texts).select("doc_id", n.alias("n")).where("n > 0").collect()}
    assert {r.id: r.n for r in index.phrase_counts(words).collect()} == want


def test_searches_read_the_index_alone(spark, texts, index, tmp_path):
    plan = index.of(["ore"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "token" in plan.split("PushedFilters: [")[1].split("]")[0]
    for frame in (index.matching("the AND ore"), index.bm25({"a": ["ore"]}, 3), index.phrase_counts(["of", "the"])):
        assert "regexp_extract_all" not in frame._jdf.queryExecution().toString()  # no text is tokenised again
    build_index(texts, "doc_id", "text", str(tmp_path / "index"))
    assert sorted(open_index(spark, str(tmp_path / "index")).terms.collect()) == sorted(index.terms.collect())
    other = str(tmp_path / "other")
    texts.limit(5).write.parquet(other)
    assert input_version(spark.read.parquet(other)) != input_version(texts)
    assert index_for(spark.read.parquet(other).limit(0).where("false"), "doc_id").totals.first().n == 0


def test_a_build_shuffles_words_of_texts_not_places(spark, texts, tmp_path):
    own_words(texts.select(F.col("doc_id").alias("id"), "text")).write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    rows = postings_of(words)
    want = lexical.postings(texts, "doc_id").select("token", F.col("doc_id").alias("id"), "positions", "tf").collect()
    assert sorted(map(tuple, rows.select("token", "id", "positions", "tf").collect())) == sorted(map(tuple, want))
    assert words.count() == len(TEXTS)  # texts without words are there as well
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "collect_list" not in plan  # nothing is brought together after the shuffle


@pytest.mark.parametrize("block, batch", [(2, 7), (3, 10_000), (128, 1)])
def test_a_build_is_one_pass_without_a_sample(spark, texts, monkeypatch, block, batch):
    monkeypatch.setattr(lexical_index, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = postings_of_texts(texts.select(F.col("doc_id").alias("id"), "text"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "REBALANCE" in plan and "rangepartitioning" not in plan  # a range's bounds would take a pass of their own
        got = rows.collect()
        parts = rows.select("token", F.spark_partition_id().alias("p")).where("token IS NOT NULL").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = lexical.postings(texts, "doc_id").select("token", F.col("doc_id").alias("id"), "positions", "tf").collect()
    assert sorted((r.token, r.id, r.positions, r.tf) for r in got if r.token is not None) == sorted(map(tuple, want))
    lengths = {r.doc_id: len(r.tokens) for r in lexical.with_tokens(texts).collect()}
    assert {r.id: r.length for r in got if r.token is None} == lengths and sum(r.token is None for r in got) == len(TEXTS)
    assert all(r.length == lengths[r.id] for r in got)
    for p in {r.p for r in parts}:
        held = [r.token.encode() for r in parts if r.p == p]
        assert held == sorted(held)


def test_spaced_tokens_are_the_tokens(spark):
    odd = ["", None, " ", "  a  b ", "A_b-c\td\ne", "\u0130X \u01c5 \u00df", "x\u0301y \u00a0z\u200b9", "\u0663\u2167\u00bd \U0001d7d8\U0001f600b", "a\x00b", "...", "\u4e2d\u6587 \ud55c"]
    rows = spark.createDataFrame([(x,) for x in odd], "text string")
    for r in lexical.with_tokens(rows).withColumn("spaced", spaced_tokens(F.col("text"))).collect():
        assert (r.spaced.split(" ") if r.spaced else []) == r.tokens


def test_words_and_empty_matches():
    assert words_in('a AND "b c" NOT d near/3 e') == ["a", "b", "c", "d", "e"]
    assert matches_nothing_held("NOT a") and not matches_nothing_held("a NOT b") and not matches_nothing_held("")
