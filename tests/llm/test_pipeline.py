"""The pipeline's rows against a brute-force version of all its stages, which shares no code with them."""

import collections
import random

import duckdb
import public_tokenizers
import tiktoken
from test_dedup import brute_classes

import corpus_pipeline
from verdigris.llm.bpe import load_ranks
from verdigris.llm.oracles import ORACLES


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(spark, rows, schema):
    """``row index: copies`` of the rows that languages accept: the greatest id of equal texts, the least of near ones, the mix."""
    best = {}
    for k, r in enumerate(rows):
        rank = (r.doc_id is not None, r.doc_id or 0, -k)
        best[lower(r.text)] = max(best.get(lower(r.text), (rank, k)), (rank, k))
    kept = sorted(k for _, k in best.values())
    classes = collections.defaultdict(list)
    for k, root in zip(kept, brute_classes([rows[k].text for k in kept]), strict=True):
        classes[root].append(k)
    left = [min(group, key=lambda k: (rows[k].doc_id is None, rows[k].doc_id or 0, k)) for group in classes.values()]
    frame = spark.createDataFrame([rows[k] for k in left], schema).toPandas()
    connection = duckdb.connect()
    connection.register("documents", frame)
    copies = connection.execute(f"SELECT doc_id, text, copies FROM (SELECT * FROM ({ORACLES['op10_source_mixing']}) x JOIN (SELECT doc_id AS i, text FROM documents) d ON x.doc_id IS NOT DISTINCT FROM d.i)").fetchall()
    return {(i, text): n for i, text, n in copies if n}


def check(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    accepted = corpus_pipeline.language(spark, docs, folder).collect()
    rows = docs.collect()
    lettered = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    assert len(accepted) >= 0.99 * len(lettered) and not collections.Counter(map(str, accepted)) - collections.Counter(map(str, lettered))
    want = expected(spark, accepted, docs.schema)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    made = collections.Counter()
    for (i, text), n in want.items():
        made[i, tuple(own.encode_ordinary(text or ""))] += n
    assert got == made


def test_pipeline_matches_brute_force(spark, data, tmp_path):
    check(spark, spark.read.parquet(f"{data}/documents.parquet"), str(tmp_path / "sf"))


def test_pipeline_takes_awkward_rows(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    rng = random.Random(2)
    some = docs.where("lang = 'en'").first()
    words = some.text.split()
    long = " ".join(rng.choice(words) for _ in range(100_000))
    rows = [(None, None, None, None), (None, "", "en", None), (501, "123 ?!", "en", "s"), (None, some.text, "en", None), (some.doc_id, some.text, "en", some.source), (some.doc_id, some.text, "en", some.source), (502, long, None, None), (None, long, "en", "s")]
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("doc_id", "text", "lang", "source", docs.n_chars.cast("long").alias("n_chars")).unionByName(more).withColumnRenamed("n_chars", "_row")
    check(spark, docs, str(tmp_path / "odd"))


def test_stages_take_empty_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(data))
        assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns), name


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).withColumnRenamed("n_chars", "_hash")
    for name, function in corpus_pipeline.STAGES[1:4]:
        assert function(spark, docs, str(data)).columns == docs.columns, name


def test_a_worker_keeps_tables_of_one_operator():
    """Workers serve all stages: what one stage keeps for its next task goes when another stage's work comes."""
    import public_tokenizers

    from verdigris.llm import bpe, near_dedup
    from verdigris.llm.language_id import CharModels, _Scorer

    class Shared:
        value = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    near_dedup.Sampler(3.0)
    assert near_dedup._parameters.cache_info().currsize == 1
    kept = bpe._bpe(Shared, public_tokenizers.PATTERN)
    assert near_dedup._parameters.cache_info().currsize == 0 and bpe._bpe(Shared, public_tokenizers.PATTERN) is kept
    _Scorer(CharModels([], []))
    assert not bpe._built
