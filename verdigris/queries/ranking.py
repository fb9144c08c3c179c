"""Queries over rankings: BM25, vectors, hybrid and fused lists, re-ranking, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import context
from verdigris.operators import ranking as R
from verdigris.operators.vector_index import usable, vector_index_for
from verdigris.queries._registry import query
from verdigris.queries.text import TOKENS, documents_index, updated_index

QUESTION = ["the", "that", "tion", "erth", "with", "the"]
MORE = {"q1": QUESTION, "q2": ["la", "pour", "vous"], "q3": ["und", "der", "lich"]}


def best(table, queries: dict[str, list[str]], k: int):
    """``q, doc_id, score, rank``: the best documents for each query, from the index."""
    return documents_index(table).bm25(queries, k).withColumnRenamed("id", "doc_id")


def best_one(table, k: int):
    return best(table, {"q": QUESTION}, k).select("doc_id", "score", "rank")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def bm25_sql(queries: dict[str, list[str]], k: int) -> str:
    """The common table ``bm`` (q, doc_id, score, rank) with the best ``k`` for each query."""
    asked = ", ".join(f"('{q}', '{t}')" for q, ts in queries.items() for t in ts)
    return f"""d AS (SELECT *, {TOKENS} AS t FROM documents),
    w AS (SELECT doc_id, unnest(t) AS token FROM d),
    f AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL),
    n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    v AS (SELECT token, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM f, n GROUP BY token, n.n),
    i AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM v) ELSE idf END AS idf FROM v),
    asked(q, token) AS (VALUES {asked}),
    s AS (SELECT q, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / n.mean))) AS score
          FROM asked JOIN f USING (token) JOIN i USING (token) JOIN d USING (doc_id), n GROUP BY q, doc_id),
    a AS (SELECT q.q, d.doc_id, round(coalesce(s.score, 0), 6) AS score FROM (SELECT DISTINCT q FROM asked) q CROSS JOIN d LEFT JOIN s ON s.q = q.q AND s.doc_id = d.doc_id),
    bm AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank FROM a QUALIFY rank <= {k})"""


@query(f"WITH {bm25_sql({'q1': QUESTION}, 10)} SELECT doc_id, score, rank FROM bm")
def bm25_topk(table, spark):
    """The ten best documents for a question by BM25."""
    return best_one(table, 10)


@query(f"WITH {bm25_sql(MORE, 5)} SELECT q, doc_id, score, rank FROM bm")
def bm25_multi_query(table, spark):
    """The five best documents for each of several questions."""
    return best(table, MORE, 5)


@query(f"WITH {bm25_sql(MORE, 5)} SELECT q, doc_id, score, rank FROM bm")
def updated_bm25(table, spark):
    """The same from an index that took in additions, changes and deletions: its segments' statistics are those of a fresh build."""
    return updated_index(table).bm25(MORE, 5).withColumnRenamed("id", "doc_id")


#: A question's vector: a fixed row's, read as one row.
ASKED = 7
VEC = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 7)"
COS = "(list_sum(list_transform(list_zip(v, qv), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(qv, lambda x: x * x)))))"
L2 = "sqrt(list_sum(list_transform(list_zip(v, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _asked(table) -> list[float]:
    return table("embeddings").where(F.col("vec_id") == ASKED).select("embedding").first()[0]


def vec_sql(measure: str, k: int) -> str:
    return f"{VEC}, vs AS (SELECT vec_id, round({measure}, 6) AS score, row_number() OVER (ORDER BY round({measure}, 6) DESC, vec_id)::INT AS rank FROM e, q QUALIFY rank <= {k})"


@query(f"WITH {vec_sql(COS, 10)} SELECT vec_id, score, rank FROM vs")
def vector_topk_cosine(table, spark):
    """The ten nearest vectors by cosine."""
    return R.vector_topk(table("embeddings"), _asked(table), 10, "vec_id", "embedding")


@query(f"WITH {vec_sql('0.0 - ' + L2, 10)} SELECT vec_id, score, rank FROM vs")
def vector_topk_l2(table, spark):
    """The ten nearest vectors by Euclidean distance."""
    return R.vector_topk(table("embeddings"), _asked(table), 10, "vec_id", "embedding", "l2")


#: Rows whose vectors ask the index.
ASKING = [3, 7, 11, 42]


def _asking(table) -> dict[str, list[float]]:
    return {str(r.vec_id): r.embedding for r in table("embeddings").where(F.col("vec_id").isin(ASKING)).select("vec_id", "embedding").collect()}


def vectors_index(table):
    """The stored index of all vectors: built over nine tenths, then it takes in the rest, forgets some and takes them in again."""
    rows = table("embeddings")
    index = vector_index_for(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(10)) > 0), "vec_id", "embedding", name="updated")
    if index.living().count() < rows.where(usable("embedding")).count():
        index.insert(rows, "vec_id", "embedding")
        index.delete(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(10)) == 3).select(F.col("vec_id").alias("id")))
        index.insert(rows, "vec_id", "embedding")
    return index


@query(
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id::VARCHAR AS q, v AS qv FROM e WHERE vec_id IN (3, 7, 11, 42)),
    s AS (SELECT q, vec_id, round({COS}, 6) AS score FROM e, q) SELECT q, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10"""
)
def vector_index_exact(table, spark):
    """The ten nearest to each of several vectors: the stored index with all its lists read, after insertions and deletions."""
    return vectors_index(table).search(_asking(table), 10, exact=True).withColumnRenamed("id", "vec_id")


@query()
def vector_index_search(table, spark):
    """The same from the nearest lists' codes and a shortlist, as the index is used; recall is measured in the tests."""
    return vectors_index(table).search(_asking(table), 10).withColumnRenamed("id", "vec_id")


@query(
    """SELECT doc_id, lang, round(CASE WHEN max(n_chars) OVER w = min(n_chars) OVER w THEN 1.0
    ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w)::DOUBLE END, 6) AS scaled FROM documents WINDOW w AS (PARTITION BY lang)"""
)
def minmax_normalize(table, spark):
    """Lengths scaled from 0 to 1 inside each language."""
    rows = R.minmax(table("documents").select("doc_id", "lang", "n_chars"), "n_chars", "scaled", ["lang"])
    return rows.select("doc_id", "lang", F.round("scaled", 6).alias("scaled"))


def _two_lists(table, n: int):
    semantic = R.vector_topk(table("embeddings"), _asked(table), n, "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    return semantic, best_one(table, n)


def hybrid_sql(n: int) -> str:
    scaled = "CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"
    return f"""{bm25_sql({"q1": QUESTION}, n)}, {vec_sql(COS, n)},
    a1 AS (SELECT vec_id AS doc_id, {scaled} AS s FROM vs), b1 AS (SELECT doc_id, {scaled} AS l FROM bm),
    h AS (SELECT coalesce(a1.doc_id, b1.doc_id) AS doc_id, round(0.7 * coalesce(s, 0) + 0.3 * coalesce(l, 0), 6) AS score FROM a1 FULL JOIN b1 ON a1.doc_id = b1.doc_id)"""


@query(f"WITH {hybrid_sql(20)} SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 20")
def hybrid_search(table, spark):
    """Vectors and BM25 in one list."""
    semantic, words = _two_lists(table, 20)
    return R.hybrid(semantic, words, "doc_id", 20)


@query(f"WITH {hybrid_sql(200)} SELECT doc_id, score FROM h WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY score DESC, doc_id LIMIT 20")
def hybrid_constrained(table, spark):
    """The same, restricted to some documents after wider lists were made."""
    semantic, words = _two_lists(table, 200)
    return R.hybrid(semantic, words, "doc_id", 20, allowed=table("documents").where("lang = 'en'"))


@query(f"WITH d AS (SELECT doc_id, len(list_intersect(list_distinct({TOKENS}), {_list(dict.fromkeys(QUESTION))}))::INT AS overlap FROM documents) SELECT doc_id, overlap FROM d WHERE overlap > 0 ORDER BY overlap DESC, doc_id LIMIT 20")
def overlap_fallback(table, spark):
    """Documents by the number of a question's words in them."""
    return R.overlap_ranking(table("documents"), QUESTION, 20, "doc_id")


@query(f"WITH {bm25_sql(MORE, 50)} SELECT doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM bm GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20")
def rrf_fusion(table, spark):
    """Three rankings fused by reciprocal ranks."""
    return R.reciprocal_rank_fusion([best(table, MORE, 50)], ["doc_id"], 20)  # a row for each query and document is all that it sums


@query(f"WITH {bm25_sql(MORE, 50)} SELECT source AS base, bm.doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM bm JOIN documents USING (doc_id) GROUP BY ALL ORDER BY score DESC, base, doc_id LIMIT 20")
def multi_base_rrf(table, spark):
    """The same over several bases: a document's base is part of its key."""
    rows = best(table, MORE, 50).join(table("documents").select("doc_id", F.col("source").alias("base")), "doc_id")
    return R.reciprocal_rank_fusion([rows], ["base", "doc_id"], 20)


@query(
    f"""WITH {bm25_sql({"q1": QUESTION}, 60)}, {VEC}, c AS (SELECT bm.doc_id, score, t, v FROM bm JOIN d USING (doc_id) JOIN e ON e.vec_id = bm.doc_id)
    SELECT doc_id, round(0.7 * {COS} + 0.3 * len(list_intersect(list_distinct(t), ['that', 'tion', 'erth', 'with'])) / 4.0 + 0.1 * score, 6) AS score FROM c, q ORDER BY score DESC, doc_id LIMIT 20"""
)
def rerank_local(table, spark):
    """Sixty candidates ranked anew by vector, words and their score."""
    # Sixty rows: neither texts nor vectors are shuffled to meet them.
    few = best_one(table, 60).select("doc_id", "score")
    docs = table("documents").select("doc_id", "text").join(F.broadcast(few), "doc_id")
    rows = table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(F.broadcast(docs), "doc_id")
    return R.rerank_local(rows, QUESTION, _asked(table), 20, "doc_id", "text", "embedding")


#: Orders as records with a domain: relation by status, area and family by priority.
DOMAIN_SQL = """o AS (SELECT o_orderkey, o_totalprice / 1000000 AS base,
    CASE o_orderstatus WHEN 'F' THEN 'indireta' WHEN 'P' THEN 'sem_relacao_identificada' ELSE '' END AS relation,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'minerario' ELSE '' END AS area,
    CASE WHEN o_orderpriority LIKE '2%' THEN 'garimpo_plg' WHEN o_orderpriority LIKE '3%' THEN 'ambiental_mineracao' ELSE 'contexto' END AS family,
    o_orderstatus = 'P' AND o_orderpriority LIKE '5%' AS main FROM orders),
    c AS (SELECT *, CASE WHEN main OR relation = 'direta' THEN 'principal' WHEN relation IN ('indireta', 'referenciada') OR family NOT IN ('', 'nao_classificada', 'contexto') OR area = 'minerario' THEN 'apoio' ELSE 'contexto' END AS category FROM o),
    b AS (SELECT *, greatest(0.75, least(1.55, CASE category WHEN 'principal' THEN 1.28 WHEN 'apoio' THEN 1.08 ELSE 0.90 END + CASE WHEN area = 'minerario' THEN 0.08 ELSE 0 END
    + CASE WHEN family = 'garimpo_plg' THEN 0.08 ELSE 0 END + CASE WHEN family = 'ambiental_mineracao' THEN 0.04 ELSE 0 END - CASE WHEN relation = 'sem_relacao_identificada' THEN 0.06 ELSE 0 END)) AS factor FROM c)"""


def _domain(table):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    relation = F.when(status == "F", "indireta").when(status == "P", "sem_relacao_identificada").otherwise("")
    area = F.when(priority.startswith("1"), "minerario").otherwise("")
    family = F.when(priority.startswith("2"), "garimpo_plg").when(priority.startswith("3"), "ambiental_mineracao").otherwise("contexto")
    main = (status == "P") & priority.startswith("5")
    rows = table("orders").select("o_orderkey", (F.col("o_totalprice") / 1000000).alias("base"), relation.alias("relation"), area.alias("area"), family.alias("family"), main.alias("main"))
    columns = [F.col(c) for c in ("relation", "family", "area", "main")]
    return rows.withColumn("category", R.domain_category(*columns)).withColumn("factor", R.domain_factor(*columns, True))


@query(f"WITH {DOMAIN_SQL} SELECT o_orderkey, category, round(factor::DOUBLE, 4) AS factor, round(base * factor::DOUBLE, 4) AS score FROM b")
def domain_boost(table, spark):
    """Scores raised and lowered by a record's domain."""
    return _domain(table).select("o_orderkey", "category", F.round("factor", 4).alias("factor"), F.round(F.col("base") * F.col("factor"), 4).alias("score"))


@query(
    f"""WITH {DOMAIN_SQL}, s AS (SELECT o_orderkey, category, round(base * factor::DOUBLE, 6) AS score FROM b),
    top AS (SELECT o_orderkey, score, row_number() OVER (ORDER BY score DESC, o_orderkey) AS place FROM s WHERE category <> 'principal' QUALIFY place <= 10),
    extra AS (SELECT o_orderkey, score, row_number() OVER (ORDER BY score DESC, o_orderkey) AS place FROM s WHERE category = 'principal' QUALIFY place <= 2),
    u AS (SELECT o_orderkey, score, place FROM top WHERE place <= 8 UNION ALL SELECT o_orderkey, score, place + 10 FROM extra)
    SELECT o_orderkey, score, row_number() OVER (ORDER BY place)::INT AS rank FROM u"""
)
def coverage_reserve(table, spark):
    """A list without the main category gives its last places to it."""
    rows = _domain(table).select("o_orderkey", "category", F.round(F.col("base") * F.col("factor"), 6).alias("score"))
    return R.reserve_coverage(rows.where("category <> 'principal'"), rows, 10, "o_orderkey", F.col("category") == "principal")


@query(
    f"""WITH {bm25_sql(MORE, 100)}, c AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, max(score) OVER (PARTITION BY q) AS head FROM bm)
    SELECT q, doc_id, score, rank FROM c WHERE rank <= 20 AND (rank = 1 OR score - 0.3 * head > -1)"""
)
def mmr_select(table, spark):
    """Candidates of each language in an order that spreads their scores."""
    rows = best(table, MORE, 100).select("q", "doc_id", "score")
    return R.mmr(rows, 20, "doc_id", "q")


@query(
    f"""WITH {bm25_sql({"q1": QUESTION}, 40)}, r AS (SELECT bm.doc_id, rank, score, source, n_chars FROM bm JOIN documents USING (doc_id))
    SELECT source, min(rank)::INT AS first_rank, max(score) AS best, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS pages FROM r WHERE rank <= 12 GROUP BY source"""
)
def cited_docs(table, spark):
    """What the twelve best rows cite: sources in order, with their rows."""
    rows = best_one(table, 40).join(table("documents").select("doc_id", "source"), "doc_id")
    return context.cited_documents(rows, "source", "doc_id", "rank", "score")


@query(
    f"""WITH RECURSIVE {bm25_sql({"q1": QUESTION}, 40)}, r AS (SELECT bm.doc_id, rank, source, n_chars, count(*) OVER () AS n FROM bm JOIN documents USING (doc_id)),
    z AS (SELECT *, CASE WHEN 2 * rank <= n + 1 THEN 2 * rank - 1 ELSE 2 * (n - rank + 1) END AS z FROM r),
    k AS (SELECT *, min(z) OVER (PARTITION BY source) AS seen FROM z QUALIFY row_number() OVER (PARTITION BY source ORDER BY z) <= 4),
    l AS (SELECT *, row_number() OVER (ORDER BY seen, z) AS i FROM k),
    step(i, used, seen, shut, fits) AS (SELECT 0::BIGINT, 0::BIGINT, -1::BIGINT, FALSE, FALSE UNION ALL
      SELECT j, (CASE WHEN NOT sh AND u + s <= 20000 THEN u + s ELSE u END)::BIGINT, d::BIGINT, sh OR u + s > 20000, NOT sh AND u + s <= 20000 FROM
        (SELECT l.i AS j, l.n_chars AS s, l.seen AS d, CASE WHEN l.seen <> step.seen AND used + 40 <= 20000 THEN used + 40 ELSE used END AS u,
          CASE WHEN l.seen <> step.seen THEN used + 40 > 20000 ELSE shut END AS sh FROM step JOIN l ON l.i = step.i + 1))
    SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS place, rank, doc_id, source, n_chars FROM step JOIN l USING (i) WHERE fits"""
)
def context_pack(table, spark):
    """The rows of a ranked list that fit a context of 20,000 characters."""
    rows = best_one(table, 40).join(table("documents").select("doc_id", "source", "n_chars"), "doc_id")
    return context.pack_context(rows, "source", "rank", F.col("n_chars"), 20_000).select("place", "rank", "doc_id", "source", "n_chars")


@query()
def ask_extractive(table, spark):
    """A whole question: search, fusion, diversification, packing, evidence."""
    from verdigris.plans.pipeline import ask

    return ask(table("documents"), "that thorha with the erth", "doc_id", "source", "text", index=documents_index(table))
