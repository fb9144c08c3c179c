"""BM25, normalised scores, hybrid and fused rankings, re-ranking, diversification."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.lexical import occurrences, with_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25_weights(texts: DataFrame, terms: list[str], text_col: str = "text") -> tuple[dict[str, float], float]:
    """IDF of each term that occurs, and the mean number of tokens.

    One pass counts the query's terms only. A term in more than half of the texts has a negative IDF, which becomes a
    share of the vocabulary's mean; only then are all tokens counted.
    """
    words = with_tokens(texts, text_col).select("tokens")
    counts = [F.count_if(F.array_contains("tokens", t)).alias(f"n{i}") for i, t in enumerate(terms)]
    row = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean"), *counts).first()
    idf = {t: math.log(row.n - row[f"n{i}"] + 0.5) - math.log(row[f"n{i}"] + 0.5) for i, t in enumerate(terms) if row[f"n{i}"]}
    if any(v < 0 for v in idf.values()):
        df = words.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").count()
        one = F.log(row.n - F.col("count") + 0.5) - F.log(F.col("count") + 0.5)
        low = EPSILON * df.agg(F.avg(one)).first()[0]
        idf = {t: v if v >= 0 else low for t, v in idf.items()}
    return idf, row.mean or 0.0


def bm25_score(query: list[str], idf: dict[str, float], mean: float, tokens: Column) -> Column:
    """A text's BM25 score; a term that the query repeats counts as often."""
    long = K1 * (1 - B + B * F.size(tokens) / (mean or 1.0))
    parts = []
    for term in dict.fromkeys(query):
        if term in idf:
            tf = occurrences(tokens, term)
            parts.append(query.count(term) * idf[term] * tf * (K1 + 1) / (tf + long))
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def bm25_topk(texts: DataFrame, query: list[str], k: int, id_col: str, text_col: str = "text") -> DataFrame:
    """``id, score, rank`` of the ``k`` best texts; ties keep the order of the ids. A scan and a bounded sort."""
    idf, mean = bm25_weights(texts, list(dict.fromkeys(query)), text_col)
    scored = with_tokens(texts, text_col).select(id_col, F.round(bm25_score(query, idf, mean, F.col("tokens")), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def bm25_many(texts: DataFrame, queries: dict[str, list[str]], k: int, id_col: str, text_col: str = "text") -> DataFrame:
    """``q, id, score, rank`` for several queries in one scan; each keeps its ``k`` best by a window group limit."""
    idf, mean = bm25_weights(texts, list(dict.fromkeys(t for q in queries.values() for t in q)), text_col)
    entries = [F.struct(F.lit(q).alias("q"), F.round(bm25_score(ts, idf, mean, F.col("tokens")), 6).alias("score")) for q, ts in queries.items()]
    rows = with_tokens(texts, text_col).select(id_col, F.explode(F.array(*entries)).alias("e")).select("e.q", id_col, "e.score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), id_col)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_topk(rows: DataFrame, query: list[float], k: int, id_col: str, vector_col: str, measure: str = "cosine") -> DataFrame:
    """Exact nearest rows to one query vector: a scan and a bounded sort."""
    score = cosine(F.col(vector_col), vector(query)) if measure == "cosine" else 0.0 - l2(F.col(vector_col), vector(query))
    best = rows.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def minmax(rows: DataFrame, score_col: str, name: str, partition: list[str] | None = None) -> DataFrame:
    """Scores from 0 to 1 inside each partition; 1 where all are equal. Joined from an aggregate: no window holds the rows."""
    ends = [F.min(score_col).alias("_low"), F.max(score_col).alias("_high")]
    # Without a partition the ends are one row.
    joined = rows.join(rows.groupBy(*partition).agg(*ends), partition) if partition else rows.crossJoin(F.broadcast(rows.agg(*ends)))
    even = F.when(F.col("_high") == F.col("_low"), 1.0).otherwise((F.col(score_col) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return joined.withColumn(name, even).drop("_low", "_high")


def normal_weights(alpha: float, beta: float) -> tuple[float, float]:
    """Weights cut to 0..1 that sum to 1; 0.7 and 0.3 if both are 0."""
    alpha, beta = min(max(alpha, 0.0), 1.0), min(max(beta, 0.0), 1.0)
    return (alpha / (alpha + beta), beta / (alpha + beta)) if alpha + beta else (0.7, 0.3)


def weight_profiles(alpha: float, beta: float, count: int) -> list[tuple[float, float]]:
    """The base weights, and with 2 or 3 profiles a shift of 0.2 to the lexical and to the semantic side."""
    base = normal_weights(alpha, beta)
    shifts = [0.0, -0.2, 0.2][: max(1, count)]
    made = [normal_weights(base[0] + s, base[1] - s) if s else base for s in shifts]
    return list({(round(a, 4), round(b, 4)): (a, b) for a, b in reversed(made)}.values())[::-1]


def hybrid(semantic: DataFrame, lexical: DataFrame, id_col: str, k: int, alpha: float = 0.7, beta: float = 0.3, allowed: DataFrame | None = None) -> DataFrame:
    """Two top lists (``id, score``) in one: each min-max normalised, a missing side counts 0, then weighted.

    ``allowed`` (ids) restricts after normalisation, so a restriction does not change the scores of what it keeps.
    """
    alpha, beta = normal_weights(alpha, beta)
    left = minmax(semantic.select(id_col, "score"), "score", "semantic").drop("score")
    right = minmax(lexical.select(id_col, "score"), "score", "lexical").drop("score")
    both = left.join(right, id_col, "full_outer").fillna(0.0, ["semantic", "lexical"])
    if allowed is not None:
        both = both.join(allowed.select(id_col), id_col, "left_semi")
    scored = both.withColumn("score", F.round(alpha * F.col("semantic") + beta * F.col("lexical"), 6))
    return scored.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(k)


def allowed_by(constraints: list[DataFrame | None], key: str) -> DataFrame | None:
    """The ids that any of the constraints allows; None (no constraint) if all are None. One without rows allows nothing by itself."""
    given = [c.select(key) for c in constraints if c is not None]
    return reduce(DataFrame.unionByName, given).distinct() if given else None


def overlap_ranking(texts: DataFrame, query: list[str], k: int, id_col: str, text_col: str = "text") -> DataFrame:
    """Texts by the number of distinct query words that they hold: what is left when a restricted search finds nothing."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(query)])
    rows = with_tokens(texts, text_col).select(id_col, F.size(F.array_intersect("tokens", words)).alias("overlap"))
    return rows.where("overlap > 0").orderBy(F.desc("overlap"), id_col).limit(k)


def reciprocal_rank_fusion(lists: list[DataFrame], key: list[str], k: int, constant: int = 60, offset: int = 1) -> DataFrame:
    """Ranked lists (``rank`` from 1) in one: sums of 1 / (constant + rank - 1 + offset)."""
    rows = reduce(DataFrame.unionByName, [x.select(*key, "rank") for x in lists])
    fused = rows.groupBy(*key).agg(F.round(F.sum(1 / (constant + F.col("rank") - 1 + offset)), 8).alias("score"))
    return fused.orderBy(F.desc("score"), *key).limit(k)


def lexical_overlap(query: list[str], tokens: Column) -> Column:
    """Share of the query's words of more than three characters that a text holds; 0 if there are none."""
    words = [w for w in dict.fromkeys(query) if len(w) > 3]
    if not words:
        return F.lit(0.0)
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))) / float(len(words))


def rerank_local(rows: DataFrame, query: list[str], query_vector: list[float], k: int, id_col: str, text_col: str, vector_col: str, weights=(0.7, 0.3, 0.1)) -> DataFrame:
    """Candidates (with ``score``) by cosine, word overlap and their incoming score."""
    a, b, c = weights
    value = a * cosine(F.col(vector_col), vector(query_vector)) + b * lexical_overlap(query, F.col("tokens")) + c * F.col("score")
    scored = with_tokens(rows, text_col).select(id_col, F.round(value, 6).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


#: Fields that go before a text to a re-ranking service.
RERANK_FIELDS = (
    "doc", "doc_name", "page", "titulo", "titulo_norma", "tipo_norma", "numero_norma", "ano_norma", "status_normativo", "data_inicio_vigencia", "data_fim_vigencia",
    "revogado_por", "relacao_com_mineracao", "area_juridica_principal", "familia_normativa_mineraria", "usar_como_fundamento_principal",
)


def rerank_text(columns: list[str], text_col: str = "text") -> Column:
    """A record as a re-ranking service reads it: ``field: value`` of the filled fields that the table has, a blank line, its text."""
    filled = [F.when(F.col(f"`{f}`").cast("string") != "", F.concat(F.lit(f"{f}: "), F.col(f"`{f}`").cast("string"))) for f in RERANK_FIELDS if f in columns]
    head = F.concat_ws("\n", *filled) if filled else F.lit("")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.when(head != "", F.concat(head, F.lit("\n\n"), text)).otherwise(text)


def blended(ranked: DataFrame, answers: DataFrame, k: int, id_col: str, keep: float = 0.1) -> DataFrame:
    """A service's scores (``id, score``) with a share of the old ones; rows that it left out follow in their old order."""
    rows = ranked.select(id_col, F.col("score").alias("_old"), "rank").join(answers.select(id_col, F.col("score").alias("_new")), id_col, "left")
    order = Window.orderBy(F.col("_new").isNull(), F.desc(F.col("_new") + keep * F.col("_old")), "rank")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select(id_col, F.coalesce(F.round(F.col("_new") + keep * F.col("_old"), 6), "_old").alias("score"), F.col("_n").alias("rank"))


def rerank_or_keep(ranked: DataFrame, rerank, k: int) -> tuple[DataFrame, str | None]:
    """The re-ranked list, or the best ``k`` as they were and why: a service that fails leaves the order alone."""
    try:
        return rerank(ranked), None
    except Exception as error:  # whatever a service raises
        return ranked.where(F.col("rank") <= k), f"{type(error).__name__}: {error}"


#: Families of records that raise a score more and less.
CORE_FAMILIES = ("regimes_de_aproveitamento", "garimpo_plg", "fiscalizacao_sancoes_minerarias", "barragens_rejeitos_seguranca", "mineracao_geral")
SIDE_FAMILIES = ("cfem_tah_arrecadacao", "ambiental_mineracao", "seguranca_saude_ocupacional_mineracao")
#: Factor by category, for questions with and without the domain's terms; bounds.
CATEGORY_FACTORS = {"principal": (1.28, 1.05), "apoio": (1.08, 1.00), "contexto": (0.90, 0.99)}
LEAST, MOST = 0.75, 1.55


def domain_category(relation: Column, family: Column, area: Column, main: Column) -> Column:
    blank = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    support = blank(relation).isin("indireta", "referenciada") | ~blank(family).isin("", "nao_classificada", "contexto") | (blank(area) == "minerario")
    return F.when(F.coalesce(main, F.lit(False)) | (blank(relation) == "direta"), "principal").when(support, "apoio").otherwise("contexto")


def domain_factor(relation: Column, family: Column, area: Column, main: Column, has_terms: bool) -> Column:
    """The factor by which a record's domain raises or lowers its score."""
    category = domain_category(relation, family, area, main)
    factor = F.lit(CATEGORY_FACTORS["contexto"][not has_terms])
    for name in ("principal", "apoio"):
        factor = F.when(category == name, CATEGORY_FACTORS[name][not has_terms]).otherwise(factor)
    extra = (
        F.when(F.lower(area) == "minerario", 0.08).otherwise(0.0)
        + F.when(F.lower(family).isin(list(CORE_FAMILIES)), 0.08).otherwise(0.0)
        + F.when(F.lower(family).isin(list(SIDE_FAMILIES)), 0.04).otherwise(0.0)
        - F.when(F.lower(relation) == "sem_relacao_identificada", 0.06).otherwise(0.0)
    )
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), factor + extra))


def reserve_coverage(ranked: DataFrame, pool: DataFrame, k: int, id_col: str, wanted: Column) -> DataFrame:
    """``ranked`` (``id, score``), whose last places go to the pool's best wanted rows if it has none of its own.

    Both are short lists; the reserve is a fifth of ``k``, 1 to 3 places.
    """
    reserve = max(1, min(3, k // 5))
    order = lambda: Window.orderBy(F.desc("score"), id_col)
    top = ranked.withColumn("place", F.row_number().over(order())).where(F.col("place") <= k)
    extra = pool.where(wanted).join(top.select(id_col), id_col, "left_anti").withColumn("place", F.row_number().over(order()))
    extra = extra.where(F.col("place") <= reserve).withColumn("place", F.col("place") + k)
    rows = top.withColumn("own", F.lit(True)).unionByName(extra.withColumn("own", F.lit(False)), allowMissingColumns=True)
    whole = Window.partitionBy()  # k rows and the reserve
    count, covered = F.count_if(~F.col("own")).over(whole), F.bool_or(F.col("own") & wanted).over(whole)
    keep = F.when(covered | (count == 0), F.col("own")).otherwise(~F.col("own") | (F.col("place") <= k - reserve))
    rows = rows.withColumn("keep", keep).where("keep").withColumn("rank", F.row_number().over(Window.orderBy("place")))
    return rows.where(F.col("rank") <= k).select(id_col, "score", "rank")


def mmr(ranked: DataFrame, k: int, id_col: str, group: str | None = None, keep: float = 0.7) -> DataFrame:
    """Diversified lists, ``[group,] id, score, rank``: the head, then again and again what has the greatest ``keep`` times its score less the
    rest times its largest distance from the chosen, as long as that is above -1.

    The head has the greatest score, so the largest distance is always that from the head, and the value is the score less
    ``1 - keep`` times the head's: it grows with the score. So the order is that of the scores (ties by id), and the floor is one
    comparison with the head's. A window group limit keeps ``k`` rows of each list, however long it is.
    """
    rows = ranked.select(*([group] if group else []), id_col, F.col("score").cast("double").alias("score"))
    order = [F.desc("score"), F.col(id_col)]
    whole = Window.partitionBy(*([group] if group else []))
    best = rows if group else rows.orderBy(*order).limit(k)
    best = best.withColumn("rank", F.row_number().over(whole.orderBy(*order))).where(F.col("rank") <= k)
    value = F.col("score") - (1 - keep) * F.max("score").over(whole)
    return best.withColumn("_value", value).where((F.col("rank") == 1) | (F.col("_value") > -1)).drop("_value")


def first_of_each(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
