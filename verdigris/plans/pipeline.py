"""Question answering over a corpus as one plan: intent, searches, fusion, domain, validity, diversification, packing, evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators import context, evidence, temporal
from verdigris.operators import ranking as R
from verdigris.operators.lexical_index import LexicalIndex
from verdigris.operators.vector_index import VectorIndex
from verdigris.plans import intent as intents
from verdigris.plans.boolean_query import words_of
from verdigris.plans.questions import domain_intent, expand, profile_of, unique_fold
from verdigris.plans.routing import decompose, tune, variants

#: Pool of fused rows from which validity and domain choose, as a multiple of the places to fill.
POOL = 4


@dataclass(frozen=True)
class ActColumns:
    """Columns of a record's validity: dates, canonical status, whether it is an act, the id of its revoker."""

    start: str = "start"
    end: str = "end"
    status: str = "status"
    normative: str = "normative"
    revoked_by: str = "revoked_by"
    title: str | None = None

    def active(self, first: date, last: date) -> Column:
        return temporal.active_in(F.col(self.start), F.col(self.end), F.col(self.status), F.lit(first), F.lit(last), F.col(self.normative))

    def label(self, first: date, last: date) -> Column:
        return temporal.status_in(F.col(self.start), F.col(self.end), F.col(self.status), F.lit(first), F.lit(last))


@dataclass(frozen=True)
class DomainColumns:
    """Columns of a record's domain, and the words by which a question shows that it is about it."""

    relation: str
    family: str
    area: str
    main: str
    terms: tuple[str, ...] = ()
    broad: tuple[str, ...] = ()


def asked_queries(question: str, settings: dict, profiles: list = ()) -> list[str]:
    """The question, its parts, its variants, its expansion and its profile's searches, each once, as many as the settings allow."""
    profile = profile_of(question, list(profiles))
    made = [question, *decompose(question), *variants(question), expand(question), *(profile.searches if profile else ())]
    return [q for q in unique_fold([" ".join(q.split()) for q in made]) if q][: settings["max_variants"]]


def fused_searches(
    docs: DataFrame, asked: list[str], settings: dict, id_col: str, text_col: str, index: LexicalIndex | None, embed: Callable[[str], list[float]] | None, vector_col: str | None, k: int,
    vectors: VectorIndex | None = None,
) -> DataFrame:
    """``id, score``: all queries' lists in one by reciprocal ranks; the lexical ones come from one pass over the index (or the texts), those by
    vectors from one search of the stored index for all queries, or else from a scan for each."""
    queries = {f"q{i}": words_of(q) for i, q in enumerate(asked)}
    found = index.bm25(queries, settings["top_retrieval"]).withColumnRenamed("id", id_col) if index else R.bm25_many(docs, queries, settings["top_retrieval"], id_col, text_col)
    lists = [found.where("score > 0").select(id_col, "rank")]
    if embed and vectors:
        near = vectors.search({q: embed(text) for q, text in zip(queries, asked, strict=True)}, settings["top_retrieval"])
        lists.append(near.select(F.col("id").alias(id_col), "rank"))
    elif embed and vector_col:
        lists += [R.vector_topk(docs, embed(q), settings["top_retrieval"], id_col, vector_col).select(id_col, "rank") for q in asked]
    return R.reciprocal_rank_fusion(lists, [id_col], k)


def ask(
    docs: DataFrame,
    question: str,
    id_col: str,
    doc_col: str,
    text_col: str,
    embed: Callable[[str], list[float]] | None = None,
    vector_col: str | None = None,
    settings: dict | None = None,
    index: LexicalIndex | None = None,
    acts: ActColumns | None = None,
    domain: DomainColumns | None = None,
    profiles: list = (),
    today: date | None = None,
    vectors: VectorIndex | None = None,
) -> DataFrame:
    """``place, rank, id, doc, score, part, evidence``: the rows of the answer's context.

    With ``domain`` scores are raised and lowered by it, and the main category gets its places. With ``acts`` and a question about a
    time only acts in force then and revoked ones are chosen, each kind with its places; if none is in force, those that
    revoked ones name as their successors stand in for them. Without acts in force nor successors the answer is withheld: no rows.
    """
    when = intents.detect(question, today)
    timed = bool(acts and when.enabled and when.start)
    s = tune(question, settings or {}, temporal=timed)
    fused = fused_searches(docs, asked_queries(question, s, profiles), s, id_col, text_col, index, embed, vector_col, POOL * s["top_final"], vectors)
    # The pool is a short list; only its rows bring their texts and metadata.
    pool = docs.join(F.broadcast(fused), id_col)
    if domain:
        about = domain_intent(question, domain.terms, domain.broad)
        columns = [F.col(c) for c in (domain.relation, domain.family, domain.area, domain.main)]
        pool = pool.withColumn("score", F.round(F.col("score") * R.domain_factor(*columns, about.has_terms), 8)) if about.enabled else pool
    if timed:
        chosen = _valid(docs, pool, question, when, acts, s["top_final"], id_col, text_col)
    else:
        ranked = pool.select(id_col, F.col("score"))
        if domain:
            main = R.domain_category(*columns) == "principal"
            ranked = R.reserve_coverage(pool.select(id_col, "score", main.alias("_main")), pool.select(id_col, "score", main.alias("_main")), s["top_final"], id_col, F.col("_main")).select(id_col, "score")
        chosen = R.mmr(ranked, s["top_final"], id_col).withColumn("part", F.lit("pool"))
    rows = docs.join(F.broadcast(chosen), id_col)
    packed = context.pack_context(rows.select(id_col, doc_col, text_col, "rank", "score", "part", *_extra(acts)), doc_col, "rank", F.length(text_col), s["context_chars"])
    line = evidence.metadata_line({"Situação": acts.label(when.start, when.end)}) if timed else F.lit(None).cast("string")
    shown = evidence.evidence_block(F.lit(None).cast("string"), F.col(doc_col), F.col(id_col), line, F.col(text_col))
    return packed.select("place", "rank", id_col, doc_col, "score", "part", shown.alias("evidence"))


def _extra(acts: ActColumns | None) -> list[str]:
    return [acts.start, acts.end, acts.status, acts.normative] if acts else []


def _valid(docs: DataFrame, pool: DataFrame, question: str, when, acts: ActColumns, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, rank, part, score`` of a timed question's rows: in force and revoked ones by budget, with successors where none is in force."""
    active = acts.active(when.start, when.end)
    revoked = F.col(acts.status).isin("revogado", "parcialmente_revogado")
    own = pool.where(F.col(acts.normative))
    picked = temporal.temporal_selection(own.withColumn("_active", active).withColumn("_revoked", revoked), k, id_col, F.col("_active"), F.col("_revoked"))
    title = F.col(acts.title) if acts.title else F.lit("")
    overlap = evidence.question_overlap(question, title, F.col(text_col))
    heirs = temporal.successors(own.where(revoked), docs, acts.revoked_by, id_col, active, overlap, k, [id_col])
    gate = temporal.temporal_gate(own, F.lit(True), active, revoked).select((F.col("n_active") > 0).alias("_some"))
    heirs = heirs.select(id_col, F.lit(0).alias("rank"), F.lit("successor").alias("part"), F.col("overlap").alias("score"))
    listed = picked.join(own.select(id_col, "score"), id_col).select(id_col, "rank", "part", "score")
    both = listed.withColumn("_heir", F.lit(False)).unionByName(heirs.withColumn("_heir", F.lit(True)))
    # One row of the gate: with acts in force the list stands alone; without, it stands behind its successors, if there are any.
    rows = both.crossJoin(F.broadcast(gate))
    whole = Window.partitionBy()  # a short list
    rows = rows.withColumn("_heirs", F.count_if("_heir").over(whole)).where((F.col("_some") & ~F.col("_heir")) | (~F.col("_some") & (F.col("_heirs") > 0)))
    first = R.first_of_each(rows, [id_col], [F.desc("_heir"), F.col("rank")])
    order = Window.orderBy(F.desc("_heir"), F.when(F.col("_heir"), -F.col("score")).otherwise(F.col("rank")), id_col)
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(id_col, "rank", "part", "score")
