"""Which documents a question is about: a directive, an act's number and year, or a near embedding."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import alnum_key
from verdigris.operators.ranking import vector_topk
from verdigris.plans.intent import act_reference


def docs_directive(text: str) -> tuple[list[str], str]:
    """``@docs "a.pdf" b.pdf question``: the documents named, and the question."""
    found = re.match(r"\s*@docs\b\s*(.*)", text or "", re.IGNORECASE | re.DOTALL)
    if not found:
        return [], (text or "").strip()
    rest, names = found[1], []
    while piece := re.match(r'\s*(?:"([^"]+)"|(\S*\.pdf\S*?))(?:\s*,)?(?:\s+|$)', rest, re.IGNORECASE):
        names.append((piece[1] or piece[2]).strip())
        rest = rest[piece.end() :]
    return list(dict.fromkeys(names)), rest.strip()


def resolve_documents(documents: DataFrame, name_col: str, wanted: list[str]) -> DataFrame:
    """``wanted, name``: the document of each name in common form, else the only one that contains it; others are left out."""
    keys = documents.select(name_col, alnum_key(F.col(name_col)).alias("key")).distinct()
    asked = F.array(*[F.struct(F.lit(w).alias("wanted"), alnum_key(F.lit(w)).alias("ask")) for w in wanted]) if wanted else None
    if asked is None:
        return keys.select(F.lit("").alias("wanted"), F.col(name_col).alias("name")).limit(0)
    rows = keys.select(name_col, "key", F.explode(asked).alias("a")).where((F.col("a.ask") != "") & F.contains("key", F.col("a.ask")))
    exact = F.col("key") == F.col("a.ask")
    found = rows.groupBy(F.col("a.wanted").alias("wanted")).agg(
        F.min(F.when(exact, F.col(name_col))).alias("exact"), F.min(name_col).alias("first"), F.count(F.lit(1)).alias("n")
    )
    name = F.coalesce("exact", F.when(F.col("n") == 1, F.col("first")))
    return found.select("wanted", name.alias("name")).where("name is not null")


def route_by_act(documents: DataFrame, name_col: str, question: str) -> DataFrame:
    """The only document whose name holds the number and year (and, among several, the kind) of the act that the question names."""
    act = act_reference(question)
    names = documents.select(name_col).distinct()
    if not act.number:
        return names.limit(0)
    key = alnum_key(F.col(name_col))
    rows = names.where(F.contains(key, F.lit(act.number)) & (F.contains(key, F.lit(str(act.year))) if act.year else F.lit(True)))
    kind = F.contains(key, F.lit(re.sub("[^a-z]", "", act.kind or "")))
    marked = rows.withColumn("_kind", kind)
    # Names that match are few; the aggregate says whether one is left.
    pick = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if("_kind").alias("k"), F.min(name_col).alias("any"), F.min(F.when(F.col("_kind"), F.col(name_col))).alias("one"))
    name = F.when(F.col("k") == 1, F.col("one")).when((F.col("n") == 1) & (F.col("k") == 0), F.col("any"))
    return pick.select(name.alias(name_col)).where(F.col(name_col).isNotNull())


def route_by_vector(documents: DataFrame, id_col: str, vector_col: str, query: list[float], least: float = 0.82) -> DataFrame:
    """The nearest document, if its cosine exceeds ``least``."""
    return vector_topk(documents, query, 1, id_col, vector_col).where(F.col("score") > least).select(id_col, "score")
