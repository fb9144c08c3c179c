"""Validity in time: effective intervals, status at a date, gates, succession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.dates import bare_year, iso_date
from verdigris.functions.text import normalize


def effective_start(start: Column) -> Column:
    """An ISO date, or January 1 of a bare year."""
    year = bare_year(start)
    return F.coalesce(iso_date(start), F.when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1))))


def effective_end(*ends: Column, year: Column | None = None) -> Column:
    """The first of several texts that gives an end: an ISO date, or December 31 of a bare year; then a year from 1900 to 2100."""
    found = []
    for end in ends:
        y = bare_year(end)
        found.append(F.coalesce(iso_date(end), F.when(y.isNotNull(), F.make_date(y, F.lit(12), F.lit(31)))))
    if year is not None:
        found.append(F.when(year.between(1900, 2100), F.make_date(year, F.lit(12), F.lit(31))))
    return F.coalesce(*found) if len(found) > 1 else found[0]


def canonical_status(status: Column) -> Column:
    """One of revogado, parcialmente_revogado, vigente, alterado, desconhecido, or the text itself."""
    s = normalize(status)
    has = lambda word: F.contains(s, F.lit(word))
    return (
        F.when(s == "", "desconhecido")
        .when(has("parcial") & has("revog"), "parcialmente_revogado")
        .when(has("nao vigente") | has("nao vigencia") | has("revog"), "revogado")
        .when(has("vigente") | has("em vigor"), "vigente")
        .when(has("alterad"), "alterado")
        .otherwise(s)
    )


def header_status(text: Column) -> Column:
    """What the head of an act says of its revocation; null if nothing. The head: eight lines with text, or 900 characters."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    head = F.concat_ws(" ", normalize(F.concat_ws(" ", F.slice(lines, 1, 8))), normalize(F.substring(text, 1, 900)))
    found = F.rlike(head, F.lit(r"\b(parcialmente )?revogad[oa]s? pel[oa]\b")) & ~F.rlike(head, F.lit(r"\bnao revogad"))
    return F.when(found, F.when(F.rlike(head, F.lit(r"\bparcialmente revogad")), "parcialmente_revogado").otherwise("revogado"))


def effective_status(status: Column, text: Column, partial: Column) -> Column:
    """The head's word, else the canonical status, which signs of a partial revocation turn partial."""
    s = canonical_status(status)
    open_ = s.isin("desconhecido", "indeterminado", "vigente", "alterado")
    return F.coalesce(header_status(text), F.when(open_ & F.coalesce(partial, F.lit(False)), "parcialmente_revogado").otherwise(s))


#: Fields of which one filled makes a record one of an act; statuses that say that it is none, and those that say it is one.
ACT_FIELDS = (
    "tipo_norma", "numero_norma", "ano_norma", "status_normativo", "data_inicio_vigencia", "data_fim_vigencia", "vacatio_dias", "vacatio_legis_dias",
    "revogado_por", "revogado_por_data", "revoga", "tipo_chunk", "tem_dispositivo_revogacao", "tem_dispositivo_vigencia",
)
NO_ACT = ("nao normativo", "nao_normativo")
ACT_STATUS = ("vigente", "revogado", "indeterminado", "vacatio", "parcialmente_revogado")


def has_act_metadata(columns: dict[str, str]) -> Column:
    """Whether one of the act's fields that the table (``name: type``) has is filled."""
    filled = F.lit(False)
    for name in ACT_FIELDS:
        if name in columns:
            c = F.col(f"`{name}`")
            some = F.size(c) > 0 if columns[name].startswith("array") else c.cast("string") != ""
            filled = filled | F.coalesce(some, F.lit(False))
    return filled


def effectively_normative(status: Column) -> Column:
    """Whether the status doesn't say that a record is no act."""
    return ~canonical_status(status).isin(list(NO_ACT))


def clause_normative(status: Column, kind: Column, title: Column) -> Column:
    """Whether a record counts as an act where clauses are analysed: by its status, else by a kind or a title."""
    s = normalize(status)
    named = (normalize(kind) != "") | (normalize(title) != "")
    return F.when(s.isin(list(NO_ACT)), False).when(s.isin(list(ACT_STATUS)), True).otherwise(named)


def active_in(start: Column, end: Column, status: Column, first: Column, last: Column, normative: Column | None = None) -> Column:
    """Whether a record is in force at some time from ``first`` to ``last``; intervals are closed."""
    bounds = (
        F.when(start.isNotNull() & end.isNotNull(), (start <= last) & (end >= first))
        .when(start.isNotNull(), (status != "revogado") & (start <= last))
        .when(end.isNotNull(), end >= first)
        .otherwise(status.isin("vigente", "alterado", "parcialmente_revogado"))
    )
    known = first.isNotNull() & last.isNotNull()
    if normative is not None:
        known = known & normative
    return F.coalesce(known & bounds, F.lit(False))


def status_in(start: Column, end: Column, status: Column, first: Column, last: Column) -> Column:
    """A label for the record's state in a period, which one day may be."""
    active = active_in(start, end, status, first, last)
    when = F.when(first == last, "na_data").otherwise("no_periodo")
    live = (
        F.when(status == "revogado", F.concat(F.lit("vigente_"), when, F.lit("_e_revogada_posteriormente")))
        .when(status == "parcialmente_revogado", F.concat(F.lit("vigente_"), when, F.lit("_com_revogacao_parcial")))
        .otherwise(F.concat(F.lit("vigente_"), when))
    )
    gone = F.when(end < first, "revogada_antes_do_periodo").otherwise("revogada_no_periodo_ou_sem_data_precisa")
    return F.when(active, live).when(start > last, "ainda_nao_vigente_no_periodo").when(status == "revogado", gone).otherwise("nao_identificado")


def revocation_related(status: Column, chunk_kind: Column, revoked_by: Column, revokes: Column) -> Column:
    return (
        status.isin("revogado", "parcialmente_revogado")
        | F.coalesce(chunk_kind == "dispositivo_revogacao", F.lit(False))
        | (F.trim(F.coalesce(revoked_by, F.lit(""))) != "")
        | (F.coalesce(F.size(revokes), F.lit(0)) > 0)
    )


def temporal_gate(rows: DataFrame, normative: Column, active: Column, revoked: Column) -> DataFrame:
    """One row: numbers of normative, active and revoked records, and whether an answer is to be withheld."""
    counted = rows.agg(
        F.count_if(normative).alias("n_normative"),
        F.count_if(normative & active).alias("n_active"),
        F.count_if(normative & revoked).alias("n_revoked"),
    )
    return counted.withColumn("blocked", (F.col("n_normative") > 0) & (F.col("n_active") == 0))


def successors(revoked: DataFrame, records: DataFrame, by_col: str, id_col: str, active: Column, overlap: Column, k: int, order: list[str]) -> DataFrame:
    """Active records that the revoked ones name as their revokers, by their overlap with the question."""
    wanted = revoked.select(F.col(by_col).alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    rows = records.where(active).join(wanted, id_col, "left_semi").withColumn("overlap", overlap).where("overlap > 0")
    return rows.orderBy(F.desc("overlap"), *order).limit(k)


def budgets(k: int) -> tuple[int, int]:
    """Places for active and for revoked records: 65 % (halves to even), the rest, at least one each."""
    active = max(1, round(0.65 * k))
    return active, max(1, k - active)


def temporal_selection(rows: DataFrame, k: int, id_col: str, active: Column, revoked: Column) -> DataFrame:
    """``id, rank, part``: the best active rows, then the best revoked ones, each once, filled up from all by score."""
    n_active, n_revoked = budgets(k)
    best = lambda df, n: df.orderBy(F.desc("score"), id_col).limit(n)
    parts = [(best(rows.where(active), n_active), "active", 1), (best(rows.where(revoked), n_revoked), "revoked", 2), (best(rows, 2 * k), "pool", 3)]
    made = None
    for part, name, place in parts:
        part = part.select(id_col, "score", F.lit(name).alias("part"), F.lit(place).alias("place"))
        made = part if made is None else made.unionByName(part)
    once = Window.partitionBy(id_col).orderBy("place")
    short = made.withColumn("_n", F.row_number().over(once)).where("_n = 1")  # 4 k rows at most
    ranked = short.withColumn("rank", F.row_number().over(Window.orderBy("place", F.desc("score"), id_col)))
    return ranked.where(F.col("rank") <= k).select(id_col, "rank", "part")
