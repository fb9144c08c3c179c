"""Questions about a registry: what is asked, and the DataFrame that answers it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import company_id
from verdigris.operators import registry as G
from verdigris.operators.name_index import NameIndex
from verdigris.operators.paths import paths_between
from verdigris.plans.routing import plain

#: Abbreviations of the states.
STATES = "AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split()


@dataclass(frozen=True)
class RegistryQuestion:
    kind: str
    number: str | None = None
    names: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)


def understand(question: str) -> RegistryQuestion:
    """The first kind that fits: links and paths between companies, a person's companies, an id, filters, a name."""
    text = plain(question)
    digits = re.search(r"(?<!\d)(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}|\d{8})(?!\d)", question)
    quoted = tuple(re.findall(r'"([^"]+)"', question))
    state = re.search(rf"\b({'|'.join(STATES)})\b", question)  # as written: small words such as "se" and "para" are no states
    activity = re.search(r"\bcnae\D{0,10}(\d{7})\b", text)
    filters = {k: v for k, v in (("uf", state and state[1]), ("cnae", activity and activity[1]), ("active", "ativa" in text or None)) if v}
    if re.search(r"\b(relacao|vinculo|ligacao|caminho)\b.*\bentre\b", text) and len(quoted) >= 2:
        return RegistryQuestion("paths", names=quoted[:4])
    if re.search(r"\b(outras empresas|empresas ligadas|mesmos socios)\b", text):
        return RegistryQuestion("links", re.sub(r"\D", "", digits[1]) if digits else None, quoted)
    if re.search(r"\bempresas\b.*\b(de|do|da)\b.*\bsocio\b|\bsocio\b.*\bempresas\b", text) and quoted:
        return RegistryQuestion("person", names=quoted)
    if digits:
        number = re.sub(r"\D", "", digits[1])
        return RegistryQuestion("partners" if "socio" in text else "profile" if len(number) == 14 else "list", number)
    if filters:
        by_state = re.search(r"\bpor (uf|estado)\b", text)
        return RegistryQuestion("by_state" if by_state else "count" if re.search(r"\bquant[ao]s\b", text) else "filter", filters=filters)
    return RegistryQuestion("name", names=quoted or (text,))


def profile(companies: DataFrame, establishments: DataFrame, activities: DataFrame, number: str) -> DataFrame:
    """One establishment with its company and the description of its activity; all keys are strings."""
    here = establishments.where((F.col("cnpj_basico") == number[:8]) & (F.col("cnpj_ordem") == number[8:12]) & (F.col("cnpj_dv") == number[12:14]))
    whole = here.join(companies.where(F.col("cnpj_basico") == number[:8]), "cnpj_basico", "left")
    codes = activities.select(F.col("codigo").alias("cnae_fiscal_principal"), F.col("descricao").alias("cnae_descricao"))
    joined = whole.join(codes, "cnae_fiscal_principal", "left")
    return joined.withColumn("cnpj", company_id(F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv")))


def headquarters(companies: DataFrame, establishments: DataFrame) -> DataFrame:
    """All companies, with their headquarters where there is one: the test belongs to the join."""
    return companies.join(establishments.where(F.col("cnpj_ordem") == "0001"), "cnpj_basico", "left")


def partner_key(document: Column, name: Column) -> Column:
    """A partner's key: a document of six digits or more that aren't all alike (strong), else the name (weak)."""
    digits = F.regexp_replace(F.coalesce(document, F.lit("")), "[^0-9]", "")
    strong = (F.length(digits) >= 6) & ~F.rlike(digits, F.lit(r"^(\d)\1*$"))
    return F.when(strong, F.concat(F.lit("doc:"), digits)).otherwise(F.concat(F.lit("name:"), F.upper(F.trim(name))))


def best_names(companies: DataFrame, words: list[str], k: int, names: NameIndex | None) -> DataFrame:
    """The companies whose names fit best: from the index of names where there is one, else by scoring all."""
    if names is None:
        return G.name_search(companies, words, F.col("razao_social"), k, "cnpj_basico")
    found = F.broadcast(names.search(words, k).withColumnRenamed("id", "cnpj_basico"))  # k rows
    return companies.join(found, "cnpj_basico").orderBy(F.desc("match"), "cnpj_basico")


def answer(
    question: RegistryQuestion, companies: DataFrame, establishments: DataFrame, partners: DataFrame, activities: DataFrame, limit: int = 20, names: NameIndex | None = None
) -> DataFrame:
    """The rows that answer a question; ``names``: an index of the companies' names by ``cnpj_basico``."""
    limit = G.clamp(limit)
    number, q = question.number, question
    edges = partners.select("cnpj_basico", partner_key(F.col("cnpj_cpf_do_socio"), F.col("nome_socio")).alias("partner"))
    if q.kind == "profile":
        return profile(companies, establishments, activities, number)
    if q.kind == "list":
        return establishments.where(F.col("cnpj_basico") == number[:8]).join(companies, "cnpj_basico", "left").orderBy("cnpj_ordem").limit(limit)
    if q.kind == "partners":
        return partners.where(F.col("cnpj_basico") == number[:8]).orderBy(F.desc("data_entrada_sociedade"), "nome_socio").limit(limit)
    if q.kind == "links" and number:
        return G.linked(edges, number[:8], "cnpj_basico", "partner", limit)
    if q.kind == "person":
        mine = partners.where(F.upper(F.trim(F.col("nome_socio"))) == q.names[0].strip().upper()).select("cnpj_basico").distinct()
        return headquarters(companies.join(mine, "cnpj_basico", "left_semi"), establishments).orderBy("razao_social", "cnpj_basico").limit(limit)
    if q.kind in ("filter", "count", "by_state"):
        names = {"uf": "uf", "cnae": "cnae_fiscal_principal", "active": "situacao_cadastral"}
        keep = G.predicate({names[k]: ("equals", "02" if k == "active" else v) for k, v in q.filters.items()})
        rows = establishments.where(keep)
        if q.kind == "by_state":
            return G.count_by(rows, "uf", limit)
        return rows.agg(F.count(F.lit(1)).alias("total")) if q.kind == "count" else rows.orderBy("cnpj_basico", "cnpj_ordem").limit(limit)
    if q.kind == "paths":
        ends = [[r.cnpj_basico for r in best_names(companies, plain(n).split(), 3, names).collect()] for n in q.names[:2]]
        named = edges.withColumn("weak", F.col("partner").startswith("name:"))
        return paths_between(named, ends[0], ends[1], "cnpj_basico", "partner", 2, weak_col="weak")
    words = plain(q.names[0]).split() if q.names else []
    return best_names(companies, words, limit, names)
