"""Records classified by ladders of rules: area of law, family, relation to mining."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import normalize

#: Fields whose texts are read together.
CONTENT_FIELDS = ("titulo", "ementa", "texto_preview", "texto_pdf_preview", "vigencia_trecho", "textos_referencia_origem")
#: Institutions whose names don't make a text one about mining.
INSTITUTIONS = (
    r"\bagencia nacional de mineracao\b", r"\bdepartamento nacional de producao mineral\b", r"\bministerio de minas e energia\b",
    r"\bsecretaria de geologia mineracao e transformacao mineral\b", r"\banm\b", r"\bdnpm\b",
)
#: Words of mining.
MINING = (
    r"\bminer[a-z]*\b", r"\bmineral\b", r"\bminerio\b", r"\bminerios\b", r"\bmina\b", r"\bgarimp", r"\blavra\b", r"\blavreir", r"\bjazid", r"\bsubstan(?:cia|cias) mineral",
    r"\bpesquisa mineral\b", r"\baproveitamento mineral\b", r"\bdireitos minerarios\b", r"\bprocesso minerario\b", r"\brecursos minerais\b", r"\bagencia nacional de mineracao\b",
    r"\bcodigo de mineracao\b", r"\bplg\b", r"\bpermissao de lavra garimpeira\b", r"\bregistro de licenca\b", r"\bguia de utilizacao\b", r"\brelatorio final de pesquisa\b",
    r"\bdeclaracao de investimento em pesquisa mineral\b", r"\bdipm\b", r"\btah\b", r"\bcfem\b", r"\bcompensacao financeira pela exploracao", r"\bseguranca de barragens?\b",
    r"\bbarragem de mineracao\b", r"\bpilha de rejeito", r"\brejeitos? da mineracao\b", r"\bnr-?22\b", r"\bpoeiras minerais\b",
)
#: Areas of law with their words, in the order in which they are tried; mining comes after them.
AREAS = {
    "tributario_arrecadatorio": (r"\btribut", r"\bimposto\b", r"\btaxa\b", r"\bcontribuic", r"\barrecad", r"\bcredito tributario\b", r"\bdivida ativa\b", r"\bparcelamento\b"),
    "trabalhista_saude_seguranca": (r"\btrabalh", r"\bseguranca e saude\b", r"\bsaude ocupacional\b", r"\bnorma regulamentadora\b", r"\bmte\b"),
    "ambiental": (
        r"\bambient", r"\blicenciamento ambiental\b", r"\bibama\b", r"\bconama\b", r"\bunidades de conservacao\b", r"\brecursos hidricos\b", r"\bflorest",
        r"\bdano ambiental\b", r"\beia\b", r"\brima\b",
    ),
    "contratos_licitacoes": (r"\blicitac", r"\bcontrat", r"\bconvenio\b", r"\bacordo de cooperacao\b"),
    "penal_sancionatorio": (r"\bpenal\b", r"\bcrime\b", r"\binfracao penal\b", r"\bcontrabando\b"),
    "administrativo_digital": (r"\bdados?\b", r"\bsistema eletronico\b", r"\bsei\b", r"\bprotocolo digital\b", r"\bassinat", r"\bprocesso eletronico\b"),
    "administrativo_institucional": (
        r"\bestrutura regimental\b", r"\borganizacao basica\b", r"\bcargos? em comissao\b", r"\bfuncao de confianca\b", r"\bregimento interno\b", r"\bcompetencias?\b",
        r"\bministerio\b", r"\bcomite\b", r"\bgrupo de trabalho\b", r"\bdesigna", r"\bnomeia",
    ),
}
#: Families with their words, in the order in which they are tried.
FAMILIES = {
    "cfem_tah_arrecadacao": (r"\bcfem\b", r"\btah\b", r"\btaxa anual por hectare\b", r"\bcompensacao financeira\b", r"\barrecadacao.*miner"),
    "barragens_rejeitos_seguranca": (r"\bbarragem", r"\brejeito", r"\bpilha de rejeito", r"\bseguranca de barragens?\b", r"\bpnsb\b"),
    "regimes_de_aproveitamento": (
        r"\balvara de pesquisa\b", r"\bautorizacao de pesquisa\b", r"\bconcessao de lavra\b", r"\bregistro de licenca\b", r"\blicenciamento mineral\b",
        r"\bguia de utilizacao\b", r"\brelatorio final de pesquisa\b", r"\bdisponibilidade\b",
    ),
    "garimpo_plg": (r"\bgarimp", r"\bplg\b", r"\bpermissao de lavra garimpeira\b"),
    "fiscalizacao_sancoes_minerarias": (r"\bfiscalizacao.*miner", r"\bauto de infracao\b", r"\bsancao", r"\bmultas?\b", r"\binterdicao\b"),
    "seguranca_saude_ocupacional_mineracao": (r"\bnr-?22\b", r"\bsaude ocupacional na mineracao\b", r"\bpoeiras minerais\b", r"\bsilica\b"),
    "ambiental_mineracao": (r"\blicenciamento ambiental.*miner", r"\bimpacto ambiental.*miner", r"\breabilitacao de areas degradadas\b", r"\bprad\b"),
    "institucional_anm_dnpm": (r"\bagencia nacional de mineracao\b", r"\banm\b", r"\bdnpm\b", r"\bregimento interno.*anm\b", r"\bdepartamento nacional de producao mineral\b"),
    "mineracao_geral": MINING,
}
#: The area that a family brings with it.
AREA_OF_FAMILY = {
    "regimes_de_aproveitamento": "minerario", "garimpo_plg": "minerario", "fiscalizacao_sancoes_minerarias": "minerario", "mineracao_geral": "minerario",
    "cfem_tah_arrecadacao": "tributario_arrecadatorio", "ambiental_mineracao": "ambiental", "seguranca_saude_ocupacional_mineracao": "trabalhista_saude_seguranca",
}
SECTORS = ("ambiental", "trabalhista_saude_seguranca", "tributario_arrecadatorio")


@dataclass(frozen=True)
class Relation:
    """What a step of the ladder of relations gives."""

    relation: str
    role: str
    application: str
    main: bool
    confidence: str


DIRECT = Relation("direta", "principal", "material", True, "alta")
COLLECTED = Relation("direta", "principal", "material", True, "media")
INSTITUTIONAL = Relation("indireta", "apoio", "institucional", False, "media")
SECTORAL = Relation("indireta", "apoio", "setorial_transversal", False, "media")
MENTIONED = Relation("indireta", "apoio", "referencia_material", False, "media")
REFERRED = Relation("referenciada", "apoio", "referencia_externa", False, "media")
NONE = Relation("sem_relacao_identificada", "apoio", "contexto", False, "baixa")


def joined_text(columns: list[str], fields: tuple[str, ...]) -> Column:
    """The filled fields that a table has, as one normalised text."""
    return normalize(F.concat_ws(" ", *[F.col(f"`{f}`").cast("string") for f in fields if f in columns]))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text holds one of the patterns: one regular expression, so it is read once."""
    return F.rlike(text, F.lit("|".join(f"(?:{p})" for p in patterns)))


def first_label(text: Column, rules: dict[str, tuple[str, ...]], otherwise: str | Column) -> Column:
    """The label of the first rule that holds."""
    result = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for label, patterns in reversed(rules.items()):
        result = F.when(any_of(text, patterns), label).otherwise(result)
    return result


def without_institutions(text: Column) -> Column:
    left = F.regexp_replace(text, "|".join(f"(?:{p})" for p in INSTITUTIONS), " ")
    return F.trim(F.regexp_replace(left, r"\s+", " "))


def classify(records: DataFrame) -> DataFrame:
    """Records with ``area, family, relation, role, application, main, confidence``, all in one projection.

    Area and family are the first whose words the content holds; a family may settle the area. The relation's ladder: words of mining in
    title or summary, or a family of mining; the consolidated collection with such words; an institution's administrative act;
    such words anywhere; an act that others refer to; none. Columns that the table lacks count as empty.
    """
    has = records.columns
    texts = records.withColumn("_content", joined_text(has, CONTENT_FIELDS)).withColumn("_title", joined_text(has, ("titulo", "ementa")))
    content, title = F.col("_content"), without_institutions(F.col("_title"))
    by_words = first_label(content, AREAS, F.when(any_of(without_institutions(content), MINING), "minerario").otherwise("administrativo_indeterminado"))
    rows = texts.withColumn("family", first_label(content, FAMILIES, "nao_classificada"))
    settled = reduce(lambda otherwise, x: F.when(F.col("family") == x[0], x[1]).otherwise(otherwise), AREA_OF_FAMILY.items(), by_words)
    rows = rows.withColumn("area", settled).withColumn("_any", any_of(without_institutions(content), MINING))
    own = [f for f in FAMILIES if f != "institucional_anm_dnpm"]
    place = joined_text(has, ("collection_slug", "menu_slug"))
    institution = F.rlike(joined_text(has, ("orgao",)), F.lit(r"\b(anm|dnpm)\b")) | F.rlike(place, F.lit(r"\b(anm|dnpm|minera)"))
    referred = joined_text(has, ("textos_referencia_origem",)) != ""
    steps = [
        (any_of(title, MINING) | F.col("family").isin(own), DIRECT),
        (F.contains(joined_text(has, ("collection_slug",)), F.lit("legislacao_consolidada_mineracao")) & F.col("_any"), COLLECTED),
        (institution & F.col("area").startswith("administrativo"), INSTITUTIONAL),
        (F.col("_any") & F.col("area").isin(list(SECTORS)), SECTORAL),
        (F.col("_any"), MENTIONED),
        (referred, REFERRED),
    ]
    names = ("relation", "role", "application", "main", "confidence")
    made = lambda r: F.struct(*[F.lit(getattr(r, n)).alias(n) for n in names])
    relation = reduce(lambda otherwise, x: F.when(x[0], made(x[1])).otherwise(otherwise), reversed(steps), made(NONE))
    rows = rows.withColumn("_relation", relation)
    return rows.select(*[F.col(f"`{c}`") for c in has], "area", "family", *[F.col(f"_relation.{n}").alias(n) for n in names])
