"""What the texts of acts say: references, events, provisions, entry into force, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.dates import MONTHS, day_month_year
from verdigris.functions.text import normalize

KINDS = "lei complementar|lei|decreto-lei|decreto|portaria|resolucao|instrucao normativa|medida provisoria"
REFERENCE = rf"\b({KINDS})\b(?: [a-z/]{{2,12}})?(?: n[o.]{{0,3}})? ?([0-9][0-9.]*)(?: ?/ ?|,? de (?:[0-9]{{1,2}}o? de [a-z]+ de )?)((?:19|20)[0-9]{{2}})\b"


def norm_references(text: Column) -> Column:
    """All acts that a text names: an array of ``kind, number, year``, each once, in order."""
    t = normalize(text)
    group = lambda k: F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(k))
    pairs = F.zip_with(group(1), group(2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    made = F.zip_with(
        pairs,
        group(3),
        lambda p, y: F.struct(p["a"].alias("kind"), F.replace(F.rtrim(p["b"], F.lit(".")), F.lit("."), F.lit("")).alias("number"), y.cast("int").alias("year")),
    )
    return F.array_distinct(made)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


#: Forms that say that a provision was revoked, altered or added, and by whom.
REVOKED = ("revogado pel", "revogada pel", "revogados pel", "revogadas pel", "fica revogad", "ficam revogad", "revoga-se", "revogam-se")
ALTERED = ("alterad", "redacao dada")
ADDED = ("incluido pel", "incluida pel", "acrescido pel", "acrescida pel", "fica incluid", "ficam incluid", "fica acrescid", "ficam acrescid")
PASSIVE = ("revogado pel", "revogada pel", "alterado pel", "alterada pel", "redacao dada pel", "incluido pel", "incluida pel", "acrescido pel", "acrescida pel")
ACTIVE = ("fica revogad", "ficam revogad", "revoga-se", "revogam-se", "revoga ", "altera ")


def event_type(text: Column) -> Column:
    t = normalize(text)
    return F.when(_any(t, REVOKED), "revogacao").when(_any(t, ALTERED), "alteracao").when(_any(t, ADDED), "inclusao")


def event_direction(text: Column) -> Column:
    t = normalize(text)
    return F.when(_any(t, PASSIVE), "passiva").when(_any(t, ACTIVE), "ativa").otherwise("indeterminada")


LEVELS = ("artigo", "paragrafo", "inciso", "alinea", "item")
HEADS = (
    r"(?i)^(art\.?\s*[0-9]+[a-zº°-]*)",
    r"(?i)^(par[aá]grafo\s+[uú]nico|§\s*[0-9]+[º°]?)",
    r"^([IVXLCDM]+)\s*[-–—]\s",
    r"^([a-z])\)\s",
    r"^([0-9]+)\.\s",
)


def device_paths(lines: DataFrame, doc: str, place: str, text: str) -> DataFrame:
    """Each line with the provision in which it stands: ``level`` of the provision that the line opens (null: none) and ``path``.

    A provision closes those below it. Windows over a document's lines carry for each level the last opening and its
    place; it holds if no higher level opened after it.
    """
    line = F.trim(F.col(text))
    head = [F.regexp_extract(line, p, 1) for p in HEADS]
    level, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k in reversed(range(len(HEADS))):
        level = F.when(head[k] != "", k).otherwise(level)
        label = F.when(head[k] != "", F.rtrim(head[k], F.lit("."))).otherwise(label)
    rows = lines.withColumn("_level", level).withColumn("_label", label)
    so_far = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    for k in range(len(HEADS)):
        here = F.when(F.col("_level") == k, F.struct(F.col(place).alias("p"), F.col("_label").alias("l")))
        rows = rows.withColumn(f"_at{k}", F.last(here, ignorenulls=True).over(so_far))
    parts, since = [], F.lit(None)
    for k, name in enumerate(LEVELS):
        at = F.col(f"_at{k}")
        parts.append(F.when(at.isNotNull() & (since.isNull() | (at["p"] > since)), F.concat(F.lit(name.capitalize() + " "), at["l"])))
        since = F.greatest(since, at["p"]) if k else at["p"]
    named = F.element_at(F.array(*[F.lit(n) for n in LEVELS]), F.col("_level") + 1)
    out = rows.withColumn("level", F.when(F.col("_level").isNotNull(), named)).withColumn("path", F.concat_ws(" > ", *parts))
    return out.drop("_level", "_label", *[f"_at{k}" for k in range(len(HEADS))])


#: Portuguese words for numbers.
NUMBERS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12,
    "treze": 13, "quatorze": 14, "catorze": 14, "quinze": 15, "dezesseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19, "vinte": 20, "trinta": 30,
    "quarenta": 40, "cinquenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90, "cem": 100, "cento": 100, "duzentos": 200, "trezentos": 300,
    "quatrocentos": 400, "quinhentos": 500, "seiscentos": 600, "setecentos": 700, "oitocentos": 800, "novecentos": 900,
}


def quantity(text: Column) -> Column:
    """A number in digits or in words (cento e oitenta); null if a word isn't one."""
    t = normalize(text)
    words = F.filter(F.split(t, " "), lambda w: (w != "e") & (w != ""))
    value = F.create_map(*[x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(v))])
    summed = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.when(w == "mil", F.greatest(acc, F.lit(1)) * 1000 - acc).otherwise(value[w]))
    return F.coalesce(F.when(F.rlike(t, F.lit("^[0-9]{1,6}$")), t.try_cast("int")), F.when(t != "", summed))


VACATIO = r"(?:apos|decorridos|no prazo de|em)(?: decorridos)?(?: o prazo de)? (?:([0-9]{1,4})(?: ?\([a-z ]+\))?|([a-z ]{2,40}?)) (dia|mes|ano)(?:s|es)?\b"


def relative_start(text: Column) -> Column:
    """``amount, unit`` of a delayed entry into force: what follows "entra em vigor" in its sentence; null without one."""
    t = normalize(text)
    clause = F.regexp_extract(t, r"(?:entra(?:ra)?|entrar) em vigor([^.;]{0,240})", 1)
    amount = F.coalesce(F.regexp_extract(clause, VACATIO, 1).try_cast("int"), quantity(F.regexp_extract(clause, VACATIO, 2)))
    unit = F.regexp_extract(clause, VACATIO, 3)
    unit = F.when(unit == "dia", "day").when(unit == "mes", "month").when(unit == "ano", "year")
    return F.when(amount.isNotNull() & unit.isNotNull(), F.struct(amount.alias("amount"), unit.alias("unit")))


def explicit_start(text: Column) -> Column:
    """The date of "entra em vigor em/no dia <date>"."""
    dated = "|".join(MONTHS)
    found = F.regexp_extract(normalize(text), rf"em vigor (?:em|no dia|a partir de|a partir do dia) ([0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}}|[0-9]{{1,2}}o? de (?:{dated}) de [0-9]{{4}})", 1)
    return F.when(found != "", day_month_year(found))


def publication_date(text: Column) -> Column:
    """The first date on a line that speaks of publication."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(normalize(x), F.lit(r"\b(publicad[oa]|d\.?o\.?u\.?|diario oficial)\b")))
    return F.get(F.array_compact(F.transform(lines, day_month_year)), F.lit(0))


def ementa(paragraphs: Column) -> Column:
    """An act's summary: the first paragraph of some length that is no title, note, formula or signature."""
    refuse = r"^(art\.? ?[0-9]|§|o |a (diretoria|presid)|texto|este |publicad|\(?revogad|\(?alterad|brasilia|ministro|presidente|diretor|considerando|resolve)"
    title = rf"^({KINDS})\b.{{0,40}}[0-9]"
    fits = lambda p: (F.length(F.trim(p)) >= 30) & ~F.rlike(normalize(p), F.lit(refuse)) & ~F.rlike(normalize(p), F.lit(title))
    return F.get(F.filter(paragraphs, fits), F.lit(0))


def highlight(text: Column, words: list[str]) -> Column:
    """Words of more than three characters in bold, as they are written."""
    import re

    wanted = sorted({w.lower() for w in words if len(w) > 3}, key=lambda w: (-len(w), w))
    if not wanted:
        return text
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({'|'.join(map(re.escape, wanted))})(?![\p{{L}}\p{{N}}_])", "**$1**")


def article_references(text: Column) -> Column:
    """Articles that a text names, in a common form, each once, in order."""
    found = F.regexp_extract_all(normalize(text), F.lit(r"\b(?:art(?:igo|\.)?) ?([0-9]+(?:-[a-z])?)"), F.lit(1))
    return F.array_distinct(found)


#: How a text names articles, paragraphs, items and letters, in common form; levels from the widest to the narrowest.
PROVISIONS = {
    "art. ": r"\bart(?:igos?|s?\.)? ?([0-9]{1,4})[oa]?((?:-[a-z])?)\b",
    "§ ": r"§{1,2} ?([0-9]{1,3})o?\b|\bparagrafo ([0-9]{1,3})o?\b|\bparagrafo (unico)\b",
    "inciso ": r"\bincisos? ([ivxlc]+)\b|(?<=[0-9a-z], )([ivxlc]+)(?=,|;|\.| d[oa]s? |\)|$)",
    "alínea ": r"\balineas? [\"'“”]?([a-z])(?![a-z])",
}


def provision_references(text: Column) -> Column:
    """The provisions that a text names as paths (``art. 5, § 2, inciso iii, alínea a``), each once, in order: one fold over the text's tokens.

    A token belongs to the wider ones before it: a paragraph to the article named last, and so on; a wider or equal token begins another path.
    So ``art. 5, incisos I e art. 6, § 1`` names three levels of two articles. A text without any has an empty array.
    """
    plain = normalize(F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(plain, F.lit("|".join(f"(?:{p})" for p in PROVISIONS.values())), F.lit(0))
    names = list(PROVISIONS)

    def level_of(token: Column) -> Column:
        kinds = (r"^art", r"^(?:§|paragrafo)", r"^(?:inciso|[ivxlc]+$)")
        return F.when(F.rlike(token, F.lit(kinds[0])), 0).when(F.rlike(token, F.lit(kinds[1])), 1).when(F.rlike(token, F.lit(kinds[2])), 2).otherwise(3)

    def value_of(token: Column) -> Column:
        number = F.regexp_replace(token, r"^(?:art(?:igos?|s?\.)? ?|§{1,2} ?|paragrafo |incisos? |alineas? [\"'“”]?)", "")
        return F.regexp_replace(number, r"^([0-9]+)[oa]?", "$1")

    def path_of(held: Column) -> Column:
        return F.array_join(F.filter(F.transform(held, lambda v, i: F.when(v != "", F.concat(F.get(F.array(*[F.lit(n) for n in names]), i), v))), lambda x: x.isNotNull()), ", ")

    none = F.array(*[F.lit("") for _ in names])
    start = F.struct(none.alias("held"), F.lit(-1).alias("last"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        level = level_of(token)
        ends = (acc["last"] >= 0) & (level <= acc["last"])
        held = F.transform(acc["held"], lambda v, i: F.when(i < level, v).when(i == level, value_of(token)).otherwise(""))
        out = F.when(ends, F.concat(acc["out"], F.array(path_of(acc["held"])))).otherwise(acc["out"])
        return F.struct(held.alias("held"), level.alias("last"), out.alias("out"))

    return F.array_distinct(F.aggregate(tokens, start, step, lambda acc: F.when(acc["last"] >= 0, F.concat(acc["out"], F.array(path_of(acc["held"])))).otherwise(acc["out"])))
