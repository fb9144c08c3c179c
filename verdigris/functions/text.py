"""Text functions as Spark columns; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def spaced_tokens(text: Column) -> Column:
    """The same tokens as one string with a space between two: one string goes to a Python worker faster than an array of them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def _accent_table() -> tuple[str, str]:
    """Latin letters with one combining mark after decomposition, and their bare letters: made from a rule."""
    pairs = []
    for code in [0xAA, 0xBA, *range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        split = unicodedata.normalize("NFKD", chr(code))
        bare = "".join(c for c in split if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accent_table()


def strip_accents(text: Column) -> Column:
    """Letters without their accents (Latin script); combining marks that stand alone go too."""
    return F.regexp_replace(F.translate(text, ACCENTED, BARE), r"\p{Mn}+", "")


def normalize(text: Column) -> Column:
    """Without accents, in lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), r"\s+", " "))


def simple(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; accents stay."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def alnum_key(name: Column) -> Column:
    """A file name's key: without folder and ``.pdf``, only a-z and 0-9."""
    base = F.regexp_replace(F.lower(strip_accents(name)), r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(base, r"\.pdf$", ""), "[^a-z0-9]", "")


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read anew; other texts stay."""
    looks = F.rlike(text, F.lit("[ÃÂ][\u0080-¿]"))
    return F.when(looks, F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")).otherwise(text)


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^0-9]", "")


def company_id(text: Column) -> Column:
    """``##.###.###/####-##`` of 14 digits; null otherwise."""
    d = digits(text)
    part = lambda a, n: F.substring(d, a, n)
    shown = F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("/"), part(9, 4), F.lit("-"), part(13, 2))
    return F.when(F.length(d) == 14, shown)


#: Words and legal suffixes that say nothing about which company is meant.
COMPANY_STOP_WORDS = ("a", "as", "da", "das", "de", "do", "dos", "e", "em", "o", "os", "cia", "companhia", "eireli", "ltda", "me", "epp", "sa", "limitada")


def company_tokens(name: Column, stop: tuple[str, ...] = COMPANY_STOP_WORDS) -> Column:
    """A company name's telling words in lower case without accents."""
    words = F.regexp_extract_all(normalize(name), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(list(stop)))


def match_score(query: list[str], candidate: Column) -> Column:
    """How well a company's tokens match a query's: 4 for each equal word, else 2 for a prefix of three letters or more
    in either direction, and 12 for equal names or 6 if one contains the other."""
    score = F.lit(0)

    def begins(word: str) -> Column:
        return F.exists(candidate, lambda c: c.startswith(word) | F.lit(word).startswith(c)) if len(word) >= 3 else F.lit(False)

    for word in query:
        prefix = begins(word)
        score = score + F.when(F.array_contains(candidate, word), 4).when(prefix, 2).otherwise(0)
    whole, name = F.lit(" ".join(query)), F.array_join(candidate, " ")
    score = score + F.when(name == whole, 12).when(F.contains(name, whole) | F.contains(whole, name), 6).otherwise(0)
    return F.when(F.size(candidate) > 0, score).otherwise(0) if query else F.lit(0)


def strip_tags(html: Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags go, common entities are decoded, spaces collapse."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def links(html: Column) -> Column:
    """Targets of the page's anchors, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\s+[^>]*href=["']([^"']*)["']"""), F.lit(1))


def url_value(url: Column, *names: str) -> Column:
    """The first of some parameters of a URL that has a value, decoded; ``&amp;`` counts as ``&``."""
    plain = F.replace(url, F.lit("&amp;"), F.lit("&"))
    found = [F.try_url_decode(F.regexp_extract(plain, rf"[?&]{n}=([^&#]*)", 1)) for n in names]
    return F.coalesce(*[F.when(v != "", v) for v in found], F.lit(None).cast("string"))


#: Parameters under which a legal site's URLs name an act.
ACT_PARAMETERS = {
    "kind": ("tipo", "sgl_tipo"), "number": ("numeroAto", "num_ato"), "sequence": ("seqAto", "seq_ato"), "year": ("valorAno", "vlr_ano"),
    "organ": ("orgao", "sgl_orgao"), "module": ("cod_modulo",), "menu": ("cod_menu",),
}


def act_of_url(url: Column) -> Column:
    """``kind, number, sequence, year, organ, module, menu`` of the act that a URL names; null if one that has no default lacks."""
    parts = {name: url_value(url, *names) for name, names in ACT_PARAMETERS.items()}
    parts["sequence"], parts["module"] = F.coalesce(parts["sequence"], F.lit("000")), F.coalesce(parts["module"], F.lit("566"))
    whole = F.lit(True)
    for value in parts.values():
        whole = whole & value.isNotNull()
    return F.when(whole, F.struct(*[v.alias(k) for k, v in parts.items()]))


def first_url(urls: Column) -> Column:
    """The first of some URLs between bars."""
    return F.trim(F.get(F.split(F.coalesce(urls, F.lit("")), r"\|"), F.lit(0)))


def register_functions(spark) -> None:
    """``company_name(text)`` as a SQL function: a company's telling words in one form. It is a SQL body, so calls stay in the JVM."""
    words = ", ".join(f"'{w}'" for w in COMPANY_STOP_WORDS)
    plain = f"regexp_replace(translate(coalesce(t, ''), '{ACCENTED}', '{BARE}'), '\\\\p{{Mn}}+', '')"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION company_name(t STRING) RETURNS STRING
        RETURN array_join(filter(regexp_extract_all(lower({plain}), '([a-z0-9]+)', 1), w -> w NOT IN ({words})), ' ')"""
    )


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(normalize(name), "[^a-z0-9]+", "_"), F.lit("_"))


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("1", "true", "sim", "s", "yes", "y")


def locale_number(text: Column) -> Column:
    """``1.234,56`` as a double; 0 for what isn't a number."""
    plain = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))
