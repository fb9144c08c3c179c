"""Titles, periods and lines of evidence for chosen records; overlap scores; summaries for an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import normalize


def _filled(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)


def act_title(kind: Column, number: Column, year: Column, name: Column) -> Column:
    """"Portaria 12/2018" from what is known, else the document's name."""
    numbered = F.concat_ws("/", _filled(number), _filled(year))
    title = F.concat_ws(" ", F.initcap(_filled(kind)), F.when(numbered != "", numbered))
    return F.coalesce(F.when(_filled(number).isNotNull(), title), _filled(name), F.lit(""))


def period_text(first: Column, last: Column) -> Column:
    """A day, a whole month, a whole year, or from day to day."""
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    year = (F.date_format(first, "MM-dd") == "01-01") & (F.date_format(last, "MM-dd") == "12-31") & (F.year(first) == F.year(last))
    month = (F.dayofmonth(first) == 1) & (last == F.last_day(first))
    return (
        F.when(first.isNull() & last.isNull(), "sem data")
        .when(last.isNull(), F.concat(F.lit("desde "), day(first)))
        .when(first.isNull(), F.concat(F.lit("até "), day(last)))
        .when(first == last, day(first))
        .when(year, F.year(first).cast("string"))
        .when(month, F.date_format(first, "MM/yyyy"))
        .otherwise(F.concat_ws(" a ", day(first), day(last)))
    )


def metadata_line(fields: dict[str, Column]) -> Column:
    """``label: value`` of the filled fields, joined by bars; null if none is filled."""
    parts = [F.concat(F.lit(f"{label}: "), _filled(value)) for label, value in fields.items()]
    line = F.concat_ws(" | ", *parts)
    return F.when(line != "", line)


def evidence_block(base: Column, doc: Column, page: Column, line: Column, text: Column, width: int = 600) -> Column:
    """A record's evidence: base, document and page, its metadata, and the beginning of its text as one paragraph."""
    head = metadata_line({"Base": base, "Documento": doc, "Página": page})
    return F.concat_ws("\n", head, line, F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, width))


#: What is added for a phrase in the title, in the text, for an act's number and for its year.
BONUSES = (0.25, 0.2, 0.2, 0.15)


def question_overlap(question: str, title: Column, text: Column, number: str | None = None, year: int | None = None) -> Column:
    """Share of the question's words of more than three characters that occur in title or text, with bonuses."""
    from verdigris.plans.routing import plain

    asked = plain(question)
    words = [w for w in dict.fromkeys(asked.split()) if len(w) > 3]
    name, body = normalize(title), normalize(F.concat_ws(" ", title, text))
    if not words:
        return F.lit(0.0)
    hits = sum((F.contains(body, F.lit(w)).cast("double") for w in words), F.lit(0.0)) / float(len(words))
    a, b, c, d = BONUSES
    flag = lambda test, value: F.when(test, value).otherwise(0.0)
    extra = flag(F.contains(name, F.lit(asked)), a) + flag(F.contains(body, F.lit(asked)), b)
    extra = extra + (flag(F.contains(name, F.lit(number)), c) if number else F.lit(0.0)) + (flag(F.contains(name, F.lit(str(year))), d) if year else F.lit(0.0))
    return F.when(hits > 0, hits + extra).otherwise(0.0)


def group_summary(rows: DataFrame, group: str, title: str, order: str, most: int = 8) -> DataFrame:
    """Titles of each group, each once, in order, at most ``most``: ``group, n, titles``."""
    first = rows.groupBy(group, title).agg(F.min(order).alias("_o"))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    ranked = first.withColumn("n", n).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_o", title)))
    short = ranked.where(F.col("_k") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_k", F.col(title).alias("t")))), lambda x: x["t"])
    return short.groupBy(group).agg(F.first("n").alias("n"), F.array_join(listed, "; ").alias("titles"))


def reference_checks(chunks: DataFrame, id_col: str, text_col: str, references: list[str], window: int = 160) -> DataFrame:
    """For each article that an answer names, the chunks that hold it with the text around it: ``reference, id, snippet``."""
    rows = []
    for ref in dict.fromkeys(references):
        pattern = rf"(?is)(.{{0,{window}}}\bart(?:igo|\.)?\s*{ref}(?![0-9]).{{0,{window}}})"
        snippet = F.regexp_extract(text_col, pattern, 1)
        rows.append(F.struct(F.lit(ref).alias("reference"), F.when(snippet != "", F.trim(F.regexp_replace(snippet, r"\s+", " "))).alias("snippet")))
    if not rows:
        return chunks.select(F.lit(None).cast("string").alias("reference"), id_col, F.lit(None).cast("string").alias("snippet")).limit(0)
    return chunks.select(id_col, F.explode(F.array(*rows)).alias("r")).select("r.reference", id_col, "r.snippet").where("snippet is not null")
