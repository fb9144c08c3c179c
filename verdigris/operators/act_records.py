"""Records of acts from their pages: each field is the first that its rules find in the page's paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import legal
from verdigris.functions.dates import advance, day_month_year
from verdigris.functions.html import paragraphs
from verdigris.functions.text import act_of_url, normalize

#: Paragraphs in which a title may stand, and characters of the preview.
FIRST, PREVIEW = 12, 500
#: What a title says before its number, and what speaks of the end of validity.
NUMBERED = r"\bn[o.º°]?\s*[0-9]"
UNTIL = r"\b(?:vigora|valida|validade|vigencia)[a-z]*\b.{0,40}\bate\b"


def act_title(found: Column, kind: Column) -> Column:
    """The first of the first paragraphs that names the act's kind and a number."""
    head = F.slice(found, 1, FIRST)
    fits = lambda p: F.contains(normalize(p), normalize(F.coalesce(kind, F.lit("")))) & F.rlike(normalize(p), F.lit(NUMBERED))
    return F.get(F.filter(head, fits), F.lit(0))


def act_records(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``pages`` with ``act``: kind, number, year and organ from the URL, title, summary and dates from the page's paragraphs, in one projection.

    - Title: see ``act_title``; without one, kind, number, organ and year. Signed: the date in the title.
    - Published: the first date of a paragraph that speaks of publication, else the title's.
    - Start: a delay counted from publication, else the date that a paragraph states, else the publication; ``rule`` says which.
    - End: the date of the first paragraph that says until when the act holds. ``delay``: the days from publication to start.
    - ``n_paragraphs``, ``sha1`` of the page and a ``preview`` of the text.

    Pages whose URL names no act, or without paragraphs, have nulls in the fields concerned.
    """
    ref = act_of_url(F.col(url))
    rows = pages.withColumns({"_p": paragraphs(F.col(html)), "_ref": ref})
    said, p = F.array_join("_p", "\n"), F.col("_p")
    kind, number = F.col("_ref.kind"), F.regexp_replace(F.col("_ref.number"), "^0+(?=[0-9])", "")
    rows = rows.withColumn("_title", F.coalesce(act_title(p, kind), F.when(kind.isNotNull(), F.concat_ws(" ", kind, number, F.col("_ref.organ"), F.col("_ref.year")))))
    rows = rows.withColumn("_signed", day_month_year(F.col("_title")))
    rows = rows.withColumn("_published", F.coalesce(legal.publication_date(said), F.col("_signed")))
    delays = F.array_compact(F.transform(p, legal.relative_start))
    delay = F.get(delays, F.lit(0))
    stated = F.get(F.array_compact(F.transform(p, legal.explicit_start)), F.lit(0))
    later = advance(F.col("_published"), delay["amount"], delay["unit"])
    start = F.coalesce(later, stated, F.col("_published"))
    until = F.get(F.array_compact(F.transform(F.filter(p, lambda x: F.rlike(normalize(x), F.lit(UNTIL))), day_month_year)), F.lit(0))
    days = F.datediff(start, F.col("_published"))
    act = F.struct(
        kind.alias("kind"), number.alias("number"), F.col("_ref.year").alias("year"), F.col("_ref.sequence").alias("sequence"), F.col("_ref.organ").alias("organ"),
        F.col("_title").alias("title"), legal.ementa(p).alias("summary"), F.col("_signed").alias("signed"), F.col("_published").alias("published"), start.alias("start"),
        F.when(later.isNotNull(), "delay").when(stated.isNotNull(), "stated").when(F.col("_published").isNotNull(), "publication").alias("rule"),
        F.when(days >= 1, days).alias("delay"), until.alias("end"), F.size(p).alias("n_paragraphs"), F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("sha1"), F.left(said, F.lit(PREVIEW)).alias("preview"),
    )
    return rows.withColumn("act", act).drop("_p", "_ref", "_title", "_signed", "_published")
