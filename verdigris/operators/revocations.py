"""Revocations: what a text's head says, which act is meant, what of it is present, reports over all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.dates import MONTHS, day_month_year
from verdigris.functions.text import normalize
from verdigris.operators.ranking import first_of_each

#: Lines and characters of the head that are read, kinds of acts that are told apart.
HEAD_LINES, HEAD_CHARS = 12, 1_200
KINDS = ("portaria", "decreto", "lei", "resolucao", "instrucao normativa", "medida provisoria")
STAMP = r"^\s*([0-9]{1,2}/[0-9]{1,2}/(?:(?:19|20)[0-9]{2}|[0-9]{2}))\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"
#: What a revocation's signal is worth.
HIGH, MIDDLE, LOW = "alta", "media", "baixa"
#: Matches that a report names at most.
NAMED = 8


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def without_stamp(text: Column) -> Column:
    """A text without the date and time of a print at its head."""
    return F.trim(F.regexp_replace(squeezed(text), STAMP, ""))


def stamp_date(text: Column) -> Column:
    """The date of the print at a text's head, or null."""
    found = F.regexp_extract(squeezed(text), STAMP, 1)
    return F.when(found != "", day_month_year(found))


def reference_parts(said: Column) -> Column:
    """``kind, number, year, date`` of an act as a text names it; null where it says nothing of them."""
    both = r"\b([0-9]{1,6}) ?/ ?((?:19|20)[0-9]{2})\b"
    dated = rf"\b([0-9]{{1,2}}o? de (?:{'|'.join(MONTHS)}) de [0-9]{{4}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})\b"

    def parts(text: Column) -> Column:
        kind = F.regexp_extract(text, rf"\b({'|'.join(KINDS)})\b", 1)
        number = F.coalesce(_filled(F.regexp_extract(text, both, 1)), _filled(F.regexp_extract(text, r"\b(?:n[o.]? ?)?([0-9]{1,6})\b", 1)))
        year = F.coalesce(_filled(F.regexp_extract(text, both, 2)), _filled(F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1))).cast("int")
        dates = once(_filled(F.regexp_extract(text, dated, 1)), day_month_year)
        return once(dates, lambda date: F.struct(_filled(kind).alias("kind"), number.alias("number"), F.coalesce(year, F.year(date)).alias("year"), date.alias("date")))

    return once(normalize(said), parts)


def _filled(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def head_revocation(text: Column) -> Column:
    """``status, said, mode, kind, number, year, date`` of the revocation that a text's head states; null without one.

    A line among the first twelve that begins with it counts (``line``), else a clause in the first 1,200 characters (``inline``).
    """
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), squeezed), lambda x: x != ""), 1, HEAD_LINES)
    whole = r"(?i)^(parcialmente )?revogad[ao]s? pela (.+)$"
    inside = r"(?i)\b(parcialmente )?revogad[ao]s? pela ([^.\n]{6,220})"
    line = F.get(F.filter(lines, lambda x: F.rlike(x, F.lit(whole))), F.lit(0))
    clause = once(squeezed(F.substring(text, 1, HEAD_CHARS)), lambda head: F.when(F.rlike(head, F.lit(inside)), head))

    def stated(line: Column, clause: Column) -> Column:
        mode = F.when(line.isNotNull(), "line").when(clause.isNotNull(), "inline")
        part = lambda k: F.when(line.isNotNull(), F.regexp_extract(line, whole, k)).otherwise(F.regexp_extract(clause, inside, k))
        status = F.when(part(1) != "", "parcialmente_revogado").otherwise("revogado")
        fields = lambda said, found: F.struct(status.alias("status"), said.alias("said"), mode.alias("mode"), *[found[c].alias(c) for c in ("kind", "number", "year", "date")])
        return F.when(mode.isNotNull(), once(F.trim(part(2)), lambda said: once(reference_parts(said), lambda found: fields(said, found))))

    # What neither can match without: most texts go no further.
    told = F.rlike(text, F.lit(r"(?i)revogad[ao]s?\s+pela\s"))
    return F.when(told, once(F.struct(line.alias("line"), clause.alias("clause")), lambda x: stated(x["line"], x["clause"])))


def revoker_score(said: Column, kind: Column, number: Column, year: Column, name: Column, title: Column, known: Column) -> Column:
    """How well an act fits a mention: its file's name equals it (100) or one holds the other (70); its kind (20), number (15) and year (10)
    in the name and in the title count each; a known id adds 1."""
    asked, real, shown = normalize(said), normalize(name), normalize(title)
    both = F.contains(real, asked) | F.contains(asked, real)
    points = F.when((asked != "") & (real == asked), 100).when((asked != "") & both, 70).otherwise(0)
    for part, value in ((normalize(kind), 20), (number.cast("string"), 15), (year.cast("string"), 10)):
        given = F.coalesce(part != "", F.lit(False))
        for text in (real, shown):
            points = points + F.when(given & F.contains(text, part), value).otherwise(0)
    return points + F.when(known.isNotNull() & (known.cast("string") != ""), 1).otherwise(0)


def best_revokers(mentions: DataFrame, acts: DataFrame, doc: str) -> DataFrame:
    """``doc, target, score``: for each mention the act that is meant, never the document itself.

    ``mentions``: ``doc, said, kind, number, year``; ``acts``: ``target, name, title, kind, number, year``. Acts meet mentions by kind, number
    and year; equal scores go to the later name.
    """
    rows = mentions.join(acts, ["kind", "number", "year"]).where(F.col("target") != F.col(doc))
    score = revoker_score(*[F.col(c) for c in ("said", "kind", "number", "year", "name", "title", "target")])
    best = first_of_each(rows.withColumn("score", score), [doc], [F.desc("score"), F.desc(normalize(F.col("name"))), F.col("target")])
    return best.select(doc, "target", "score")


def signal_quality(mode: Column, complete: Column) -> Column:
    """``alta``: a line of its own that names kind, number and year; ``media``: these elsewhere but in a clause; else ``baixa``."""
    return F.when((mode == "line") & complete, HIGH).when(complete & ~F.coalesce(mode == "inline", F.lit(False)), MIDDLE).otherwise(LOW)


def best_rows(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """Of each document's chunks that name a revoker (``said, mode, kind, number, year, date, confidence``) the best, with ``chunks`` and ``quality``.

    A line beats no mode and that a clause; then a complete key, a date, a confidence, a shorter mention; the first chunk wins ties.
    """
    named = rows.where(F.coalesce(F.trim("said"), F.lit("")) != "")
    complete = F.col("kind").isNotNull() & F.col("number").isNotNull() & F.col("year").isNotNull()
    mode = F.when(F.col("mode") == "line", 3).when(F.col("mode") == "inline", 1).otherwise(2)
    # The least by these; a null order comes first. One aggregation has the best and the number, so what heads say is read once.
    ranks = F.struct(-mode, ~complete, F.col("date").isNull(), F.col("confidence").isNull(), F.length("said"), F.col(order))
    whole = F.struct(*rows.columns, complete.alias("complete"))
    best = named.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("_doc")).agg(F.min_by(whole, ranks).alias("_best"), F.count(F.lit(1)).alias("chunks"))
    return best.select("_best.*", "chunks").withColumn("quality", signal_quality(F.col("mode"), F.col("complete")))


def distinct_revokers(rows: DataFrame, stores: list[str]) -> DataFrame:
    """One row for each revoker of ``key, said, doc, mode, quality, complete`` and for each store ``in_<store>`` (boolean) and ``found_<store>`` (array).

    Rows meet by key, those without one by what they say. Flags are joined by or, the best quality and the shortest mention stand for
    all, names are united and at most eight are shown.
    """
    key = F.coalesce(_filled(F.col("key")), F.concat(F.lit("raw::"), normalize(F.col("said"))))
    rank = F.when(F.col("quality") == HIGH, 3).when(F.col("quality") == MIDDLE, 2).otherwise(1)
    joined = lambda c: F.concat_ws(" | ", F.array_sort(c))
    sums = [
        F.min_by("said", F.struct(F.length("said"), "said")).alias("said"),
        F.max(rank).alias("_rank"),
        F.bool_or("complete").alias("complete"),
        F.concat_ws(", ", F.array_sort(F.collect_set(_filled(F.col("mode"))))).alias("modes"),
        F.count(F.lit(1)).alias("revoked"),
        joined(F.collect_list("doc")).alias("docs"),
    ]
    for s in stores:
        united = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(f"found_{s}")))))
        sums += [F.bool_or(f"in_{s}").alias(f"in_{s}"), F.concat_ws(" | ", F.slice(united, 1, NAMED)).alias(f"found_{s}")]
    out = rows.withColumn("_key", key).groupBy("_key").agg(*sums)
    quality = F.when(F.col("_rank") == 3, HIGH).when(F.col("_rank") == 2, MIDDLE).otherwise(LOW)
    return out.select(F.col("_key").alias("key"), "said", "complete", quality.alias("quality"), F.when(F.col("modes") == "", "(vazio)").otherwise(F.col("modes")).alias("modes"), "revoked", "docs", *[f"{a}_{s}" for s in stores for a in ("in", "found")])


def coverage_metrics(distinct: DataFrame, stores: list[str], facts: dict[str, object] | None = None) -> DataFrame:
    """``metric, value``: facts that the caller states, then numbers of revokers, present and absent by store, complete, of low quality."""
    sums = {"revoked_with_revoker": F.sum("revoked"), "distinct_revokers": F.count(F.lit(1))}
    for s in stores:
        sums |= {f"present_in_{s}": F.count_if(F.col(f"in_{s}")), f"absent_in_{s}": F.count_if(~F.col(f"in_{s}"))}
    sums |= {"complete_keys": F.count_if(F.col("complete")), "low_quality": F.count_if(F.col("quality") == LOW)}
    row = distinct.agg(*[F.coalesce(c, F.lit(0)).cast("string").alias(name) for name, c in sums.items()])
    entries = [F.struct(F.lit(k).alias("metric"), F.lit(str(v)).alias("value")) for k, v in (facts or {}).items()]
    entries += [F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in sums]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def passive_summary(events: DataFrame, act: str, order: str) -> DataFrame:
    """What became of each act by ``event, direction, path, said``: ``status, scope, said, date, ends, partial``.

    An act that others revoke is revoked as a whole if any such event names no provision; the first of those, else the first of all,
    names the revoker. Acts without such an event are in force.
    """
    passive = (F.col("event") == "revogacao") & (F.col("direction") == "passiva")
    whole = F.coalesce(F.trim("path"), F.lit("")) == ""
    first = F.min_by(F.when(passive, F.col("said")), F.when(passive, F.struct(~whole, F.col(order))))
    rows = events.groupBy(act).agg(F.bool_or(passive).alias("_any"), F.bool_or(passive & whole).alias("_whole"), F.bool_or(passive & ~whole).alias("_part"), first.alias("_said"))
    date = day_month_year(F.col("_said"))
    say = lambda a, b, c: F.when(~F.col("_any"), a).when(F.col("_whole"), b).otherwise(c)
    return rows.select(
        act,
        say("vigente", "revogado", "parcialmente_revogado").alias("status"),
        say("", "total", "parcial").alias("scope"),
        F.coalesce("_said", F.lit("")).alias("said"),
        date.alias("date"),
        F.when(F.col("_whole"), date).alias("ends"),
        F.coalesce("_part", F.lit(False)).alias("partial"),
    )


def representatives(chunks: DataFrame, doc: str, order: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first chunk of each document, and ``key, docs``: the documents of each kind, number and year, in order."""
    first = first_of_each(chunks, [doc], [F.col(order)])
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return first, first.where(complete).groupBy(*key).agg(F.array_sort(F.collect_set(doc)).alias("docs"))


def missing_acts(references: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Acts that texts refer to and no store holds, the most referred to first: ``key, times``."""
    rows = references.join(held.select(key).distinct(), key, "left_anti")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), key)


def mend_starts(sheet: DataFrame, published: str, start: str) -> DataFrame:
    """A sheet's dates with ``start`` after publication (the next day where it isn't) and ``vacatio_days`` between them, one at least."""
    fixed = F.when(F.col(start).isNull() | (F.col(start) <= F.col(published)), F.date_add(published, 1)).otherwise(F.col(start))
    changed = F.coalesce(fixed != F.col(start), F.lit(True)) & F.col(published).isNotNull()
    kept = F.when(F.col(published).isNull(), F.col(start)).otherwise(fixed)
    days = F.greatest(F.datediff(kept, published), F.lit(1))
    return sheet.withColumns({"_start": kept, "vacatio_days": F.when(F.col(published).isNotNull(), days), "changed": changed}).drop(start).withColumnRenamed("_start", start)


def texts_of(chunks: DataFrame, doc: str, order: list[str], text: str, most: int = 12) -> DataFrame:
    """``doc, texts``: a document's first chunks as one text, in order."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    rows = chunks.withColumn("_n", n).where(F.col("_n") <= most)
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("texts"))
