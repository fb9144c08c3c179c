"""Enrichment in its order: what a document's own texts say of its revocation and dates, and ends that follow settled revokers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.dates import all_dates, day_month_year
from verdigris.functions.text import normalize
from verdigris.session import drop_staged, staged

#: Words of lines that speak of publication, and how much of a text is its head and its tail.
MARKER = r"\b(publicad[oa]|d\.?o\.?u\.?|diario oficial|bie)\b"
HEAD, TAIL = 1400, 1200
#: Where a date was found, best first.
BUCKETS = ("markers", "title", "head", "tail")
#: Statuses beside which a revocation inside a sentence isn't believed.
UNTOUCHED = ("vigente", "nao_normativo", "indeterminado", "vacatio")
REVOKED, PARTLY = "revogado", "parcialmente_revogado"


def _dated(text: Column) -> Column:
    """All dates of a text, that of its first written-out one too."""
    return F.array_distinct(F.concat(all_dates(text), F.array_compact(F.array(day_month_year(text)))))


def publication_buckets(text: Column, title: Column, name: Column) -> Column:
    """The dates of a chunk as structs ``bucket, date``: lines with a marker, title and file name, the text's head, its tail."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(normalize(x), F.lit(MARKER)))
    named = F.concat(_dated(F.coalesce(title, F.lit(""))), _dated(F.coalesce(name, F.lit(""))))
    found = (F.flatten(F.transform(lines, _dated)), named, _dated(F.left(text, F.lit(HEAD))), _dated(F.right(text, F.lit(TAIL))))
    marked = lambda dates, i: F.transform(dates, lambda d: F.struct(F.lit(i).alias("bucket"), d.alias("date")))
    return F.concat(*[marked(dates, i) for i, dates in enumerate(found)])


def publication_dates(chunks: DataFrame, doc: str, text: str, title: str, year: str) -> DataFrame:
    """``doc, published, bucket``: the publication of each document, from the best bucket that has dates in any of its chunks.

    In a bucket the date nearest to the act's year counts, the earlier of equally near ones; without a year the earliest. All this is the
    least of one struct for each document, so chunks are combined where they lie and no document's dates are gathered. A document without any
    date has nulls; a null document name is one document.
    """
    hints = chunks.groupBy(doc).agg(F.min(F.col(year)).alias("_year"))
    known = hints.withColumnRenamed(doc, "_doc")
    rows = chunks.select(doc, F.explode_outer(publication_buckets(F.col(text), F.col(title), F.col(doc))).alias("d"))
    near = F.coalesce(F.abs(F.year("d.date") - F.col("_year")), F.lit(0))
    ranked = rows.join(known, F.col(doc).eqNullSafe(F.col("_doc")))
    best = ranked.groupBy(doc).agg(F.min(F.when(F.col("d.date").isNotNull(), F.struct(F.col("d.bucket").alias("bucket"), near.alias("near"), F.col("d.date").alias("date")))).alias("best"))
    return best.select(doc, F.col("best.date").alias("published"), F.get(F.array(*[F.lit(b) for b in BUCKETS]), F.col("best.bucket")).alias("bucket"))


def believed_revocation(said: Column, mode: Column, partial: Column, status: Column, kind: Column, some_provisions: Column) -> Column:
    """What is left of a revocation that a document's own text says, beside its metadata: ``status, kind, ends``; null if nothing is.

    ``said``: the status that the text gives; ``mode``: ``line`` if it stands on a line of its own, ``inline`` if inside a sentence;
    ``partial``: it names provisions. ``status``, ``kind``, ``some_provisions``: the metadata's. Metadata that speak of a partial revocation yield
    only to a whole line of a total one, else the revocation is partial and ends nothing. Total revocations inside a sentence aren't
    believed where the metadata call the act untouched.
    """
    plain = lambda c: normalize(F.coalesce(c, F.lit("")))
    total = said == REVOKED
    yes = F.coalesce(some_provisions.cast("boolean"), F.lit(False))
    prefers_partial = (plain(kind) == "parcial") | (yes & (plain(status) != REVOKED))
    strong = total & (mode == "line") & ~F.coalesce(partial, F.lit(False))
    settled = F.when(prefers_partial & strong, F.struct(F.lit(REVOKED).alias("status"), F.lit("total").alias("kind"), F.lit(True).alias("ends")))
    settled = settled.when(prefers_partial, F.struct(F.lit(PARTLY).alias("status"), F.lit("parcial").alias("kind"), F.lit(False).alias("ends")))
    doubted = total & (mode == "inline") & plain(status).isin(*UNTOUCHED)
    own = F.struct(said.alias("status"), F.when(total, "total").otherwise("parcial").alias("kind"), total.alias("ends"))
    return F.when(said.isNull(), F.lit(None)).otherwise(settled.when(doubted, F.lit(None)).otherwise(own))


def settle_ends(acts: DataFrame, key: str, by: str, published: str, start: str, end: str) -> DataFrame:
    """``acts`` with ``settled_end, settled_by, state``: ends follow the starts of revokers that are themselves settled.

    - An act without a revoker, or whose revoker isn't in the table, keeps its stated end (state ``stated``).
    - Else it is settled once its revoker is. A revoker that ended before it began, or on that day, was never in force: it passes the act
      on to the revoker that settled it, if it has one (``settled_by``). The act ends when that one starts, unless that is unknown or before its own
      publication: then the stated end stands (state ``settled``).
    - Acts that revoke each other in a circle, and those behind one, can't be settled: they keep their stated end (``circle``).

    Each round settles the acts whose revokers the round before settled, so there are as many as the longest chain has acts; what is settled is staged
    and a round joins the rest with the last round's acts alone. Keys are unique; an act that names itself is a circle.
    """
    rows = staged(acts.select(F.col(key).alias("key"), F.col(by).alias("by"), F.col(published).alias("published"), F.col(start).alias("start"), F.col(end).alias("end")), "acts")
    known = rows.select(F.col("key").alias("by"))
    empty = F.lit(None).cast(rows.schema["key"].dataType)
    # Acts without a revoker, most of them, meet none: in a join their nulls would all go to one task.
    alone = rows.where("by IS NULL").unionByName(rows.where("by IS NOT NULL").join(known, "by", "left_anti").select(*rows.columns))
    free = alone.select("key", "start", F.col("end").alias("settled_end"), empty.alias("settled_by"), empty.alias("start_by"), F.lit("stated").alias("state"))
    free = free.withColumn("start_by", F.lit(None).cast(rows.schema["start"].dataType))
    last = staged(free, "settled")
    done, left, own = [last], staged(rows.join(known, "by", "left_semi"), "unsettled"), [rows]
    while not last.isEmpty() and not left.isEmpty():
        # Of the last round: an act's own start, and whether it was ever in force; else who stands in for it, with their start.
        void = F.coalesce(F.col("settled_end") <= F.col("start"), F.lit(False)) & F.col("settled_by").isNotNull()
        revokers = last.select(F.col("key").alias("by"), F.when(void, F.col("settled_by")).otherwise(F.col("key")).alias("settled_by"), F.when(void, F.col("start_by")).otherwise(F.col("start")).alias("start_by"))
        follows = F.col("start_by").isNotNull() & (F.col("published").isNull() | (F.col("start_by") >= F.col("published")))
        met = left.join(revokers, "by").select("key", "start", F.when(follows, F.col("start_by")).otherwise(F.col("end")).alias("settled_end"), "settled_by", "start_by", F.lit("settled").alias("state"))
        last = staged(met, "settled")
        rest = staged(left.join(last.select("key"), "key", "left_anti"), "unsettled")
        own.append(left)
        done.append(last)
        left = rest
    circles = left.select("key", "start", F.col("end").alias("settled_end"), empty.alias("settled_by"), F.lit(None).cast(rows.schema["start"].dataType).alias("start_by"), F.lit("circle").alias("state"))
    whole = circles
    for part in done:
        whole = whole.unionByName(part)
    drop_staged(*own)
    return acts.join(whole.select(F.col("key").alias(key), "settled_end", "settled_by", "state"), key)
