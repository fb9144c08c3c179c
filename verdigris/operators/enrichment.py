"""Metadata enrichment of chunks: names, revokers, dates by ladders, sanity rules, one consensus for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import legal
from verdigris.functions.dates import advance, iso_date
from verdigris.functions.text import normalize
from verdigris.operators.curation import consensus, exact_then_normalized
from verdigris.operators.ranking import first_of_each
from verdigris.operators.temporal import canonical_status, effective_end, effective_start


def start_ladder(text: Column, published: Column, stated: Column) -> Column:
    """A delayed start counted from publication, an explicit date in the text, what the metadata state, the publication."""
    delay = legal.relative_start(text)
    return F.coalesce(advance(published, delay["amount"], delay["unit"]), legal.explicit_start(text), effective_start(stated), published)


def sane_status(status: Column, own_year: Column, revoker_year: Column) -> Column:
    """A revoker older than the act can't have revoked it: then it is in force."""
    s = canonical_status(status)
    return F.when((s == "revogado") & (revoker_year < own_year), "vigente").otherwise(s)


def sane_end(end: Column, revoker_start: Column, revoker_year: Column, published: Column) -> Column:
    """The revoker's start, unless before the act's own publication; else the stated end, whose year counts alone where the
    revoker's differs by two or more."""
    far = F.abs(F.year(end) - revoker_year) >= 2
    stated = F.when(F.coalesce(far, F.lit(False)), F.make_date(revoker_year, F.lit(12), F.lit(31))).otherwise(end)
    follows = revoker_start.isNotNull() & (published.isNull() | (revoker_start >= published))
    return F.when(follows, revoker_start).otherwise(stated)


def enrich(chunks: DataFrame, metadata: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Chunks (``doc, text``) with ``status, published, start, end, vacatio_days, matched`` from metadata and their own texts.

    ``metadata``: ``doc_name, meta_id, status, start_text, end_text, revoker_start, revoker_year, own_year``. Publication and start are
    settled for each document: the date nearest to its year, and of its chunks' starts the one farthest from publication,
    as most chunks only repeat the publication.
    """
    ids = chunks.select(doc).distinct()
    matched = exact_then_normalized(ids, metadata.select(F.col("doc_name"), "meta_id"), doc, "doc_name", "meta_id")
    facts = matched.join(metadata.drop("doc_name"), "meta_id", "left")
    said = chunks.select(doc, text).withColumn("published", legal.publication_date(F.col(text)))
    reference = facts.select(doc, F.make_date(F.col("own_year"), F.lit(1), F.lit(1)).alias("reference"))
    published = consensus(said.join(reference, doc).select(doc, "published", "reference"), doc, "published", "reference")
    facts = facts.join(published.select(doc, F.col("consensus").alias("published")), doc, "left")
    rows = chunks.join(facts, doc, "left").withColumn("start", start_ladder(F.col(text), F.col("published"), F.col("start_text")))
    found = rows.where("start is not null").select(doc, "start", F.abs(F.datediff("start", "published")).alias("_gap"))
    starts = first_of_each(found, [doc], [F.desc_nulls_last("_gap"), F.col("start")]).drop("_gap")
    rows = rows.drop("start").join(starts, doc, "left")
    end = sane_end(effective_end(F.col("end_text")), F.col("revoker_start"), F.col("revoker_year"), F.col("published"))
    status = sane_status(F.col("status"), F.col("own_year"), F.col("revoker_year"))
    days = F.datediff("start", "published")
    return rows.select(
        *[F.col(f"`{c}`") for c in chunks.columns],
        status.alias("status"),
        "published",
        "start",
        F.when(status != "vigente", end).alias("end"),
        F.when(days >= 1, days).alias("vacatio_days"),
        "matched",
    )


def propagate_ends(acts: DataFrame, key: str, by: str) -> DataFrame:
    """A revoked act ends where its revoker starts (the least start of several rows), unless before it was published."""
    starts = acts.groupBy(F.col(key).alias(by)).agg(F.min("start").alias("_start"))
    joined = acts.join(starts, by, "left")
    ends = F.when((canonical_status(F.col("status")) == "revogado") & F.col("_start").isNotNull() & (F.col("published").isNull() | (F.col("_start") >= F.col("published"))), F.col("_start"))
    return joined.withColumn("end", F.coalesce(ends, F.col("end"))).select(*acts.columns)


def apply_sheet(chunks: DataFrame, updates: DataFrame, doc: str, columns: dict[str, str]) -> DataFrame:
    """Chunks with a sheet's values (``doc`` in common form); a blank cell changes nothing."""
    from verdigris.functions.text import alnum_key

    new = updates.select(F.col(doc).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    rows = chunks.withColumn("_key", alnum_key(F.col(doc))).join(new, "_key", "left")
    filled = {t: F.coalesce(F.when(F.trim(F.col(f"_new_{c}")) != "", F.coalesce(F.date_format(iso_date(F.col(f"_new_{c}")), "yyyy-MM-dd"), F.col(f"_new_{c}"))), F.col(t)) for c, t in columns.items()}
    return rows.withColumns(filled).select(*chunks.columns)


def number_ids(new: DataFrame, current: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows that the index lacks, with ids that go on from its greatest; numbered by range partitions and their offsets."""
    missing = new.join(current.select(key), key, "left_anti")
    top = current.agg(F.coalesce(F.max(id_col), F.lit(-1))).first()[0]
    # Ids follow the keys' hashes, which deal the rows to buckets of bounded size; a bucket's offset is the sum of those before it.
    bucket = F.pmod(F.xxhash64(key), F.lit(1024)).cast("int")
    rows = missing.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(key))).join(F.broadcast(sizes.drop("count")), "_b")  # 1,024 rows
    return placed.withColumn(id_col, F.lit(top) + F.col("_before") + F.col("_n")).select(*new.columns, id_col)
