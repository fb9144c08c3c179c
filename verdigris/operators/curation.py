"""Corpus curation: differences between states, fingerprints, consensus, impacts, coverage, rule labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from verdigris.functions.text import alnum_key, normalize


def registry_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change``: added, removed, modified or same."""
    a = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
        .otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def fingerprint(chunks: DataFrame, doc: str, chunk_id: str, text: str) -> DataFrame:
    """``doc, n_chunks, fingerprint``: SHA-256 over the chunks' ids and text digests in order. Texts don't leave their task.

    The digest of a group runs over its sorted lines as they come, so that no group is ever gathered in a row or in
    memory. Lines of one group go through one task, as SHA-256 has no parts that could be put together: some 80 bytes a chunk.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = chunks.select(F.col(doc).alias("doc"), F.col(chunk_id).alias("id"), digest.alias("d")).repartition("doc").sortWithinPartitions("doc", "id", "d")
    # A chunk without an id is counted and has no line.
    lines = rows.select("doc", F.concat(F.col("id").cast("string"), F.lit("\x1f"), "d", F.lit("\n")).alias("line"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        current, sha, n = None, None, 0
        for batch in batches:
            done = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sha is None or key != current:
                    if sha is not None:
                        done.append((current, n, sha.hexdigest()))
                    current, sha, n = key, hashlib.sha256(), 0
                n += 1
                if line is not None:
                    sha.update(line.encode())
            if done:
                yield made(pa, done, batch.schema.field(0).type)
        if sha is not None:
            yield made(pa, [(current, n, sha.hexdigest())], batch.schema.field(0).type)

    def made(pa, rows, kind):
        keys, counts, digests = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(counts, pa.int32()), pa.array(digests, pa.string())], names=[doc, "n_chunks", "fingerprint"])

    schema = StructType([StructField(doc, chunks.schema[doc].dataType), StructField("n_chunks", IntegerType()), StructField("fingerprint", StringType())])
    return lines.mapInArrow(run, schema)


def upsert(current: DataFrame, updates: DataFrame, key: list[str], keep_old_where_null: list[str] | None = None) -> DataFrame:
    """``current`` with the rows of ``updates`` in place of those with their keys; listed columns keep the old value where
    the new one is null."""
    kept = current.join(updates.select(*key), key, "left_anti")
    if keep_old_where_null:
        old = current.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep_old_where_null])
        joined = updates.join(old, key, "left")
        updates = joined.select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in keep_old_where_null else F.col(c) for c in current.columns])
    return kept.unionByName(updates.select(*current.columns))


def delete_documents(rows: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    return rows.join(documents.select(key), key, "left_anti")


def delete_by_prefix(rows: DataFrame, prefixes: list[str], id_col: str) -> DataFrame:
    """Rows whose id begins with none of the prefixes. A document's name is the prefix of its chunks' ids, and of those of
    documents whose names begin with it: these go as well, as in the index that this stands for."""
    keep = reduce(lambda a, b: a & b, [~F.col(id_col).startswith(p) for p in prefixes], F.lit(True))
    return rows.where(F.coalesce(keep, F.lit(True)))


def exact_then_normalized(rows: DataFrame, lookup: DataFrame, name: str, lookup_name: str, value: str) -> DataFrame:
    """``value`` by the exact name, else by the normalised one (there the lookup's first name wins). Equal names: the greatest value."""
    exact = lookup.groupBy(F.col(lookup_name).alias(name)).agg(F.max(value).alias("_exact"))
    first = Window.partitionBy("_key").orderBy(lookup_name)
    loose = lookup.withColumn("_key", alnum_key(F.col(lookup_name))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    loose = loose.select("_key", F.col(value).alias("_loose"))
    joined = rows.join(exact, name, "left").withColumn("_key", alnum_key(F.col(name))).join(loose, "_key", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "normalized")
    return joined.withColumn(value, F.coalesce("_exact", "_loose")).withColumn("matched", how).drop("_exact", "_loose", "_key")


def consensus(candidates: DataFrame, doc: str, date: str, reference: str) -> DataFrame:
    """One date for each document: the nearest to its reference date, the earlier of two as near; the latest without a reference."""
    gap = F.abs(F.datediff(F.col(date), F.col(reference)))
    best = F.min_by(date, F.struct(gap.alias("g"), F.col(date).alias("d")))
    return candidates.where(F.col(date).isNotNull()).groupBy(doc).agg(
        F.when(F.max(F.col(reference)).isNotNull(), best).otherwise(F.max(date)).alias("consensus"), F.count(F.lit(1)).alias("n_candidates")
    )


def impacts(mentions: DataFrame, targets: DataFrame, key: list[str], source: str, target: str) -> DataFrame:
    """Mentions joined with what they name, themselves left out; what is unknown stays with its own status."""
    t = targets.select(*key, target).dropDuplicates([*key, target])
    joined = mentions.join(t, key, "left").where(F.col(target).isNull() | (F.col(target) != F.col(source)))
    return joined.withColumn("status", F.when(F.col(target).isNull(), "target_not_found").otherwise("target_found")).dropDuplicates()


def coverage(rows: DataFrame, lookup: DataFrame, full: list[str], part: list[str], name: str, value: str) -> DataFrame:
    """``value`` by the full key, else by a part of it that names one entry only, else by the normalised name; with the way it matched."""
    by_full = lookup.groupBy(*full).agg(F.min(value).alias("_full"))
    by_part = lookup.groupBy(*part).agg(F.min(value).alias("_part"), F.count_distinct(value).alias("_many")).where("_many = 1").drop("_many")
    by_name = lookup.groupBy(alnum_key(F.col(name)).alias("_key")).agg(F.min(value).alias("_name"))
    joined = rows.join(by_full, full, "left").join(by_part, part, "left").withColumn("_key", alnum_key(F.col(name))).join(by_name, "_key", "left")
    how = F.when(F.col("_full").isNotNull(), "full_key").when(F.col("_part").isNotNull(), "part_of_key").when(F.col("_name").isNotNull(), "name").otherwise("missing")
    return joined.withColumn(value, F.coalesce("_full", "_part", "_name")).withColumn("matched", how).drop("_full", "_part", "_name", "_key")


def first_rule(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The label of the first rule one of whose patterns the text matches."""
    out = F.lit(otherwise)
    for label, patterns in reversed(rules):
        out = F.when(F.rlike(text, F.lit("|".join(patterns))), label).otherwise(out)
    return out


def sentence_labels(text: Column, rules: dict[str, str]) -> Column:
    """``combo_`` and the sorted labels whose patterns occur; ``none`` without any."""
    t = normalize(text)
    found = F.array_compact(F.array(*[F.when(F.rlike(t, F.lit(p)), k) for k, p in sorted(rules.items())]))
    return F.when(F.size(found) > 0, F.concat(F.lit("combo_"), F.array_join(found, "_"))).otherwise("none")


def entities(text: Column, patterns: dict[str, str]) -> Column:
    """A map from entity name to its distinct matches; names without any are left out."""
    pairs = [F.struct(F.lit(k).alias("key"), F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("value")) for k, p in patterns.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: F.size(x["value"]) > 0))


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``after`` any of whose columns differ from ``before`` (nulls equal)."""
    old = before.select(key, F.struct(*columns).alias("_old"))
    return after.join(old, key).where(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old")


def clauses(text: Column, verbs: str, reach: int = 520) -> Column:
    """Runs after a verb up to a stop, a line end, a semicolon or a bound."""
    return F.regexp_extract_all(normalize(text), F.lit(rf"\b(?:{verbs})\b[^.\n;]{{0,{reach}}}"), F.lit(0))


def summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """``group, value, n`` for each of several groupings in one pass by grouping sets."""
    named = reduce(lambda acc, g: F.when(F.grouping(g) == 0, g).otherwise(acc), reversed(groups), F.lit(None))
    value = F.coalesce(*[F.when(F.grouping(g) == 0, F.coalesce(F.col(g), F.lit("null"))) for g in groups])
    return rows.groupingSets([[g] for g in groups], *groups).agg(F.count(F.lit(1)).alias("n"), named.alias("group"), value.alias("value")).select("group", "value", "n")
