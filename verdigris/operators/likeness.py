"""Names that are alike: a join of sets of letter groups by prefixes, lengths and verification, without a cross join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import normalize
from verdigris.session import staged

#: Letters of a group, and what stands before and behind a name so that its ends count.
GRAM, EDGE = 3, "##"
ALIKE = 0.6


def grams(name: Column) -> Column:
    """The distinct groups of letters of a name in its common form; an empty name has none."""
    plain = normalize(F.coalesce(name, F.lit("")))
    padded = F.concat(F.lit(EDGE), plain, F.lit(EDGE))
    cut = F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: F.substring(padded, i, F.lit(GRAM)))
    return F.when(plain != "", F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _ordered(named: DataFrame) -> DataFrame:
    """``name, size, grams`` with the rarest groups first, in one order for all names."""
    each = named.select("name", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))  # groups of letters: as many as the alphabet gives
    ranked = each.join(counts, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    return ranked.select("name", F.size("g").alias("size"), F.transform("g", lambda x: x["gram"]).alias("grams"))


def alike_names(left: DataFrame, right: DataFrame, name: str, least: float = ALIKE) -> DataFrame:
    """``a, b, likeness``: the distinct names of two tables whose letter groups have a Jaccard similarity of ``least`` or more, no name with itself.

    Sets that are so alike share a group among the ``size - ceil(least * size) + 1`` rarest of each, and their sizes differ by a factor of
    ``least`` at most. So names meet by the rare groups of their beginnings alone, sizes are compared in the join, and what is left is verified
    in full. A name stands for all its rows, as equal names are one.

    Null and empty names are like nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and 1 at most")
    both = left.select(F.col(name).alias("name"), F.lit(1).alias("side")).unionByName(right.select(F.col(name).alias("name"), F.lit(2).alias("side")))
    sides = both.where(F.col("name").isNotNull()).groupBy("name").agg(F.bit_or("side").alias("sides"))
    sides = staged(sides.withColumn("grams", grams(F.col("name"))).where(F.size("grams") > 0), "names")
    known = staged(_ordered(sides).join(sides.select("name", "sides"), "name"), "gram-sets")
    prefix = F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9).cast("int") + 1
    rows = known.select("name", "sides", "size", F.explode(F.slice("grams", F.lit(1), prefix)).alias("gram"))
    a = rows.where(F.col("sides").bitwiseAND(1) > 0).select(F.col("name").alias("a"), F.col("size").alias("sa"), "gram")
    b = rows.where(F.col("sides").bitwiseAND(2) > 0).select(F.col("name").alias("b"), F.col("size").alias("sb"), "gram")
    sizes = (F.col("sb") >= F.col("sa") * least - 1e-9) & (F.col("sa") >= F.col("sb") * least - 1e-9)
    pairs = a.join(b, "gram").where(sizes & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    sets = known.select("name", "grams")
    met = pairs.join(sets.select(F.col("name").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("name").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    likeness = shared / (F.size("ga") + F.size("gb") - shared)
    return met.select("a", "b", F.round(likeness, 6).alias("likeness")).where(likeness >= least - 1e-9)


def nearest_names(wanted: DataFrame, held: DataFrame, name: str, least: float = ALIKE) -> DataFrame:
    """``name, found, likeness``: each wanted name with the one that is meant: itself if it is held, else the most alike (ties: the first), else null."""
    asked, there = wanted.select(name).distinct(), held.select(F.col(name).alias("found")).distinct()
    same = asked.join(there, F.col(name) == F.col("found"), "left")
    order = Window.partitionBy("a").orderBy(F.desc("likeness"), "b")
    best = alike_names(asked, held, name, least).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    rows = same.join(best.select(F.col("a").alias("_a"), "b", F.col("likeness").alias("_l")), F.col(name) == F.col("_a"), "left")
    own = F.col("found").isNotNull()
    return rows.select(F.col(name).alias("name"), F.coalesce("found", "b").alias("found"), F.when(own, 1.0).otherwise(F.col("_l")).alias("likeness"))


def prefix_size(size: int, least: float = ALIKE) -> int:
    """How many of a set's rarest groups must be looked at: what is alike shares one of them."""
    return size - math.ceil(least * size - 1e-9) + 1
