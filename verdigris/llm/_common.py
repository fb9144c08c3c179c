"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.session import drop_staged, shared_dir  # noqa: F401  (the operators have all helpers from here)
from verdigris.session import staged as stage  # noqa: F401

#: Bytes of an Arrow batch that goes to a Python worker: rows are long texts, and several copies of a batch are held at once.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Lower the session's limit of bytes for a batch sent to Python workers, if it still has Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(size))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``: joins and helper columns can't clash with whatever columns the table has."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the fast path; the others map character by character."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def frequent_values(rows: DataFrame, key: str, support: float = 0.001) -> DataFrame:
    """At most ``1 / support`` values of ``key`` (staged), with all that more than ``support`` of the rows carry (Misra-Gries)."""
    binary = dict(rows.dtypes)[key] == "binary"  # counted as text: arrays of bytes are no keys of a summary
    counted = rows.select(F.hex(key).alias(key)) if binary else rows
    found = counted.stat.freqItems([key], support).select(F.explode(f"{key}_freqItems").alias(key)).where(F.col(key).isNotNull())
    return stage(found.select(F.unhex(key).alias(key)) if binary else found, "frequent")  # a summary names a value once


def frequent_first(rows: DataFrame, table: DataFrame, key: str, frequent: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (inner) with ``table``, which has one narrow row for each value of ``key`` at most.

    The frequent values' rows are looked up where they lie, by a broadcast of the bounded number of ``frequent_values``; so a hot
    value fills no task. The others are shuffled and merged. ``rows`` and ``table`` are staged tables: each is read twice.
    """
    frequent = frequent_values(rows, key) if frequent is None else frequent
    hot = table.join(F.broadcast(frequent), key, "left_semi")
    rare = rows.join(F.broadcast(frequent), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rare.join(table.hint("merge"), key))


def frequent_left(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` (staged) with the columns of ``table`` (staged; one narrow row for each value of ``key`` at most), null where it has none.

    Like ``frequent_first``, but no row is lost: those of frequent values and those without a key stay where they lie.
    """
    frequent = frequent_values(rows, key)
    marked = rows.join(F.broadcast(frequent.withColumn("_hot", F.lit(True))), key, "left")
    stays = F.coalesce("_hot", F.lit(False)) | F.col(key).isNull()
    hot = table.join(F.broadcast(frequent), key, "left_semi")
    held = marked.where(stays).drop("_hot").join(F.broadcast(hot), key, "left")
    return held.unionByName(marked.where(~stays).drop("_hot").join(table.hint("merge"), key, "left"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def with_global_rank(df: DataFrame, order: list[str], rank: str, name: str) -> DataFrame:
    """Add the row's place (long, from 0) in the order of the columns ``order``, without one task that sees all rows.

    The rows are dealt to range partitions and numbered inside each; the result is staged, as a second run of the
    range sampling could cut elsewhere. Then the counts of the partitions (one row each) give each its offset.
    Columns named ``_part`` and ``_place`` are used inside and dropped. Equal rows get places in no stated order.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    placed = stage(dealt.withColumn("_place", F.row_number().over(inside).cast("long")), name)
    counts = placed.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    # One row for each range partition: as many as spark.sql.shuffle.partitions says, never a share of the data.
    joined = placed.join(F.broadcast(before), "_part")
    return joined.withColumn(rank, F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def text_slices(column, chars: int = 2_000_000):
    """The texts of an Arrow column (null: empty) in order, as lists of about so many characters: a bound of memory."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def tidied(run):
    """``run`` for ``mapInArrow``: at its end the worker, which stays for other tasks, gives back memory that it holds unused."""

    def batches_of(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return batches_of


def give_back() -> None:
    """Return to the system what the collector, Arrow and the C library hold unused; elsewhere than on glibc the last of them keeps it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_held: dict[str, Callable[[], None]] = {}


def hold(operator: str, clear: Callable[[], None]) -> None:
    """An operator is about to keep tables in this process (``clear`` drops them): those that others kept for their own tasks go."""
    for other in [name for name in _held if name != operator]:
        _held.pop(other)()
    _held[operator] = clear


def mix64(x):
    """Spread the bits of an array of uint64 (the finaliser of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
